"""Quality rules: hard rules on text statistics, then robust multivariate outliers for each language and source.

Each text becomes counts (words, characters in words, symbols, repeated lines, repeated eight-word windows and others) and
a vector of log rates, each smoothed by a pseudo-count so that short texts lie near the middle, in fixed point. For each
language and source, each language, and the whole corpus the minimum covariance determinant is sought by concentration
steps: distances from the present centre and covariance, the 75 % nearest texts, their mean and covariance, and so on until
the determinant stops falling. There are three starts (all texts; texts without symbols or repeats; a sphere around the mean),
of which the best after two steps goes on. A text whose squared Mahalanobis distance is above ``cut`` is rejected.

A step is one aggregation: counts, sums and sums of products by group and bin of distance, in integers, with partial sums in
each task. The nearest part is filled bin by bin; texts in the bin where it ends count with one weight. So results do not
depend on how rows are dealt out, and a hot source is no single task's work. Estimates of small sources are drawn towards
those of their language, and these towards the corpus, as if ``prior`` texts of the larger group had been added (a tenth as
many for the centre); a floor on each variance keeps constant statistics invertible.

Edge cases: null and empty texts have no words and fail the hard rules; null language or source is a group of its own;
ties and repeated rows share one fate; a group in which no row passes the hard rules is measured by its language or the
corpus; where no row at all passes, distances are null; an empty table gives an empty result; other columns pass through
except those that the result adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines")
SYMBOLS, MARKS = common.byte_table(b"#*$%&|<>"), common.byte_table(b".,;:!?")
UPPER, DIGITS = common.byte_table(range(0x41, 0x5B)), common.byte_table(range(0x30, 0x3A))
WINDOW, NEAREST = 8, 0.75
#: Name, numerator, denominator, pseudo-count of each, whether rare, least standard deviation of the log rate. A rare thing's
#: rate is n / (d + pd) + pn / pd, which is the same for all texts without it; another's is (n + pn) / (d + pd).
RATES = (
    ("word_length", "word_chars", "n_words", 250.0, 50.0, False, 0.06),
    ("symbols", "n_symbols", "n_words", 4.0, 40.0, True, 0.25),
    ("capitals", "n_upper", "word_chars", 8.0, 200.0, False, 0.20),
    ("marks", "n_marks", "n_words", 8.0, 50.0, False, 0.20),
    ("digits", "n_digits", "word_chars", 40.0, 400.0, True, 0.25),
    ("repeats", "n_repeat_words", "n_words", 20.0, 60.0, True, 0.25),
)
P = len(RATES)


def _repeated(word: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Where windows of words (numbers) start that stand twice or more in their text. Windows are told apart by hash; where
    two of one hash hold other words, all are compared by their words."""
    many = len(word) - WINDOW + 1
    inside = np.flatnonzero(text_of[:many] == text_of[WINDOW - 1 :]) if many > 0 else np.zeros(0, np.int64)
    if not len(inside):
        return inside
    gram = common.gram_hashes(common.mix(word.astype(np.uint64)), WINDOW)
    key = common.mix(gram[inside] + text_of[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = inside[order[:-1][same]], inside[order[1:][same]]
    if not ((text_of[a] == text_of[b]).all() and all((word[a + k] == word[b + k]).all() for k in range(WINDOW))):
        rows = np.column_stack([text_of[inside], *(word[inside + k] for k in range(WINDOW))])
        _, of, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        return inside[count[of.ravel()] > 1]
    return inside[order[np.append(same, False) | np.append(False, same)]]


def counts(t: common.Texts) -> dict[str, np.ndarray]:
    """The counts of each text."""
    buf, n = t.buf, len(t)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[t.at[1:]] - total[t.at[:-1]]

    plain = common.PLAIN[buf]
    starts, ends = common.spans(buf, common.PLAIN)
    at = np.searchsorted(starts, t.at)
    word = common.numbered(buf, starts, ends)
    text_of = np.repeat(np.arange(n), np.diff(at))
    found = _repeated(word, text_of)
    change = np.zeros(len(word) + 1, np.int32)
    change[found] += 1
    change[found + WINDOW] -= 1
    repeated = np.append(0, np.cumsum(np.cumsum(change)[:-1] > 0))

    n_lines, n_dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = buf.tobytes()
    for i, (a, b) in enumerate(zip(t.at[:-1].tolist(), (t.at[1:] - 1).tolist())):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    return {
        "n_words": np.diff(at), "word_chars": per_text(plain & ((buf & 0xC0) != 0x80)), "n_symbols": per_text(SYMBOLS[buf]),
        "n_dup_lines": n_dup, "n_repeat_words": repeated[at[1:]] - repeated[at[:-1]],
        "n_upper": per_text(UPPER[buf]), "n_marks": per_text(MARKS[buf]), "n_digits": per_text(DIGITS[buf]), "n_lines": n_lines,
    }


def measure(docs: DataFrame, column: str = "text", carry: bool = True) -> DataFrame:
    """docs with the counts of each text and base_failed: fewer than 20 words, or over 30 % of them in repeated windows.
    Without carry the result lacks the text."""
    common.small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (*COUNTS, "base_failed") and (carry or c != column)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.texts(batches, column):
            made = counts(t)
            yield pa.RecordBatch.from_arrays([*(t.rows.column(c) for c in rest), *(pa.array(made[c].astype(np.int64)) for c in COUNTS)], [*rest, *COUNTS])

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return docs.mapInArrow(work, common.added(docs.select(*rest), **dict.fromkeys(COUNTS, "long"))).withColumn("base_failed", failed)


def chi2_below(x: float, k: int) -> float:
    """The chi-squared distribution function, by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    for i in range(1, 2000):
        term *= z / (a + i)
        total += term
        if term < 1e-16 * total:
            break
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, k) < q else (low, mid)
    return high


#: What makes the covariance of the nearest part agree with that of a normal distribution.
FACTOR = NEAREST / chi2_below(chi2_quantile(NEAREST, P), P + 2)


SCALE, HALF, BINS = 1 << 20, 24, 16
_Q = [f"_q{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_ESTIMATE = "_g string, _s int, _n double, _mean array<double>, _cov array<double>, _inverse array<double>, _det double"
#: Rows of estimates that are broadcast (some 600 bytes each); more are joined by shuffling.
FEW = 50_000


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _rates() -> list[Column]:
    """The log rates as integers, in units of 1 / SCALE."""
    return [F.round(F.log(F.col(a) / (F.col(b) + y) + x / y if rare else (F.col(a) + x) / (F.col(b) + y)) * SCALE).cast("long").alias(q) for q, (_, a, b, x, y, rare, _) in zip(_Q, RATES)]


def distance() -> Column:
    """The squared Mahalanobis distance of _q0.. from the group's _mean under its _inverse (rows of one matrix)."""
    d = [F.col(q) / float(SCALE) - F.col("_mean")[i] for i, q in enumerate(_Q)]
    terms = [F.col("_inverse")[i * P + j] * d[i] * d[j] * (1 if i == j else 2) for i, j in _PAIRS]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _name(*parts: Column) -> Column:
    """One text for some values, distinct for distinct ones, nulls included."""
    return F.to_json(F.array(*parts))


def _groups() -> list[Column]:
    """The names of a row's groups: its language and source, its language, the corpus."""
    star, lang, source = F.lit("\u0000all"), F.col("lang").cast("string"), F.col("source").cast("string")
    return [_name(lang, source), _name(lang, star), _name(star, star)]


def _sums() -> list[Column]:
    """Exact sums: products are summed as high and low halves, which never overflow."""
    product = {(i, j): F.col(_Q[i]) * F.col(_Q[j]) for i, j in _PAIRS}
    high = [F.sum(F.shiftright(p, HALF)).alias(f"_h{i}_{j}") for (i, j), p in product.items()]
    low = [F.sum(p.bitwiseAND(F.lit((1 << HALF) - 1))).alias(f"_l{i}_{j}") for (i, j), p in product.items()]
    return [F.count(F.lit(1)).alias("_n"), *(F.sum(q).alias(f"_s{i}") for i, q in enumerate(_Q)), *high, *low]


FLOOR = np.diag([x[-1] ** 2 for x in RATES])


def _moments(rows: list[dict], weights: list[Fraction]) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, mean and covariance of rows of sums."""
    n = sum(w * r["_n"] for w, r in zip(weights, rows))
    mean = [sum(w * r[f"_s{i}"] for w, r in zip(weights, rows)) / n / SCALE for i in range(P)]
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        both = sum(w * ((r[f"_h{i}_{j}"] << HALF) + r[f"_l{i}_{j}"]) for w, r in zip(weights, rows)) / n / SCALE**2
        cov[i, j] = cov[j, i] = float(both - mean[i] * mean[j])
    return float(n), np.array([float(x) for x in mean]), cov


def _told(group: str, start: int, n: float, mean: np.ndarray, cov: np.ndarray) -> dict:
    return {"_g": group, "_s": start, "_n": n, "_mean": mean, "_cov": cov.ravel(), "_inverse": np.linalg.inv(cov).ravel(), "_det": float(np.linalg.det(cov))}


def _table(rows: list[dict]):
    import pandas as pd

    return pd.DataFrame(rows, columns=[x.split()[0] for x in _ESTIMATE.split(", ")])


def _starts(pdf):
    """The sums of a group's plain and other rows in; its starts out."""
    rows = sorted(pdf.to_dict("records"), key=lambda r: r["_plain"])
    rows = [{k: v if k in ("_g", "_plain") else int(v) for k, v in r.items()} for r in rows]
    n, mean, cov = _moments(rows, [Fraction(1)] * len(rows))
    out = [_told(rows[0]["_g"], 0, n, mean, cov + FLOOR), _told(rows[0]["_g"], 2, n, mean, 4 * FLOOR)]
    if rows[-1]["_plain"] and len(rows) > 1:
        m, middle, spread = _moments(rows[-1:], [Fraction(1)])
        out.append(_told(rows[0]["_g"], 1, m, middle, spread + FLOOR))
    return _table(out)


def _step(pdf):
    """The sums of a group and start by bin of distance in; mean and covariance of the nearest part out."""
    rows = sorted(({k: v if k == "_g" else int(v) for k, v in r.items()} for r in pdf.to_dict("records")), key=lambda r: r["_b"])
    left = max(Fraction(NEAREST) * sum(r["_n"] for r in rows), 1)
    used, weights = [], []
    for r in rows:
        if left <= 0:
            break
        weights.append(min(Fraction(1), left / r["_n"]))
        used.append(r)
        left -= r["_n"]
    n, mean, cov = _moments(used, weights)
    return _table([_told(rows[0]["_g"], rows[0]["_s"], n, mean, cov * FACTOR + FLOOR)])


def concentrate(points: DataFrame, steps: int = 30) -> DataFrame:
    """The robust centre and covariance of each group of points (_g and the statistics), stored, one row a group."""
    names = [x.split()[0] for x in _ESTIMATE.split(", ")]
    now = common.stored(points.groupBy("_g", "_plain").agg(*_sums()).groupBy("_g").applyInPandas(_starts, _ESTIMATE).withColumn("_open", F.lit(True)), "mcd-start")
    for k in range(steps):
        bin_ = F.floor(F.log2(distance() + 1 / 64) * BINS).cast("int").alias("_b")
        near = points.join(_small(now.where("_open").select("_g", "_s", "_mean", "_inverse")), "_g").select("_g", "_s", *_Q, bin_)
        made = near.groupBy("_g", "_s", "_b").agg(*_sums()).groupBy("_g", "_s").applyInPandas(_step, _ESTIMATE)
        both = now.alias("a").join(made.alias("b"), ["_g", "_s"], "left")
        fell = F.coalesce(F.col("b._det") < F.col("a._det"), F.lit(False)) if k else F.col("b._det").isNotNull()
        goes_on = fell & ((F.col("b._det") < F.col("a._det") * 0.999) if k else F.lit(True))
        after = both.select("_g", "_s", *(F.when(fell, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in names[2:]), goes_on.alias("_open"))
        if k == 1:  # the best start goes on
            after = after.groupBy("_g").agg(F.min_by(F.struct(*after.columns), F.struct("_det", "_s")).alias("x")).select("x.*")
        before, now = now, common.stored(after, "mcd-step")
        common.forget(before)
        if not now.where("_open").head(1):
            break
    return now


def _drawn(pdf):
    """Estimates of a source, its language and the corpus in; the source's, drawn towards the others, out."""
    out = []
    for r in pdf.to_dict("records"):
        n, mean, cov = 0.0, None, None
        for level in ("c", "b", "a"):  # corpus, language, language and source
            if r[f"{level}_n"] is None or r[f"{level}_n"] != r[f"{level}_n"]:
                continue
            m, centre, spread = r[f"{level}_n"], np.array(r[f"{level}_mean"]), np.array(r[f"{level}_cov"]).reshape(P, P)
            if mean is not None:
                centre = (m * centre + r["prior"] / 10 * mean) / (m + r["prior"] / 10)
                spread = (m * spread + r["prior"] * cov) / (m + r["prior"])
            n, mean, cov = m, centre, spread
        if mean is not None:
            out.append({"_key": r["_key"], "_mean": mean, "_inverse": np.linalg.inv(cov).ravel()})
    return type(pdf)(out, columns=["_key", "_mean", "_inverse"])


def estimate(stats: DataFrame, prior: float = 100.0, steps: int = 30) -> DataFrame:
    """From the columns of measure(), lang and source: _key (language and source), _mean and _inverse, stored. Only rows that
    pass the hard rules count, as texts that fail them say nothing about the others."""
    plain = (F.col("n_symbols") == 0) & (F.col("n_repeat_words") == 0) & (F.col("n_dup_lines") == 0)
    points = stats.where(~F.col("base_failed")).select(F.explode(F.array(*_groups())).alias("_g"), plain.alias("_plain"), *_rates())
    found = concentrate(points, steps)
    own, lang, corpus = _groups()
    keys = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_rows")).select(own.alias("_key"), own.alias("a_g"), lang.alias("b_g"), corpus.alias("c_g"), F.lit(float(prior)).alias("prior"))
    for level in "abc":
        keys = keys.join(found.select(*(F.col(c).alias(level + c) for c in ("_g", "_n", "_mean", "_cov"))), f"{level}_g", "left")
    out = common.stored(keys.mapInPandas(lambda batches: map(_drawn, batches), "_key string, _mean array<double>, _inverse array<double>"), "mcd")
    common.forget(found)
    return out


def verdict(stats: DataFrame, found: DataFrame, cut: float = 30.0) -> DataFrame:
    """stats with ``distance`` (null only where no row at all passes the hard rules) and ``kept``: false if base_failed or
    the distance is above cut."""
    rest = [c for c in stats.columns if c not in ("distance", "kept")]
    own = stats.select(*rest, _groups()[0].alias("_key"), *_rates()).join(_small(found), "_key", "left").select(*rest, distance().alias("distance"))
    return own.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut))


def apply(docs: DataFrame, column: str = "text", cut: float = 30.0, prior: float = 100.0) -> DataFrame:
    """The statistics and verdict of each row. The counts are written once, as every concentration step reads them; the text
    itself is not carried along."""
    stats = common.stored(measure(docs, column, carry=False), "text-statistics")
    return verdict(stats, estimate(stats, prior), cut)


def keep(docs: DataFrame, column: str = "text", cut: float = 30.0, prior: float = 100.0) -> DataFrame:
    """The rows of docs that apply() keeps, with all their columns. Texts are measured again rather than joined with their
    verdicts, so no text is shuffled."""
    stats = common.stored(measure(docs.select(column, "lang", "source"), column, carry=False), "text-statistics")
    found = estimate(stats, prior)
    common.forget(stats)
    own = {c: f"_own_{c}" for c in docs.columns if c in (*COUNTS, "base_failed", "distance", "kept")}
    judged = verdict(measure(docs.withColumnsRenamed(own), column), found, cut).where("kept")
    return judged.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
