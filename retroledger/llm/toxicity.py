"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other text is unlabelled, toxic or not. With a class prior p and logistic
losses l+, l-, the risk p E_pos[l+] + max(0, E_unl[l-] - p E_pos[l-]) is unbiased but for the floor, which keeps a flexible
classifier from driving the second part below zero; where it falls below, its gradient is reversed (Kiryo and others,
2017). The classifier is linear over hashed lower-case words and
beginnings of words (present or not), trained in numpy by Adam. The prior is the
share of toxic among labelled texts. The margin is then calibrated on labelled texts that took no part in training.

Bounds: ``positives`` and ``unlabelled`` rows and ``max_bytes`` of text each go to the driver. All documents are scored
over their whole texts.

Edge cases: null and empty texts have no words and get the score of the intercept; without toxic examples every score
is 0; repeated rows score alike; empty tables give empty results; other columns pass through except ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, fitting

BITS = 22
#: Features: the whole word, and its beginnings of so many bytes if it is longer (stems).
PREFIXES = (1 << 40, 4, 5, 6, 7)
#: A word or stem that stands so often is a feature besides.
LEVELS = (2, 4, 8)


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def _running(buf: np.ndarray) -> np.ndarray:
    """A rolling sum over each beginning of buf, from which any slice gets its feature number in one step. Features may
    share a number; nothing is taken for equal because of it."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=total[1:])
    return total


def _slices(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = (total[ends] - total[starts]) * _power(pow(_BASE, -1, 1 << 64), len(total))[starts]
    return common.mix(h ^ (ends - starts).astype(np.uint64))


def _again(feature: np.ndarray, level: int, low: int) -> np.ndarray:
    """The feature of another's standing so often."""
    return feature * (0x9E3779B1 * level | 1) + level & low


def features(t: common.Texts, bits: int = BITS, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words and stems of each text, each once, and where each text's begin; only those wanted, if given. What
    stands so often as LEVELS say is a feature besides."""
    buf = common.LOWER[t.buf]
    starts, ends = common.spans(buf, common.ALNUM)
    text, total, keys = np.searchsorted(t.at, starts, "right") - 1, _running(buf), []
    for n in PREFIXES:
        some = np.arange(len(starts)) if n > 1000 else np.flatnonzero(ends - starts > n)
        stop = ends[some] if n > 1000 else starts[some] + n
        word = (_slices(total, starts[some], stop) * np.uint64(2 * (n & 15) + 1) >> np.uint64(64 - bits)).astype(np.int64)
        if wanted is not None:
            met = wanted[word]
            some, word = some[met], word[met]
        keys.append(text[some] << bits | word)
    low = (1 << bits) - 1
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    more = [key[count >= k] & ~low | _again(key[count >= k] & low, k, low) for k in LEVELS]
    key = np.unique(np.concatenate([key, *more]))
    return key & low, np.searchsorted(key >> bits, np.arange(len(t) + 1))


def sums(weights: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(weights[words]))
    return total[at[1:]] - total[at[:-1]]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float
    scale: float
    shift: float

    def wanted(self) -> np.ndarray:
        """Which words and stems weigh, by themselves or by standing often."""
        weighs = self.weights != 0
        number = np.arange(len(weighs))
        out = weighs.copy()
        for k in LEVELS:
            out |= weighs[_again(number, k, len(weighs) - 1)]
        return out

    def score(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return fitting.sigmoid(self.scale * (sums(self.weights, words, at) + self.intercept) + self.shift)


def _matrix(texts: list[str], bits: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    if not texts:
        return out
    for t in common.texts([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]):
        words, at = features(t, bits)
        out += np.split(words.astype(np.int32), at[1:-1])
    return out


def _stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)


def train_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, epochs: int = 150, batches: int = 1, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk."""
    rng = np.random.default_rng(seed)
    of = [np.bincount(np.concatenate(rows), minlength=1 << bits) for rows in (positive, unlabelled)]
    ratio = np.log((of[0] + 0.5) / (len(positive) + 1)) - np.log((of[1] + 0.5) / (len(unlabelled) + 1))
    kept = np.flatnonzero((of[0] >= max(3, len(positive) // 200)) & (ratio > 0.5))  # words met once tell texts apart, not kinds
    n, number = len(kept), np.full(1 << bits, -1)
    number[kept] = np.arange(n)
    positive, unlabelled = ([(y := number[x])[y >= 0].astype(np.int32) for x in rows] for rows in (positive, unlabelled))
    ratio = np.append(ratio[kept], 0.0)
    w = np.zeros(n + 1)  # a feature has the value of its ratio in every text that holds it
    w[n] = np.log(prior / (1 - prior))
    first, second, t = np.zeros(n + 1), np.zeros(n + 1), 0
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for ps, us in zip(np.array_split(p_order, batches), np.array_split(u_order, batches)):
            if not len(ps) or not len(us):
                continue
            pw, pa_ = _stack([positive[i] for i in ps])
            uw, ua = _stack([unlabelled[i] for i in us])
            v = w * ratio
            zp, zu = sums(v, pw, pa_) + w[n], sums(v, uw, ua) + w[n]
            sp, su = fitting.sigmoid(zp), fitting.sigmoid(zu)  # slopes of the loss of a negative label
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gp, gu = prior * (sp - 1) / len(ps) - prior * sp / len(ps), su / len(us)
            else:
                gp, gu = prior * sp / len(ps), -su / len(us)
            g = np.bincount(np.concatenate([pw, uw]), np.concatenate([np.repeat(gp, np.diff(pa_)), np.repeat(gu, np.diff(ua))]), n + 1) * ratio
            g[n] = gp.sum() + gu.sum()
            g[:n] += decay * w[:n]
            t += 1
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << bits)
    weights[kept] = w[:n] * ratio[:n]
    return weights, float(w[n])


def fit(toxic: list[str], clean: list[str], unlabelled: list[str], prior: float, bits: int = BITS) -> Model:
    """toxic and clean: labelled texts; every third toxic one is kept for calibration, and clean ones serve for nothing else."""
    if len(toxic) < 4:
        return Model(np.zeros(1 << bits), -np.inf, 1.0, 0.0)
    prior = min(max(prior, 1e-4), 0.5)
    tox, free = _matrix(toxic, bits), _matrix(unlabelled or clean, bits)
    w, b = train_pu([x for i, x in enumerate(tox) if i % 3], free, prior, bits)
    margin = [sums(w, *_stack(rows)) + b for rows in (_matrix(clean, bits), tox[::3])]
    y = np.repeat([0.0, 1.0], [len(m) for m in margin])
    scale, shift = fitting.logistic(np.concatenate(margin)[:, None], y) if len(margin[0]) else (1.0, 0.0)
    return Model(w.astype(np.float32), b, float(max(scale, 1e-3)), float(shift))


def train(docs: DataFrame, labels: DataFrame, modulus: int, held: int, positives: int = 4000, unlabelled: int = 6000, max_bytes: int = 24_000_000) -> Model:
    """Fits on documents outside the held-out share: labelled toxic ones, and unlabelled ones taken without regard to
    any label."""
    known = fitting.learnable(labels, "toxic", modulus, held)
    count = {r["label"]: r["count"] for r in labels.where(F.col("toxic").isin(0, 1) & (fitting.id_hash() % modulus != held)).groupBy(F.col("toxic").cast("int").alias("label")).count().collect()}
    toxic = fitting.sample(docs, known.where("label = 1"), positives, max_bytes)
    clean = fitting.sample(docs, known.where("label = 0"), positives, max_bytes // 2)
    free = fitting.sample(docs.where(fitting.id_hash() % modulus != held), None, unlabelled, max_bytes)
    used = {i for i, _ in toxic[::3]} | {i for i, _ in clean}
    prior = count.get(1, 0) / max(sum(count.values()), 1)
    return fit([t for _, t in toxic], [t for _, t in clean], [t for i, t in free if i not in used], prior)


def score(docs: DataFrame, model: Model, column: str = "text", carry: bool = True) -> DataFrame:
    """docs with ``score``: the probability (0 to 1) that a text is toxic. Without carry the result lacks the text."""
    common.small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "score" and (carry or c != column)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value.wanted()
        for t in common.texts(batches, column):
            made = shared.value.score(*features(t, wanted=wanted))
            yield pa.RecordBatch.from_arrays([*(t.rows.column(c) for c in rest), pa.array(made, pa.float64())], [*rest, "score"])

    return docs.mapInArrow(work, common.added(docs.select(*rest), score="double"))
