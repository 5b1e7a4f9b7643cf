"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has bit b if more than half of its shingles' hashes have it. Two fingerprints that differ in at most
``radius`` bits have a common neighbour within half the radius of both, so each distinct fingerprint emits all variants
within that ball (2081 for radius 4), variants are shuffled, and fingerprints that meet at a variant are verified and
linked. Any two that meet are within the radius, so linking all to the smallest of them keeps every component whole
without writing all pairs. Copies have one fingerprint and cost one ball.

Variants travel packed: a task sorts them into buckets by a bijective hash and sends each bucket as one binary row (hash
and number of the flipped bits: ten bytes a variant). ``passes`` passes each treat the variants of one class and free their
shuffle before the next, which bounds the disk. The class is a set of parities of the variant; a flip changes it in a known
way, so a pass makes only the variants that belong to it. Components come from alternating large-star and small-star rounds
over tables, so no task or driver holds all links; they are worked out on distinct fingerprints, which documents join once.

Edge cases: null, empty and blank texts have the fingerprint zero, and link like any other; texts of one to three words
are one shingle; repeated rows share fingerprint and component; null ids take no part in choosing the smallest id, and a
component of null ids only has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SHINGLE, RADIUS, SEED = 4, 4, 42
U = np.uint64
M64 = common.M64


def fingerprints_of(t: common.Texts, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    plain = common.PLAIN[t.buf]
    keep = plain.copy()
    keep[1:] |= plain[:-1]  # words, and one byte after each
    buf = np.where(plain, common.LOWER[t.buf], np.uint8(0x20))[keep]
    starts, ends = common.spans(buf, common.PLAIN)
    count = np.diff(np.append(0, np.cumsum(keep))[t.at])
    at = np.searchsorted(starts, np.append(0, np.cumsum(count)))
    words = np.diff(at)
    many = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    first = common.expand(at[:-1], many)
    last = first + np.repeat(np.minimum(words, shingle) - 1, many)
    h = common.xxh64(buf, starts[first], ends[last] - starts[first], SEED)
    out = np.zeros(len(t), U)
    some = np.flatnonzero(many)
    if not len(some):
        return out
    begin = (np.cumsum(many) - many)[some]
    bits = np.zeros((len(some), 64), np.int64)
    lanes = h.view(np.uint8).reshape(-1, 8)
    step = 1 << 16  # shingles at a time: 64 bytes each
    bounds = np.append(begin, len(h))
    for a in range(0, len(h), step):
        b = min(a + step, len(h))
        of = np.unpackbits(lanes[a:b], axis=1, bitorder="little")
        i, j = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left")
        cut = np.maximum(bounds[i:j], a) - a
        bits[i:j] += np.add.reduceat(of, cut, axis=0, dtype=np.int32)
    over = (2 * bits > many[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, column: str = "text", shingle: int = SHINGLE, carry: bool = True) -> DataFrame:
    """docs with ``fp``: the 64-bit fingerprint of each text as a signed integer. Without carry the result lacks the text."""
    common.small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "fp" and (carry or c != column)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.texts(batches, column, limit=500_000):
            made = fingerprints_of(t, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(t.rows.column(c) for c in rest), pa.array(made)], [*rest, "fp"])

    return docs.mapInArrow(work, common.added(docs.select(*rest), fp="long"))


def ball(half: int) -> np.ndarray:
    """All masks of at most half set bits."""
    return np.array([sum(1 << b for b in bits) for n in range(half + 1) for bits in itertools.combinations(range(64), n)], U)


SPREAD = 0xD1342543DE82EF95
GATHER = pow(SPREAD, -1, 1 << 64)
SLAB = 4000


#: Fixed odd-looking sets of bits whose parities make the class of a fingerprint; any that are independent will do.
PARITIES = tuple(U(0x9E3779B97F4A7C15 * (2 * k + 1) & M64) for k in range(10))


def classes(x: np.ndarray, bits: int) -> np.ndarray:
    """A class below 2**bits of each value; that of a ^ b is the class of a ^ the class of b."""
    out = np.zeros(len(x), np.int64)
    for k in range(bits):
        out |= (np.bitwise_count(x & PARITIES[k]).astype(np.int64) & 1) << k
    return out


def _emit(masks: np.ndarray, part: int, bits: int, buckets: int):
    """A task: fingerprints in, packed variants of one class out."""
    of_mask = classes(masks, bits)
    wanted = [np.flatnonzero(of_mask == c) for c in range(1 << bits)]
    width = U(M64 // buckets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        for rows in batches:
            pending.append(rows.column(0).to_numpy().view(U))
            if sum(map(len, pending)) >= 8 * SLAB:
                yield from flush(pending)
                pending = []
        if pending:
            yield from flush(pending)

    def flush(pending: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, flips = [], []
        every = np.concatenate(pending)
        own = classes(every, bits)
        for c in range(1 << bits):
            number = wanted[c ^ part]
            key = ((every[own == c][:, None] ^ masks[number][None, :]) * U(SPREAD)).ravel()
            keys.append(key)
            flips.append(np.tile(number.astype(np.uint16), len(key) // max(len(number), 1)))
        key, flip = np.concatenate(keys), np.concatenate(flips)
        bucket = np.minimum(key // width, U(buckets - 1)).astype(np.int32)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
        key, flip = key[order], flip[order]
        bounds = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
        full = np.flatnonzero(np.diff(bounds))
        blobs = [key[bounds[i] : bounds[i + 1]].tobytes() + flip[bounds[i] : bounds[i + 1]].tobytes() for i in full]
        for i in range(0, len(full), 256):
            yield pa.RecordBatch.from_arrays([pa.array(full[i : i + 256].astype(np.int32)), pa.array(blobs[i : i + 256], pa.binary())], ["bucket", "packed"])

    return work


def _meet(masks: np.ndarray):
    """A bucket: its packed variants in, links (smaller and larger fingerprint) out, each once."""

    def work(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, np.uint8) for b in table.column("packed").to_pylist()]
        key = np.concatenate([b[: len(b) // 10 * 8].view("<u8") for b in blobs])
        flip = np.concatenate([b[len(b) // 10 * 8 :].view("<u2") for b in blobs])
        del blobs
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        sieve = np.zeros(1 << 22, bool)
        sieve[twice >> U(8) & U((1 << 22) - 1)] = True
        maybe = np.flatnonzero(sieve[key >> U(8) & U((1 << 22) - 1)])
        place = np.minimum(np.searchsorted(twice, key[maybe]), max(len(twice) - 1, 0))
        hit = twice[place] == key[maybe] if len(twice) else np.zeros(0, bool)
        maybe, place = maybe[hit], place[hit]
        fp = (key[maybe] * U(GATHER)) ^ masks[flip[maybe]]
        order = np.lexsort((fp, place))
        fp, place = fp[order], place[order]
        head = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
        least = fp[head][np.cumsum(head) - 1]
        other = least != fp
        pairs = np.unique(np.column_stack([least[other], fp[other]]), axis=0)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]  # holds for all; the check of the method
        del key, flip, ordered, sieve
        common.trim()
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), "b": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))})

    return work


def links(fps: DataFrame, passes: int = 8, bucket_variants: int = 1_500_000) -> DataFrame:
    """a, b: links among the distinct values of fps.fp that join every two within RADIUS bits (not every pair of a
    crowd: at each meeting place all link to the smallest). passes: a power of two, up to 1024."""
    masks, bits = ball(RADIUS // 2), passes.bit_length() - 1
    if passes != 1 << bits or bits > len(PARITIES):
        raise ValueError(f"passes must be a power of two up to {1 << len(PARITIES)}")
    spark = fps.sparkSession
    alone = common.stored(fps.select("fp").distinct(), "fingerprints")
    total = alone.count() * len(masks)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // 40_000_000))
    buckets = max(1, -(-total // passes // bucket_variants))
    found = []
    for k in range(passes):
        spread = alone.repartition(tasks).mapInArrow(_emit(masks, k, bits, buckets), "bucket int, packed binary")
        found.append(common.stored(spread.groupBy("bucket").applyInArrow(_meet(masks), "a long, b long").distinct(), "links"))
        del spread
        common.release(spark)
    common.forget(alone)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    out = common.stored(out.distinct(), "all-links")
    for x in found:
        common.forget(x)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of edges (a, b) with the smallest node that it is connected to.

    Rounds of large star (larger neighbours go to the smallest neighbour) and small star (smaller ones and the node go to
    the smallest) until nothing changes; each round is aggregations and joins over a stored table."""
    now = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = common.stored(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # here all edges point to a smaller node
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        after = common.stored(small, "star")
        done = after.count() == now.count() and not after.join(now, ["a", "b"], "left_anti").head(1)
        common.forget(large)
        common.forget(now)
        now = after
        if done:
            break
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, column: str = "text", **parameters: int) -> DataFrame:
    """docs without the text, with ``fp``, ``component_id``: the smallest doc_id that can be reached over links between
    fingerprints, the document itself included, and ``root``: the smallest fingerprint of the component."""
    marked = common.stored(fingerprints(docs, column, carry=False), "marked")
    roots = common.stored(components(links(marked, **parameters)), "roots")
    alone = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = common.stored(alone.join(roots, alone["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "linked")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    known = linked.join(ids, "root").select("fp", "root", "component_id")
    rest = [c for c in marked.columns if c not in ("component_id", "root")]
    return marked.select(*rest).join(known, "fp")


def representatives(docs: DataFrame, column: str = "text", **parameters: int) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component, one for each component (of several texts with
    that id the one of smallest hash, of repeated rows one)."""
    text = F.xxhash64(F.coalesce(column, F.lit(""))).alias("_text")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id").isNull().alias("_no_id")
    kept = near_duplicates(docs.select("doc_id", column, text), column, **parameters).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    same = kept.groupBy("root", "_text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    wanted = same.groupBy("root").agg(F.min_by(F.struct("_text", "n", "doc_id"), "_text").alias("w")).select(F.col("w._text").alias("_text"), F.col("w.n").alias("n"), F.col("w.doc_id").alias("doc_id"))
    keys = common.stored(wanted.select(*id_, "_text", "n").distinct(), "representatives")
    rows = docs.select("*", *id_, text)
    by = ["_id", "_no_id", "_text"]
    single = rows.join(keys.where("n = 1"), by, "left_semi")
    repeated = rows.join(keys.where("n > 1"), by, "left_semi").dropDuplicates(by)
    return single.unionAll(repeated).select(*docs.columns)
