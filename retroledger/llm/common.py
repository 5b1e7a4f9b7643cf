"""What the corpus operators share: scratch tables, and flat numpy views of Arrow text columns.

Texts are handled as UTF-8 bytes, many documents in one buffer, so words are found and hashed by whole-array
operations. A buffer holds about ``CHUNK`` bytes (or one longer document), which bounds a worker's memory.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

CHUNK = 2_000_000


# ---- scratch tables -------------------------------------------------------------------------------------------

def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset a folder of this machine serves, but only if driver
    and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
        root = "file://" + tempfile.gettempdir() + "/scratch"
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared scratch folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that stored() wrote and lets Spark drop shuffles that nothing refers to any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches hold at most so many rows in this session: documents are long, and each worker and executor holds
    whole batches. Operators call this; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release(spark: SparkSession) -> None:
    """Collects garbage on both sides, so that Spark's cleaner removes the files of finished shuffles. Events that wait for
    listeners still refer to them, so these are let through first; what a first collection sets free holds others."""
    for _ in range(2):
        try:
            spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        except Py4JJavaError:  # a slow listener: the files go at a later call
            pass
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def trim() -> None:
    """Gives memory that a worker has freed back to the system; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def added(df: DataFrame, **types) -> StructType:
    """The schema of df with more columns; types are names or DataTypes."""
    more = [StructField(k, v if not isinstance(v, str) else StructType.fromDDL(f"x {v}")[0].dataType) for k, v in types.items()]
    return StructType([*df.schema.fields, *more])


# ---- flat text ------------------------------------------------------------------------------------------------

class Texts:
    """Some rows of a batch: ``rows`` (a RecordBatch), ``buf`` (their texts as bytes, each followed by one space),
    ``at`` (where each text starts in buf, with one more entry for the end)."""

    def __init__(self, rows: pa.RecordBatch, column: str):
        self.rows = rows
        values = [v or b"" for v in rows.column(column).cast(pa.large_binary()).to_pylist()]
        self.buf = np.frombuffer(b" ".join([*values, b""]), np.uint8)
        self.at = np.zeros(len(values) + 1, np.int64)
        np.cumsum([len(v) + 1 for v in values], out=self.at[1:])

    def __len__(self) -> int:
        return self.rows.num_rows


def texts(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[Texts]:
    """The rows of all batches, in order, as runs of about limit bytes of text."""
    for rows in batches:
        if not rows.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), rows.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield Texts(rows.slice(a, b - a), column)
    trim()


def byte_table(members: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words split at ASCII white space, and of words made of ASCII letters, digits and all non-ASCII characters.
PLAIN = ~byte_table([0x20, *range(0x09, 0x0E)])
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which table holds. The buffer ends with a byte that is none."""
    inside = table[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Fixed: the five primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
M64 = (1 << 64) - 1
#: Slices longer than this are hashed one by one by the library, which is faster from there on.
LONG = 96


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * np.uint64(P2), 31) * np.uint64(P1)


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each slice of buf; short slices of equal length are hashed together."""
    U = np.uint64
    out = np.zeros(len(starts), U)
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh64_intdigest(view[a : a + n], seed) for a, n in zip(starts[long].tolist(), lengths[long].tolist())]
    short = np.flatnonzero(lengths <= LONG) if len(long) else np.arange(len(starts))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(buf) + 1, 8), (1, 1))).view("<u8").ravel()
    order = short[np.argsort(lengths[short].astype(np.uint8), kind="stable")]
    values, first = np.unique(lengths[order], return_index=True)
    zero = np.zeros(1, U)
    for n, a, b in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        which = order[a:b]
        at = starts[which]
        done = 0
        if n >= 32:
            acc = [np.full(len(at), v & M64, U) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while done + 32 <= n:
                for k in range(4):
                    acc[k] = _round(acc[k], eight[at + (done + 8 * k)])
                done += 32
            h = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
            for k in range(4):
                h = (h ^ _round(zero, acc[k])) * U(P1) + U(P4)
        else:
            h = np.full(len(at), (seed + P5) & M64, U)
        h = h + U(n)
        while done + 8 <= n:
            h = _rotate(h ^ _round(zero, eight[at + done]), 27) * U(P1) + U(P4)
            done += 8
        if done + 4 <= n:
            h = _rotate(h ^ ((eight[at + done] & U(0xFFFFFFFF)) * U(P1)), 23) * U(P2) + U(P3)
            done += 4
        while done < n:
            h = _rotate(h ^ ((eight[at + done] & U(0xFF)) * U(P5)), 11) * U(P1)
            done += 1
        h = (h ^ (h >> U(33))) * U(P2)
        h = (h ^ (h >> U(29))) * U(P3)
        out[which] = h ^ (h >> U(32))
    return out


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash (XXH64) of each slice of buf, the same wherever it stands."""
    return xxh64(buf, starts, ends - starts)


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """For each i whether size[i] bytes of buf from a[i] on equal those of other (or buf) from b[i] on."""
    other = buf if other is None else other
    out = np.ones(len(a), bool)
    step = 1 << 20  # bytes at a time, about
    total = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(step, int(total[-1]) + step, step), "left") + 1, 0)) if len(size) else [0]
    for i, j in zip(cuts, np.minimum(cuts[1:], len(size)) if len(size) else []):
        n = size[i:j]
        differ = buf[expand(a[i:j], n)] != other[expand(b[i:j], n)]
        if differ.any():
            out[i + np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(differ), "right"))] = False
    return out


def numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray | None = None) -> np.ndarray:
    """A number (from 0) of each slice, equal for equal slices only: slices are told apart by hash and each is compared with
    the first of its hash; where one differs, all are numbered by their bytes."""
    hashed = hashes(buf, starts, ends) if hashed is None else hashed
    _, first, of = np.unique(hashed, return_index=True, return_inverse=True)
    size = ends - starts
    if (size == size[first][of]).all() and same_bytes(buf, starts, starts[first][of], size).all():
        return of
    raw, known = buf.tobytes(), {}
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i]
    return mix(out)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers starts[i] ... starts[i] + counts[i] - 1 of all i, in one array."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(counts) - counts), counts)


# ---- packed arrays --------------------------------------------------------------------------------------------

def small(x: np.ndarray) -> list[np.ndarray]:
    """Non-negative integers as bytes, 255 standing for a larger one, and those larger ones."""
    x = np.asarray(x, np.int64)
    large = x >= 255
    return [np.where(large, 255, x).astype(np.uint8), x[large]]


def unsmall(low: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[low == 255] = large
    return out


def pack(arrays: Iterable[np.ndarray]) -> bytes:
    """Arrays of bytes, 64-bit integers or 64-bit unsigned integers in one binary value."""
    arrays = list(arrays)
    head = np.array([[{1: 0, 8: 1}[a.itemsize], len(a)] for a in arrays], np.int64)
    return b"".join([np.int64(len(arrays)).tobytes(), head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of pack(), 64-bit ones unsigned."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for wide, size in head.tolist():
        out.append(np.frombuffer(blob, np.uint64 if wide else np.uint8, size, at))
        at += size * (8 if wide else 1)
    return out
