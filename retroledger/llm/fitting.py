"""Bounded, repeatable samples of rows for fitting classifiers, and a small logistic fit.

A sample takes the first ``rows`` rows in the order of a hash of their id, as far as whole texts fit in ``max_bytes``. It is
the only thing that the classifiers bound; scoring reads every row and every whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def id_hash(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def crc(key: object) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode())


def _bound(keyed: DataFrame, rows: int) -> int:
    """A hash below which at least so many rows lie, and few more; 2**32 if there are fewer. Only counts of at most 4096 ranges
    of hashes come to the driver, at most three times."""
    start, width, below = 0, 32, 0
    for bits in (12, 12, 8):
        width -= bits
        part = keyed.where((F.col("_h") >= start) & (F.col("_h") < start + (1 << (width + bits))))
        ranges = {r[0]: r[1] for r in part.groupBy(F.shiftright(F.col("_h") - start, width).alias("k")).count().collect()}
        for k in range(1 << bits):
            if below + ranges.get(k, 0) >= rows:
                break
            below += ranges.get(k, 0)
        else:
            return start + (1 << (width + bits))
        if ranges[k] <= rows or not width:
            return start + (k + 1 << width)
        start += k << width
    return start + 1


def sample(docs: DataFrame, ids: DataFrame | None, rows: int, max_bytes: int) -> list[tuple[int, str]]:
    """(doc_id, text) of the first rows by hash of doc_id, of those in ids if given; a text that does not fit in what is left
    of max_bytes is passed over. One row for each id (ids that repeat: their largest text). Null texts count as empty.

    A hash threshold is found from counts, only ids and sizes below it are gathered, and only the texts of the chosen ids are
    read, by a broadcast of at most so many ids; what reaches the driver does not grow with the input."""
    order = F.crc32(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")).cast("binary"))
    sized = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_size"), order.alias("_h"))
    if ids is not None:
        sized = sized.join(ids, "doc_id", "left_semi")
    wanted = rows
    while True:
        bound = _bound(sized, wanted)
        found = sized.where(F.col("_h") < bound).groupBy("doc_id", "_h").agg(F.max("_size").alias("size")).orderBy("_h", "doc_id").limit(rows).collect()
        if len(found) == rows or bound >= 1 << 32:
            break
        wanted *= 4  # ids repeat
    chosen, left = [], max_bytes
    for r in found:
        if r["size"] <= left:
            chosen.append((r["doc_id"],))
            left -= r["size"]
    if not chosen:
        return []
    few = docs.sparkSession.createDataFrame(chosen, docs.select("doc_id").schema)
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", text.alias("text")).join(F.broadcast(few), "doc_id", "left_semi")
    taken = read.groupBy("doc_id").agg(F.max(F.struct(F.octet_length("text"), "text")).alias("t")).select("doc_id", "t.text").collect()
    return sorted(map(tuple, taken), key=lambda x: (crc(f"sample:{x[0]}"), x[0]))


def learnable(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """doc_id and label of labelled documents whose id hash modulo modulus is not held. Rows of labels without a label are
    left out; of contradictory rows the larger label counts."""
    return labels.where(F.col(label).isin(0, 1) & (id_hash() % modulus != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * max(len(y), 1))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))
