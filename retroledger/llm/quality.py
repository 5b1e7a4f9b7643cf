"""Quality classifier by compression: one zstandard dictionary from good texts, one from bad texts.

A text that is like the good examples is shorter under their dictionary. The score comes from the normalised difference
of both compressed sizes, with the plain compression rate beside it (a text of one repeated line is short under either
dictionary), through a logistic calibration. Each half of the labelled texts calibrates on the dictionaries of the other,
so no text is measured by a dictionary that it built; the dictionaries that score are built from all of them.

Bounds: ``rows`` labelled texts of each label and ``max_bytes`` of their text (the sample is fitted on the driver). Every
document is scored over its whole text.

Edge cases: null and empty texts get the score that the calibration gives to size zero; without labels of both kinds
every score is 0.5; repeated rows are scored alike; an empty table gives an empty result; other columns pass through
except ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common, fitting

DICTIONARY_BYTES, LEVEL, PIECE = 112_640, 3, 256


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:] or b"\n" * 8


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = compressor(good), compressor(bad)

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 5))
        for i, text in enumerate(texts):
            raw = text.encode()
            a = b = 0
            for at in range(0, max(len(raw), 1), PIECE):  # in a long piece the compressor learns from the text itself
                a += len(self.good.compress(raw[at : at + PIECE]))
                b += len(self.bad.compress(raw[at : at + PIECE]))
            difference, rate = (b - a) / (a + b), np.log((len(raw) + 20) / (a + 20))
            out[i] = difference, rate, max(rate - 2, 0), difference * np.log1p(len(raw)) / 5, 10 / (10 + len(raw))
        return out


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        sizes, w = Sizes(self.good, self.bad), np.array(self.weights)
        return lambda texts: fitting.sigmoid(sizes.features(texts) @ w[:-1] + w[-1]) if texts else np.zeros(0)


def fit(texts_of: dict[int, list[str]], size: int = DICTIONARY_BYTES) -> Model | None:
    """A model from texts by label (1 good, 0 bad); None if either has fewer than two texts."""
    if min(len(texts_of.get(k, [])) for k in (0, 1)) < 2:
        return None
    built = lambda step: [_dictionary([t.encode() for t in texts_of[k][step]], size) for k in (1, 0)]
    x, y = [], []
    for half in (0, 1):
        sizes = Sizes(*built(slice(half, None, 2)))
        for k in (0, 1):
            others = texts_of[k][1 - half :: 2]
            x.append(sizes.features(others))
            y += [float(k)] * len(others)
    good, bad = built(slice(None))
    return Model(good, bad, tuple(fitting.logistic(np.vstack(x), np.array(y))))


def train(docs: DataFrame, labels: DataFrame, modulus: int, held: int, rows: int = 4000, max_bytes: int = 16_000_000) -> Model | None:
    """Fits on labelled documents outside the held-out share (see fitting.learnable)."""
    known = fitting.learnable(labels, "quality", modulus, held)
    return fit({k: [t for _, t in fitting.sample(docs, known.where(f"label = {k}"), rows, max_bytes)] for k in (0, 1)})


def score(docs: DataFrame, model: Model | None, column: str = "text", carry: bool = True) -> DataFrame:
    """docs with ``score``: the probability (0 to 1) that a text is good. Without carry the result lacks the text."""
    common.small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "score" and (carry or c != column)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer() if model else lambda texts: np.full(len(texts), 0.5)
        for rows in batches:
            made = scorer([t or "" for t in rows.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), pa.array(made, pa.float64())], [*rest, "score"])

    return docs.mapInArrow(work, common.added(docs.select(*rest), score="double"))
