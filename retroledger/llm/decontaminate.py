"""Benchmark decontamination over a distributed positional inverted index.

Training texts are cut into blocks; a block's index holds its distinct terms (their bytes, in the order of their hashes)
and, for each, the ascending positions at which it stands (positions run over the block, with a gap between texts, so no
phrase spans two). One block is one row of the index, a table that is written once, serves any benchmark, and is searched
without any shuffle. A phrase is found by taking its rarest term in the block, shifting that term's positions to the
phrase's start, and intersecting them with the shifted positions of the next rarest term, and so on; all phrases go through
a block together. Terms are looked up by hash and compared by their bytes. Proximity matches are the smallest windows of a
text that hold all terms.

Test items are bounded: they go to the tasks in parts of at most ``ITEM_WORDS`` words each, one after another, every part
against all rows of the index; the driver and each task hold one part at a time.

Edge cases: null or empty texts have no words; items without words match nothing; an item shorter than the window is one
phrase; repeated items and rows each get their full result; ids may be null (a null item id counts as the empty string);
empty tables give results without hits; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW, GAP, ITEM_WORDS, BLOCK = 13, 64, 1_000_000, 4_000_000
_TYPES = "words array<long>, spelled binary, lengths binary, counts binary, positions binary"
_COLUMNS = ("words", "spelled", "lengths", "counts", "positions")


def tokens(t: common.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer in lower case, start and end of the words of all texts, and where each text's words begin (one more for
    the end)."""
    buf = common.LOWER[t.buf]
    starts, ends = common.spans(buf, common.ALNUM)
    return buf, starts, ends, np.searchsorted(starts, t.at)


def build(docs: DataFrame, column: str = "text") -> DataFrame:
    """The index of docs (doc_id and text): rows of doc_ids, words (their numbers), and packed terms, counts and positions."""
    common.small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.texts(batches, column, limit=BLOCK):
            buf, starts, ends, at = tokens(t)
            position = np.arange(len(starts)) + np.repeat(np.arange(len(t)) * GAP, np.diff(at))
            terms = Terms.of(buf, starts, ends)
            order = np.argsort(terms.own, kind="stable")
            count = np.bincount(terms.own, minlength=len(terms.hash))
            ids = t.rows.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.diff(at).tolist()], pa.list_(pa.int64())), pa.array([terms.spelled.tobytes()], pa.binary()),
                    *(pa.array([x.astype(np.uint32).tobytes()], pa.binary()) for x in (terms.length, count, position[order])),
                ],
                ["doc_ids", *_COLUMNS],
            )

    df = docs.select("doc_id", column)
    return df.mapInArrow(work, f"doc_ids array<{dict(df.dtypes)['doc_id']}>, {_TYPES}")


class Terms:
    """Distinct terms in the order of their hashes: ``spelled`` (their bytes, one after another), ``start`` and ``length``
    of each, ``hash``; ``own``: of the words that they came from the number of each one's term."""

    def __init__(self, spelled: np.ndarray, length: np.ndarray, hash_: np.ndarray | None = None, own: np.ndarray | None = None):
        self.spelled, self.length = spelled, length.astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.hash = common.xxh64(spelled, self.start, self.length) if hash_ is None else hash_
        self.own = own

    @staticmethod
    def of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Terms:
        hashed = common.hashes(buf, starts, ends)
        number = common.numbered(buf, starts, ends, hashed)
        _, first, own = np.unique(number, return_index=True, return_inverse=True)
        order = np.argsort(hashed[first], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = first[order]
        length = (ends - starts)[first]
        return Terms(buf[common.expand(starts[first], length)], length, hashed[first], place[own])

    def find(self, other: Terms) -> np.ndarray:
        """The number here of each term of another, or -1: first by hash, then by bytes (of terms that share a hash each is
        tried)."""
        out = np.full(len(other.hash), -1, np.int64)
        at = np.searchsorted(self.hash, other.hash)
        open_ = np.flatnonzero(at < len(self.hash))
        while len(open_ := open_[self.hash[at[open_]] == other.hash[open_]]):
            same = self.length[at[open_]] == other.length[open_]
            some = open_[same]
            equal = common.same_bytes(self.spelled, self.start[at[some]], other.start[some], other.length[some], other.spelled)
            out[some[equal]] = at[some[equal]]
            open_ = open_[out[open_] < 0]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.hash)]
        return out


class Block:
    """One row of the index, opened."""

    def __init__(self, words: list[int], spelled: bytes, lengths: bytes, counts: bytes, positions: bytes):
        self.words = np.array(words, np.int64)
        self.start = np.cumsum(self.words + GAP) - self.words - GAP
        self.terms = Terms(np.frombuffer(spelled, np.uint8), np.frombuffer(lengths, np.uint32))
        self.count = np.frombuffer(counts, np.uint32).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.position = np.frombuffer(positions, np.uint32).astype(np.int64)
        self.key = np.repeat(np.arange(len(self.count)), self.count) << 32 | self.position  # ascending

    def phrases(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of equally long phrases (one in each row, as numbers of this block's terms): the phrase's row and its
        start."""
        alive = np.flatnonzero((number >= 0).all(axis=1))
        number = number[alive]
        rare = np.argsort(self.count[number], axis=1, kind="stable") if len(alive) else number
        if not len(alive):
            return alive, alive
        rows = np.arange(len(alive))
        term = number[rows, rare[:, 0]]
        many = self.count[term]
        row = np.repeat(rows, many)
        start = self.position[common.expand(self.first[term], many)] - rare[row, 0]
        for k in range(1, number.shape[1]):
            offset = rare[row, k]
            goal = number[row, offset] << 32 | np.maximum(start + offset, 0)
            at = np.minimum(np.searchsorted(self.key, goal), len(self.key) - 1)
            found = (self.key[at] == goal) & (start >= 0)
            row, start = row[found], start[found]
            if not len(row):
                break
        return alive[row], start

    def near(self, number: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the smallest windows of one text that hold all of some terms (numbers; one that repeats is wanted
        as often), at most reach words beyond one another."""
        none = np.zeros(0, np.int64)
        if not len(number) or (number < 0).any():
            return none, none
        term, want = np.unique(number, return_counts=True)
        place = np.concatenate([self.position[self.first[t] : self.first[t] + self.count[t]] for t in term])
        end = np.sort(place)
        begin = end.copy()
        for t, n in zip(term.tolist(), want.tolist()):  # for each place the nearest start at or before it that has n of t
            own = self.position[self.first[t] : self.first[t] + self.count[t]]
            k = np.searchsorted(own, end, "right") - n
            begin = np.minimum(begin, np.where(k >= 0, own[np.maximum(k, 0)], -1))
        text = np.searchsorted(self.start, end, "right") - 1
        good = (begin >= self.start[text]) & (end - begin <= reach)
        begin, end = begin[good], end[good]
        shortest = np.append(True, begin[1:] != begin[:-1]) if len(begin) else np.zeros(0, bool)
        return begin[shortest], end[shortest]


class Windows:
    """The distinct windows of items, by length, as numbers of their terms, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(self.ids)}
        rows: dict[int, list[np.ndarray]] = {}
        owner: dict[int, list[np.ndarray]] = {}
        batch = pa.RecordBatch.from_arrays([pa.array([x for _, x in items], pa.string())], ["text"])
        t = common.Texts(batch, "text")
        buf, starts, ends, at = tokens(t)
        self.terms = Terms.of(buf, starts, ends)
        word, self.terms.own = self.terms.own.astype(np.int32), None
        for k in range(len(t)):
            w = word[at[k] : at[k + 1]]
            if len(w):
                size = min(window, len(w))
                rows.setdefault(size, []).append(np.lib.stride_tricks.sliding_window_view(w, size))
                owner.setdefault(size, []).append(np.full(len(w) - size + 1, number[items[k][0]]))
        self.by_size: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size, parts in sorted(rows.items()):
            distinct, which = np.unique(np.vstack(parts), axis=0, return_inverse=True)
            pair = np.unique(np.column_stack([which.ravel(), np.concatenate(owner[size])]), axis=0)
            self.by_size.append((distinct, np.searchsorted(pair[:, 0], np.arange(len(distinct) + 1)), pair[:, 1]))


def search(index: DataFrame, windows: Windows) -> DataFrame:
    """One row for each document: doc_id, n_words, spans (starts and ends of maximal runs of words inside matches, in
    words) and item_ids (of the items with a match, ascending)."""
    shared = index.sparkSession.sparkContext.broadcast(windows)
    kind = dict(index.dtypes)["doc_ids"][6:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for rows in batches:
            for i in range(rows.num_rows):
                ids = rows.column("doc_ids")[i].values
                block = Block(*(rows.column(c)[i].as_py() for c in _COLUMNS))
                n = len(block.words)
                change = np.zeros(int((block.words + GAP).sum()) + 1, np.int32)
                pairs = [np.zeros((0, 2), np.int64)]
                here = block.terms.find(w.terms)
                for phrase, at, owner in w.by_size:
                    row, start = block.phrases(here[phrase])
                    np.add.at(change, start, 1)
                    np.add.at(change, start + phrase.shape[1], -1)
                    many = at[row + 1] - at[row]
                    text = np.searchsorted(block.start, start, "right") - 1
                    pairs.append(np.column_stack([np.repeat(text, many), owner[common.expand(at[row], many)]]))
                inside = np.cumsum(change) > 0
                edge = np.flatnonzero(np.diff(np.append(False, inside)))
                begin, end = edge[0::2], edge[1::2]
                text = np.searchsorted(block.start, begin, "right") - 1
                spans = [[] for _ in range(n)]
                for k, a, b in zip(text.tolist(), (begin - block.start[text]).tolist(), (end - block.start[text]).tolist()):
                    spans[k].append({"start": a, "end": b})
                found = [[] for _ in range(n)]
                for k, item in np.unique(np.vstack(pairs), axis=0).tolist():
                    found[k].append(w.ids[item])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(block.words), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(found, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "spans", "item_ids"],
                )

    return index.mapInArrow(work, f"doc_id {kind}, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>")


def near(index: DataFrame, terms: list[str], reach: int) -> DataFrame:
    """Proximity: doc_id, start and end (words, the end included) of every smallest stretch of a text that holds all terms
    with at most reach words from its first to its last. What a text gives does not depend on its block."""
    t = common.Texts(pa.RecordBatch.from_arrays([pa.array([" ".join(terms)])], ["text"]), "text")
    buf, starts, ends, _ = tokens(t)
    wanted = Terms.of(buf, starts, ends)
    kind = dict(index.dtypes)["doc_ids"][6:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                block = Block(*(rows.column(c)[i].as_py() for c in _COLUMNS))
                begin, end = block.near(block.terms.find(wanted)[wanted.own], reach)
                text = np.searchsorted(block.start, begin, "right") - 1
                yield pa.RecordBatch.from_arrays([rows.column("doc_ids")[i].values.take(pa.array(text)), pa.array(begin - block.start[text]), pa.array(end - block.start[text])], ["doc_id", "start", "end"])

    return index.mapInArrow(work, f"doc_id {kind}, start long, end long")


def contamination(docs: DataFrame, items: DataFrame, column: str = "text", window: int = WINDOW) -> DataFrame:
    """search() of all items over all docs, with n_hit (words inside matches), n_items and contaminated: n_hit > 0 and at
    least a twentieth of the words."""
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    parts = max(1, -(-size // (2 * ITEM_WORDS)))  # a word takes two bytes at least, with what parts it from the next
    numbered = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("doc_id"), column)
    index = common.stored(build(numbered, column), "index")
    found, span = None, "array<struct<start:int,end:int>>"
    for k in range(parts):
        windows = Windows([tuple(r) for r in texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()], window)
        part = search(index, windows)
        if parts > 1:  # written before the next part is read, so one part's windows are alive at a time
            part = common.stored(part.where((F.size("item_ids") > 0) | F.lit(k == 0)), "found")
        found = part if found is None else found.unionAll(part)
    if parts > 1:  # results of a document meet by its row in the index
        merged = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        start = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
        ordered = F.array_sort(F.transform("spans", start))
        last = lambda acc: F.element_at(acc, -1)
        longer = lambda acc, s: F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))
        joined = F.aggregate(  # spans of several parts of the items may overlap
            ordered, F.array().cast(span),
            lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer(acc, s)))).otherwise(F.concat(acc, F.array(s))),
        )
        found = merged.select("doc_id", "n_words", joined.alias("spans"), "item_ids")
    found = found.select("doc_id.doc_id", "n_words", "spans", "item_ids")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    out = found.withColumn("n_hit", hit).withColumn("n_items", F.size("item_ids").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, column: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce(column, F.lit(""))).alias("text"))  # tells rows of one id apart
    keyed = docs.withColumn("_key", key)
    found = contamination(keyed.select(F.col("_key").alias("doc_id"), column), items, column, window)
    dirty = common.stored(found.where("contaminated").select(F.coalesce(F.col("doc_id.doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id.doc_id").isNull().alias("_no_id"), F.col("doc_id.text").alias("_text")).distinct(), "contaminated")
    rows = keyed.select(*docs.columns, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id").isNull().alias("_no_id"), F.col("_key.text").alias("_text"))
    return rows.join(dirty, ["_id", "_no_id", "_text"], "left_anti").select(*docs.columns)
