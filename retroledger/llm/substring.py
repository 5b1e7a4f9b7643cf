"""Substring dedup with a compressed FM-index for each shard.

Words are the symbols. A text's windows of ``window`` words are cut into runs that share a minimizer (the least hash among
the ``K``-word pieces of a window); equal windows have equal minimizers, so it is enough to compare runs with one
minimizer. Minimizers that stand once in all texts are dropped. The words of each other run are a piece; equal pieces are
counted together, with the earliest place of them, before they travel, and go to shards by minimizer. A minimizer that
stands very often would fill a shard, so its runs are cut into single windows, which go to shards by their own digest.

A shard builds an FM-index of its pieces: words numbered by their bytes, suffix order by doubling, the Burrows-Wheeler
transform in a wavelet matrix of packed bits with block counts, and the earliest place below each range of suffixes, by
minima of blocks. All pieces are streamed through it together: backward search extends each match to the left as long as the
range holds a place earlier than the piece's own, which gives the matching statistics against earlier text, and intervals
of ``window`` words or more are reported. A piece that stands several times is asked twice: at its earliest place, and just
behind it, which is the answer for all its other places. No window is judged in any other way.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; rows that share id and text are
judged alike; a null id counts as later than all others; of rows that share an id but not the text, only the place of a
window within the text decides; ids are integers (others raise TypeError); an empty table gives an empty result; other
columns pass through except those added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType, NullType

from . import common

WINDOW, K = 20, 8
HOT, SHARD_WORDS, MOST = 4000, 400_000, 256
U = np.uint64
LAST = (1 << 63) - 1


def tokens(t: common.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and where each text's words begin."""
    starts, ends = common.spans(t.buf, common.PLAIN)
    return common.hashes(t.buf, starts, ends), starts, ends, np.searchsorted(starts, t.at)


def _slide(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """best (minimum or maximum) of every span consecutive entries, by doubling."""
    width = 1
    while width < span:
        step = min(width, span - width)
        x = best(x[: len(x) - step], x[step:]) if len(x) > step else x[:0]
        width += step
    return x


def runs(word: np.ndarray, at: np.ndarray, window: int = WINDOW, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer, at most so many windows each: text, first window (in words of the text), number of
    windows, minimizer, and whether the minimizer stands in the run more than once."""
    gram, span = common.gram_hashes(word, K), window - K + 1
    least = _slide(gram, span, np.minimum)
    size = np.diff(at)
    many = np.maximum(size - window + 1, 0)
    place = common.expand(at[:-1], many)
    text = np.repeat(np.arange(len(size)), many)
    mark = least[place]
    head = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (text[1:] != text[:-1]))) if len(place) else place
    length, begin = np.diff(np.append(head, len(place))), place[head]
    edge = np.zeros(span - 1, U)
    lowest = np.flatnonzero(gram == _slide(np.concatenate([edge, least, edge]), span, np.maximum)) if len(least) else place
    again = np.append(0, np.cumsum(gram[lowest][1:] == gram[lowest][:-1]))
    if not len(head):
        return text[head], begin, length, mark[head], np.zeros(0, bool)
    low, high = np.searchsorted(lowest, begin), np.searchsorted(lowest, begin + length + span - 1) - 1
    parts = -(-length // most)
    of = np.repeat(np.arange(len(head)), parts)
    skip = most * common.expand(np.zeros(len(head), np.int64), parts)
    text, begin = text[head][of], begin[of] + skip
    return text, begin - at[:-1][text], np.minimum(length[of] - skip, most), mark[head][of], (again[high] > again[low])[of]


def _minimizers(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.texts(batches):
            word, _, _, at = tokens(t)
            text, first, many, mark, twice = runs(word, at, window)
            own = [t.rows.column(c).take(pa.array(text)) for c in ("key", "tag")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(mark.view(np.int64)), pa.array(twice)], ["key", "tag", "first", "many", "mark", "twice"])

    return work


def _pieces(window: int):
    """Texts with their repeated runs in; pieces out: shard key, digest of the words (128 bits as two numbers), place and
    words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.texts(batches):
            lists = t.rows.column("runs")
            flat = lists.flatten()
            first, many, mark, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            text = np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy()))
            word, starts, ends, at = tokens(t)
            cut = np.where(hot, many, 1)
            of = np.repeat(np.arange(len(first)), cut)
            begin = first[of].astype(np.int64) + np.arange(len(of)) - np.repeat(np.cumsum(cut) - cut, cut)
            size = np.where(hot[of], window, many[of] + window - 1).astype(np.int64)
            plain = common.PLAIN[t.buf]
            keep = plain.copy()
            keep[1:] |= plain[:-1]
            buf = np.where(plain, t.buf, np.uint8(0x20))[keep]  # words with one space after each
            into = np.append(0, np.cumsum(keep))
            a, b = at[text[of]] + begin, at[text[of]] + begin + size
            lo, hi = into[starts[a]], into[ends[b - 1]]
            raw = buf.tobytes()
            content = [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
            digest = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in content]), np.int64).reshape(-1, 2)
            h1, h2 = np.ascontiguousarray(digest[:, 0]), np.ascontiguousarray(digest[:, 1])
            shard = np.where(hot[of], h1, mark[of])
            own = [t.rows.column(c).take(pa.array(text[of])) for c in ("key", "tag")]
            made = [pa.array(begin.astype(np.int32)), pa.array((size - window + 1).astype(np.int32)), pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h1), pa.array(h2), *own, *made], ["shard", "h1", "h2", "key", "tag", "first", "many", "words"])

    return work


class WaveletMatrix:
    """A sequence of symbols below 2**levels as one packed bit vector a level, with ones counted before each 64 bits."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.bits, self.before, self.zeros = len(symbols), levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(U)
            self.bits.append(packed)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(packed)))[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        return self.before[k][block] + np.bitwise_count(self.bits[k][block] & ((U(1) << (i & 63).astype(U)) - U(1)))

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before low and before high."""
        start = np.zeros(len(symbol), np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            a, b, c = self._ones(k, start).astype(np.int64), self._ones(k, low).astype(np.int64), self._ones(k, high).astype(np.int64)
            z = self.zeros[k]
            start, low, high = (np.where(one, z + x, i - x) for x, i in ((a, start), (b, low), (c, high)))
        return low - start, high - start


#: Suffixes in a block of places.
SPAN = 64


class FMIndex:
    """An index of pieces: ``words`` (symbols from 1 on, all pieces one after another), ``at`` (where each begins)."""

    def __init__(self, words: np.ndarray, at: np.ndarray, order: np.ndarray):
        """order: for each word the rank of its place (text, then position) among all; equal places have equal ranks."""
        pieces = len(at) - 1
        n = len(words) + pieces
        of = np.repeat(np.arange(pieces), np.diff(at))
        self.at = at[:-1] + np.arange(pieces)  # with a separator after each piece
        where = np.arange(len(words)) + of
        text, place = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int32).max, np.int64)
        text[where] = words
        place[where] = order
        ends = self.at + np.diff(at)
        rank = text + pieces
        rank[ends] = np.arange(pieces)  # separators differ, so suffixes do
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            suffix = np.argsort(key)
            ordered = key[suffix]
            rank[suffix] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            if rank[suffix[-1]] == n - 1:
                break
            step *= 2
        self.text, self.n, self.places = text, n, place
        self.levels = max(1, int(words.max(initial=0)).bit_length())
        self.count = np.append(0, np.cumsum(np.bincount(text, minlength=1 << self.levels)))
        self.bwt = WaveletMatrix(text[suffix - 1], self.levels)
        table = place[suffix].astype(np.int32)
        self.table = table
        edge = np.full(-n % SPAN, np.iinfo(np.int32).max, np.int32)
        blocks = np.append(table, edge).reshape(-1, SPAN)
        self.before = np.minimum.accumulate(blocks, axis=1).ravel()  # from the start of the block on
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()  # up to its end
        least, width = blocks.min(axis=1), 1
        self.least = [least]
        while 2 * width <= len(blocks):
            least = np.minimum(least[: len(least) - width], least[width:])
            self.least.append(least)
            width *= 2

    def first_place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least rank of a place among suffixes low .. high - 1 (at least one)."""
        left, right = low // SPAN, (high - 1) // SPAN
        out = np.minimum(self.behind[low], self.before[high - 1])
        inner = np.flatnonzero(left == right)
        if len(inner):
            size = (high - low)[inner]
            out[inner] = np.minimum.reduceat(self.table[common.expand(low[inner], size)], np.cumsum(size) - size)
        wide = np.flatnonzero(right - left > 1)
        a, b = left[wide] + 1, right[wide]  # whole blocks a .. b - 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            here = level == k
            out[wide[here]] = np.minimum(out[wide[here]], np.minimum(self.least[k][a[here]], self.least[k][b[here] - (1 << k)]))
        return out

    def covered(self, piece: np.ndarray, size: np.ndarray, window: int, behind: int = 0) -> np.ndarray:
        """For every window of the pieces (all windows of a piece, then the next's) whether an equal one has an earlier
        place. behind: 1 asks from just behind the pieces' places."""
        many = size - window + 1
        base = np.cumsum(many) - many
        out = np.zeros(int(many.sum()), bool)
        right = size.copy()  # the match under way is words left .. right - 1 of the piece
        live = np.flatnonzero(many > 0)
        left = right.copy()
        low, high = np.zeros(len(piece), np.int64), np.full(len(piece), self.n, np.int64)
        starts = self.at[piece]
        while len(live):
            symbol = self.text[starts[live] + left[live] - 1]
            a, b = self.bwt.rank(symbol, low[live], high[live])
            low[live], high[live] = self.count[symbol] + a, self.count[symbol] + b
            left[live] -= 1
            # the piece itself is in the index, so the range is never empty
            earlier = self.first_place(low[live], high[live]) < self.places[starts[live] + left[live]] + behind
            stopped = live[~earlier]
            whole = live[earlier & (left[live] == 0)]
            done = np.concatenate([stopped, whole])
            match = np.concatenate([left[stopped] + 1, left[whole]])  # where the longest match to an earlier place begins
            last = right[done] - window  # the last window inside it
            inside = np.maximum(last - match + 1, 0)
            out[np.repeat(base[done] + match, inside) + (np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside))] = True
            # Windows that begin at or before left and end at right or later hold an unmatched stretch; later ones are judged
            right[stopped] = np.minimum(right[stopped] - 1, left[stopped] + window)
            left[stopped], low[stopped], high[stopped] = right[stopped], 0, self.n
            live = np.concatenate([live[earlier & (left[live] > 0)], stopped[right[stopped] >= window]])
        return out


def _search(window: int):
    """A shard: distinct pieces in; for each, which of its windows have an earlier equal (packed bits) out: at its earliest
    place (bits) and, if it stands several times, at its other places (again)."""

    def packed(found: np.ndarray, many: np.ndarray) -> list[bytes]:
        return [np.packbits(found[b - m : b], bitorder="little").tobytes() for m, b in zip(many.tolist(), np.cumsum(many).tolist())]

    def work(table: pa.Table) -> pa.Table:
        column = table.column("words").combine_chunks().cast(pa.large_binary())
        t = common.Texts(pa.RecordBatch.from_arrays([column], ["words"]), "words")
        hashed, starts, ends, at = tokens(t)
        words = common.numbered(t.buf, starts, ends, hashed) + 1
        size = np.diff(at)
        key = table.column("key").to_numpy()
        first = table.column("first").to_numpy().astype(np.int64)
        text = np.repeat(key, size)
        position = common.expand(first, size)
        order = np.lexsort((position, text))
        changed = np.append(False, (text[order][1:] != text[order][:-1]) | (position[order][1:] != position[order][:-1]))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.cumsum(changed)
        index = FMIndex(words, at, rank)
        several = np.flatnonzero(table.column("n").to_numpy() > 1)
        bits = packed(index.covered(np.arange(len(size)), size, window), size - window + 1)
        again: list[bytes | None] = [None] * len(size)
        for i, b in zip(several.tolist(), packed(index.covered(several, size[several], window, 1), (size - window + 1)[several])):
            again[i] = b
        return pa.table({**{c: table.column(c) for c in ("h1", "h2", "key", "first")}, "bits": pa.array(bits, pa.binary()), "again": pa.array(again, pa.binary())})

    return work


def _cut(window: int, rest: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.texts(batches):
            rows = t.rows
            _, starts, ends, at = tokens(t)
            n = np.diff(at)
            change = np.zeros(at[-1] + 1, np.int32)
            lists = rows.column("_found")
            flat = lists.flatten()
            begin, many = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            bits = flat.field(2).to_pylist()
            text = np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy()))
            begin += at[text]
            for i, (a, m) in enumerate(zip(begin.tolist(), many.tolist())):
                own = a + np.flatnonzero(np.unpackbits(np.frombuffer(bits[i], np.uint8), count=m, bitorder="little"))
                change[own] += 1
                change[own + window] -= 1
            gone = np.cumsum(change)[:-1] > 0
            removed = np.append(0, np.cumsum(gone))
            plain = common.PLAIN[t.buf]
            mark = np.zeros(len(t.buf) + 1, np.int8)
            mark[starts[~gone]] += 1
            mark[ends[~gone]] -= 1
            inside = np.cumsum(mark[:-1]) > 0
            keep = inside.copy()
            keep[1:] |= inside[:-1]  # kept words, and one byte after each, which becomes a space
            raw = np.where(plain, t.buf, np.uint8(0x20))[keep]
            edge = np.append(0, np.cumsum(keep))[t.at]
            kept = [raw[a : max(a, b - 1)].tobytes().decode() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            run = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans: list[list] = [[] for _ in range(len(t))]
            for a, b in zip(run[0::2].tolist(), run[1::2].tolist()):
                k = int(np.searchsorted(at, a, "right")) - 1
                while a < b:  # a run of removed words may go on in the next text
                    stop = min(b, int(at[k + 1]))
                    if stop > a:
                        spans[k].append({"start": a - int(at[k]), "end": stop - int(at[k])})
                    a, k = max(a, stop), k + 1
            made = [pa.array(n), pa.array(removed[at[1:]] - removed[at[:-1]]), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), *made], [*rest, "n_words", "n_removed", "kept_text", "removed"])

    return work


ADDED = ("n_words", "n_removed", "kept_text", "removed")


def deduplicate(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard_words: int = SHARD_WORDS, carry: bool = True) -> DataFrame:
    """docs with n_words, n_removed, removed (spans of words) and kept_text (the other words, joined by one space): each
    word is removed that lies in a window of words which also starts earlier (in a text of smaller doc_id, or before in
    the same text). Without carry the result lacks the text and all columns but doc_id."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rest = [c for c in docs.columns if c not in ADDED and (carry or c == "doc_id")]
    text = F.coalesce("text", F.lit(""))
    kind = docs.select("doc_id").schema[0].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"doc_id must be an integer, not {kind.simpleString()}")
    key, tag = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(text).alias("tag")  # the tag tells rows of one id apart

    own = docs.select(key, tag, "text")
    marks = common.stored(own.mapInArrow(_minimizers(window), "key long, tag long, first int, many int, mark long, twice boolean"), "minimizers")
    often = marks.groupBy("mark").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("mark", (F.col("n") >= hot).alias("hot"))
    runs_of = common.stored(marks.join(often, "mark").groupBy("key", "tag").agg(F.collect_set(F.struct("first", "many", "mark", "hot")).alias("runs")), "runs")
    common.forget(marks)
    common.release(spark)
    schema = "shard long, h1 long, h2 long, key long, tag long, first int, many int, words binary"
    pieces = common.stored(own.join(runs_of, ["key", "tag"]).select("key", "tag", "text", "runs").mapInArrow(_pieces(window), schema), "pieces")
    common.forget(runs_of)
    common.release(spark)

    distinct = pieces.groupBy("h1", "h2").agg(F.min(F.struct("key", "first")).alias("at"), F.first("shard").alias("shard"), F.first("many").alias("many"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
    contents = common.stored(distinct.select("h1", "h2", "at.key", "at.first", "shard", "many", "words", "n"), "contents")
    common.release(spark)
    total = contents.agg(F.coalesce(F.sum(F.col("many") + (window - 1)), F.lit(0))).head()[0]
    shards = max(1, -(-total // shard_words))
    sharded = contents.withColumn("shard", F.pmod("shard", F.lit(shards)))
    verdicts = common.stored(sharded.groupBy("shard").applyInArrow(_search(window), "h1 long, h2 long, key long, first int, bits binary, again binary"), "verdicts")
    common.forget(contents)
    common.release(spark)
    v = verdicts.select("h1", "h2", F.col("key").alias("k0"), F.col("first").alias("f0"), F.col("bits").alias("b0"), "again")
    bits = F.when((F.col("key") == F.col("k0")) & (F.col("first") == F.col("f0")), F.col("b0")).otherwise(F.col("again"))
    judged = pieces.drop("words", "shard").join(v, ["h1", "h2"]).withColumn("bits", bits).where(F.ltrim(F.hex("bits"), F.lit("0")) != "")
    found = judged.groupBy("key", "tag").agg(F.collect_set(F.struct("first", "many", "bits")).alias("found"))
    none = F.array().cast("array<struct<first:int,many:int,bits:binary>>")
    known = common.stored(found, "found")
    common.forget(pieces)
    common.forget(verdicts)
    common.release(spark)
    both = dict.fromkeys([*rest, "text"])
    whole = docs.select(*both, key.alias("_key"), tag.alias("_tag")).join(known.select(F.col("key").alias("_key"), F.col("tag").alias("_tag"), "found"), ["_key", "_tag"], "left")
    ready = whole.select(*both, F.coalesce("found", none).alias("_found"))
    return ready.mapInArrow(_cut(window, rest), common.added(docs.select(*rest), n_words="long", n_removed="long", kept_text="string", removed="array<struct<start:int,end:int>>"))
