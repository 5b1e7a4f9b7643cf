"""Language-model scoring by a weighted backoff automaton.

The model is a trigram model with absolute discounting at each order. Its automaton has a root, a state for each word seen in
training (and one for the start of a text), and a state for each pair of words seen in training. A state has an arc for
every word that followed it, weighted with the interpolated log probability, and a failure arc to the state of the context
without its first word, with the weight log10(D T(h) / c(h)): D the discount, T(h) the number of distinct followers, c(h) the
count. The root has an arc for each word seen, and a last arc for all words never seen, which takes the discounted mass.
A text is traversed once from left to right: the state is carried from word to word, failure arcs are taken until an
arc for the word is found, and the weights on the way are added up.

The automaton of a large corpus fits no worker. Texts are dealt into blocks by hash; each block asks for the counts of its own
words, pairs and trigrams and builds the part of the automaton that its texts can reach, which gives the same scores. Requests
and answers travel packed, by hash buckets: first words, then pairs by their first word, then trigrams by their first two
words, in ``passes`` passes, each freeing its shuffle. Contexts so frequent that their followers would fill a bucket are
spread over several. The trigrams of a pair that stands in one block only are counted there and do not travel. All counts are
over all training texts, without pruning. Words and contexts are told apart by 64-bit hashes (XXH64).

Edge cases: null and empty texts are one end token; without training texts every probability is 1; repeated rows count as
often as they stand and score alike (rows that repeat id and text share a block); null ids are kept; an empty table gives an
empty result; only doc_id is carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import common

BLOCK, BUCKET, PASSES = 3_000_000, 1_500_000, 2
U = np.uint64
START, END = U(0x5BD1E9955BD1E995), U(0x27D4EB2F27D4EB2F)
_ANSWER = "block long, bucket int, packed binary, tokens long, types long, ones long, twos long"
_REQUEST = "bucket int, block long, packed binary"
Hot = tuple[np.ndarray, np.ndarray]


def pair_hash(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context and the word after it, which is the next order's context."""
    return common.mix(common.mix(first) * U(0x9FB21C651E98DF25) + word)


class Block:
    """The tokens of a block: its distinct words, pairs and trigrams, which of them stand at each position, and how often in
    training texts."""

    def __init__(self, texts: pa.Array, train: np.ndarray, order: int = 3):
        t = common.Texts(pa.RecordBatch.from_arrays([texts], ["text"]), "text")
        buf = common.LOWER[t.buf]
        starts, ends = common.spans(buf, common.PLAIN)
        at = np.searchsorted(starts, t.at)
        count = np.diff(at)
        self.size = count + 1
        self.first = np.cumsum(self.size) - self.size
        n = len(starts) + len(t)
        hashed = np.full(n, END, U)
        hashed[np.arange(len(starts)) + np.repeat(np.arange(len(t)), count)] = common.hashes(buf, starts, ends)
        trained = np.repeat(train, self.size)
        self.word, self.of_word = np.unique(hashed, return_inverse=True)
        self.word_count = np.bincount(self.of_word[trained], minlength=len(self.word))
        if order < 2:
            return
        many = len(self.word)
        self.context = np.append(self.word, START)
        before = np.empty(n, np.int64)
        before[1:] = self.of_word[:-1]
        before[self.first] = many
        key, self.of_pair = np.unique(before * many + self.of_word, return_inverse=True)
        self.left, self.right = key // many, key % many
        self.pair_count = np.bincount(self.of_pair[trained], minlength=len(key))
        if order < 3:
            return
        inner = np.ones(n, bool)  # positions that have two words, or the start and a word, before them
        inner[self.first] = False
        place = np.flatnonzero(inner)
        key, of = np.unique(self.of_pair[place - 1] * many + self.of_word[place], return_inverse=True)
        self.of_tri = np.full(n, -1, np.int64)
        self.of_tri[place] = of
        self.tri_left, self.tri_right = key // many, key % many
        self.tri_count = np.bincount(of[trained[place]], minlength=len(key))
        self.pair = pair_hash(self.context[self.left], self.word[self.right])

    def word_order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The words by bucket, and where each bucket begins."""
        bucket = (self.word % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


class Grams:
    """Some grams of a block (a context and a word each) dealt to buckets. An entry is a context, or a part of a hot one.
    hot: hashes of contexts, ascending, and their numbers of parts."""

    def __init__(self, context: np.ndarray, left: np.ndarray, word: np.ndarray, some: np.ndarray, buckets: int, hot: Hot):
        """context: hashes; left: the context of each gram; word: the hash of each gram's word; some: numbers of grams."""
        self.buckets = buckets
        self.own, of = np.unique(left[some], return_inverse=True)  # contexts that are asked for
        hashed = context[self.own]
        parts = np.ones(len(hashed), np.int64)
        if len(hot[0]) and len(hashed):
            at = np.minimum(np.searchsorted(hot[0], hashed), len(hot[0]) - 1)
            parts = np.where(hot[0][at] == hashed, hot[1][at], 1)
        first = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(parts)), parts)
        bucket = ((hashed[owner] >> U(20)).astype(np.int64) + np.arange(len(owner)) - first[owner]) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        entry = place[first[of] + (word[some] >> U(8)).astype(np.int64) % parts[of]]
        by = np.argsort(entry, kind="stable")
        self.context, self.hashed = self.own[owner[order]], hashed[owner[order]]
        self.at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.grams, self.begin = some[by], np.searchsorted(entry[by], np.arange(len(order) + 1))

    def requests(self, word: np.ndarray, count: np.ndarray) -> list[tuple[int, bytes]]:
        found = []
        for k in range(self.buckets):
            lo, hi = self.at[k], self.at[k + 1]
            if lo < hi:
                own = self.grams[self.begin[lo] : self.begin[hi]]
                found.append((k, common.pack([self.hashed[lo:hi], *common.small(np.diff(self.begin[lo : hi + 1])), word[own], *common.small(count[own])])))
        return found

    def read(self, answers: dict[int, bytes], followers: np.ndarray, count: np.ndarray, alone: np.ndarray) -> None:
        """Fills in followers of contexts, and counts of grams and whether they stand in this block only."""
        for k in range(self.buckets):
            lo, hi = self.at[k], self.at[k + 1]
            if lo < hi:
                a = common.unpack(answers[k])
                own = self.grams[self.begin[lo] : self.begin[hi]]
                np.add.at(followers, self.context[lo:hi], common.unsmall(a[0], a[1]))
                count[own] = common.unsmall(a[2], a[3])
                alone[own] = np.unpackbits(a[4], count=len(own)).astype(bool)


def _opened(table: pa.Table, order: int = 3) -> Block:
    return Block(table.column("text").combine_chunks(), table.column("train").to_numpy().astype(bool), order)


def _requests(block: pa.Scalar, found: list[tuple[int, bytes]]) -> pa.Table:
    bucket, packed = zip(*found) if found else ((), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([block.as_py()] * len(found), pa.int64()), "packed": pa.array(packed, pa.binary())})


def _answers(table: pa.Table, packed: list[bytes], summary: bytes, totals: list[int]) -> pa.Table:
    """The answers to the requests of a bucket, and a last row (without a block) of the bucket's totals."""
    n = len(packed)
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()), "bucket": pa.array([*table.column("bucket").to_pylist(), None], pa.int32()),
        "packed": pa.array([*packed, summary], pa.binary()), **{c: pa.array([None] * n + [int(x)], pa.int64()) for c, x in zip(("tokens", "types", "ones", "twos"), totals)},
    })


def ask_words(buckets: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        b = _opened(table, 1)
        order, at = b.word_order(buckets)
        return _requests(key[0], [(k, common.pack([b.word[x], *common.small(b.word_count[x])])) for k in range(buckets) if len(x := order[at[k] : at[k + 1]])])

    return work


def answer_words(hot: int):
    """hot: from which count on a word is reported."""

    def work(table: pa.Table) -> pa.Table:
        asked = [common.unpack(p) for p in table.column("packed").to_pylist()]
        word, of = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        count = np.zeros(len(word), np.int64)
        np.add.at(count, of, np.concatenate([common.unsmall(*a[1:]) for a in asked]))
        cuts = np.cumsum([len(a[0]) for a in asked])[:-1]
        often = count >= hot
        return _answers(table, [common.pack(common.small(x)) for x in np.split(count[of], cuts)], common.pack([word[often], count[often]]), [count.sum(), (count > 0).sum(), (count == 1).sum(), (count == 2).sum()])

    return work


def pairs_of(b: Block, buckets: int, hot: Hot) -> Grams:
    return Grams(b.context, b.left, b.word[b.right], np.arange(len(b.left)), buckets, hot)


def ask_pairs(buckets: int, hot: Hot):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        b = _opened(table, 2)
        return _requests(key[0], pairs_of(b, buckets, hot).requests(b.word[b.right], b.pair_count))

    return work


def answer_grams(hot: int):
    """Counts of grams and numbers of followers of contexts, over all blocks. hot: from which count on a gram is reported.
    Requests without a block hold totals of grams that do not travel."""

    def work(table: pa.Table) -> pa.Table:
        more = np.zeros(4, np.int64)
        for p in table.filter(pc.is_null(table.column("block"))).column("packed").to_pylist():
            more += common.unpack(p)[0].astype(np.int64)
        table = table.filter(pc.is_valid(table.column("block")))
        asked = [common.unpack(p) for p in table.column("packed").to_pylist()]
        table = table.select(["block", "bucket"])
        if not asked:
            return _answers(table, [], common.pack([np.zeros(0, U), np.zeros(0, np.int64)]), more.tolist())
        contexts, of_context = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        many = [common.unsmall(a[1], a[2]) for a in asked]
        context = np.repeat(of_context, np.concatenate(many))
        key = pair_hash(contexts[context], np.concatenate([a[3] for a in asked]))
        distinct, first, of = np.unique(key, return_index=True, return_inverse=True)
        count = np.zeros(len(distinct), np.int64)
        np.add.at(count, of, np.concatenate([common.unsmall(a[4], a[5]) for a in asked]))
        alone = np.bincount(of, minlength=len(distinct)) == 1  # a block asks once for each of its grams
        followers = np.bincount(context[first[count > 0]], minlength=len(contexts))
        cuts = np.cumsum([len(a[3]) for a in asked])[:-1]
        by_entry = np.split(followers[of_context], np.cumsum([len(a[0]) for a in asked])[:-1])
        packed = [common.pack([*common.small(x), *common.small(y), np.packbits(z)]) for x, y, z in zip(by_entry, np.split(count[of], cuts), np.split(alone[of], cuts))]
        often = count >= hot
        totals = np.array([count.sum(), (count > 0).sum(), (count == 1).sum(), (count == 2).sum()]) + more
        return _answers(table, packed, common.pack([distinct[often], count[often]]), totals.tolist())

    return work


class Counted:
    """What a block has been told about its pairs."""

    def __init__(self, b: Block, answers: dict[int, bytes], buckets: int, hot: Hot):
        self.followers, self.count, self.alone = np.zeros(len(b.context), np.int64), np.zeros(len(b.left), np.int64), np.zeros(len(b.left), bool)
        pairs_of(b, buckets, hot).read(answers, self.followers, self.count, self.alone)
        seen = (self.count > 0) & (b.word[b.right] != END)
        self.open, self.closed = seen & ~self.alone, seen & self.alone  # contexts of trigrams: asked for, and known here

    def asked(self, b: Block, part: int, passes: int) -> np.ndarray:
        """The trigrams that a pass asks for."""
        own = (b.pair >> U(7)) % U(passes) == U(part)
        return np.flatnonzero((self.open & own)[b.tri_left])

    def trigrams(self, b: Block, part: int, passes: int, buckets: int, hot: Hot) -> Grams:
        return Grams(b.pair, b.tri_left, b.word[b.tri_right], self.asked(b, part, passes), buckets, hot)


def _by_bucket(table: pa.Table, kind: str) -> dict[int, bytes]:
    return {b: p for k, b, p in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "packed"))) if k == kind}


def ask_trigrams(part: int, passes: int, buckets: tuple[int, int], hot: Hot, hot_pairs: Hot):
    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        b = _opened(left)
        counted = Counted(b, _by_bucket(right, "p"), buckets[0], hot)
        out = [_requests(key[0], counted.trigrams(b, part, passes, buckets[1], hot_pairs).requests(b.word[b.tri_right], b.tri_count))]
        if part == 0:  # trigrams that stand in this block only, as totals
            own = b.tri_count[counted.closed[b.tri_left]]
            totals = np.array([own.sum(), (own > 0).sum(), (own == 1).sum(), (own == 2).sum()], np.int64)
            out.append(pa.table({"bucket": pa.array([key[0].as_py() % buckets[1]], pa.int32()), "block": pa.array([None], pa.int64()), "packed": pa.array([common.pack([totals])], pa.binary())}))
        return pa.concat_tables(out)

    return work


@dataclass(frozen=True)
class Totals:
    tokens: int
    types: int
    ones: int
    twos: int

    def discount(self) -> float:
        return min(max(self.ones / (self.ones + 2 * self.twos), 0.1), 0.95) if self.ones else 0.5


def _log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


class Automaton:
    """The part of the automaton that a block's texts can reach. Weights are log10. States: 0 is the root, then come the
    contexts of one word, then those of two."""

    def __init__(self, b: Block, word_count: np.ndarray, pairs: Counted, tri_count: np.ndarray, tri_followers: np.ndarray, totals: tuple[Totals, Totals, Totals]):
        words, d1, d2, d3 = totals[0], *(t.discount() for t in totals)
        n = max(words.tokens, 1)
        unseen = d1 * words.types / n if words.types else 1.0
        one = np.where(word_count > 0, np.maximum(word_count - d1, 0) / n, unseen)
        end = np.searchsorted(b.word, END)  # as many starts as ends
        count = np.append(word_count, word_count[end] if end < len(b.word) and b.word[end] == END else 0)
        mass = np.where(count > 0, d2 * pairs.followers / np.maximum(count, 1), 1.0)
        two = np.maximum(pairs.count - d2, 0) / np.maximum(count[b.left], 1) + mass[b.left] * one[b.right]
        rest = np.where(pairs.count > 0, d3 * tri_followers / np.maximum(pairs.count, 1), 1.0)
        lower = two[self._pair_of(b)] if len(b.tri_left) else np.zeros(0)
        three = np.maximum(tri_count - d3, 0) / np.maximum(pairs.count[b.tri_left], 1) + rest[b.tri_left] * lower
        self.contexts = len(b.context)
        self.known_word, self.known_pair, self.known_tri = word_count > 0, pairs.count > 0, tri_count > 0
        self.root, self.arc2, self.arc3 = _log10(one), _log10(two), _log10(three)
        self.fail2, self.fail3 = _log10(mass), _log10(rest)
        self.start = 1 + len(b.word) if count[-1] > 0 else 0

    @staticmethod
    def _pair_of(b: Block) -> np.ndarray:
        """Of each trigram the pair of its last two words."""
        out = np.empty(len(b.tri_left), np.int64)
        there = np.flatnonzero(b.of_tri >= 0)
        out[b.of_tri[there]] = b.of_pair[there]
        return out

    def traverse(self, b: Block) -> np.ndarray:
        """The log10 probability of each text, read once from left to right with the state carried along."""
        word, pair, tri = b.of_word.tolist(), b.of_pair.tolist(), b.of_tri.tolist()
        root, arc2, arc3, fail2, fail3 = (x.tolist() for x in (self.root, self.arc2, self.arc3, self.fail2, self.fail3))
        known_word, known_pair, known_tri = self.known_word.tolist(), self.known_pair.tolist(), self.known_tri.tolist()
        shorter = (b.right + 1).tolist()  # where a pair's state fails to: its last word's
        deep = 1 + self.contexts
        out = np.zeros(len(b.first))
        for k, (begin, size) in enumerate(zip(b.first.tolist(), b.size.tolist())):
            state, total = self.start, 0.0
            for i in range(begin, begin + size):
                p = pair[i]
                if state >= deep:
                    t = tri[i]
                    if known_tri[t]:
                        total += arc3[t]
                        state = deep + p
                        continue
                    total += fail3[state - deep]
                    state = shorter[state - deep]
                if state:
                    if known_pair[p]:
                        total += arc2[p]
                        state = deep + p
                        continue
                    total += fail2[state - 1]
                w = word[i]
                total += root[w]
                state = w + 1 if known_word[w] else 0
            out[k] = total
        return out


def _finish(passes: int, buckets: tuple[int, int, int], hot: Hot, hot_pairs: Hot, totals: tuple[Totals, Totals, Totals]):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _opened(left)
        order, at = b.word_order(buckets[0])
        told, word_count = _by_bucket(right, "w"), np.zeros(len(b.word), np.int64)
        for k in range(buckets[0]):
            if at[k] < at[k + 1]:
                word_count[order[at[k] : at[k + 1]]] = common.unsmall(*common.unpack(told[k]))
        counted = Counted(b, _by_bucket(right, "p"), buckets[1], hot)
        tri_count, followers, alone = np.zeros(len(b.tri_left), np.int64), np.zeros(len(b.left), np.int64), np.zeros(len(b.tri_left), bool)
        for part in range(passes):
            counted.trigrams(b, part, passes, buckets[2], hot_pairs).read(_by_bucket(right, f"t{part}"), followers, tri_count, alone)
        here = counted.closed[b.tri_left]
        tri_count[here] = b.tri_count[here]
        np.add.at(followers, b.tri_left[here & (b.tri_count > 0)], 1)
        words = totals[0]
        score = Automaton(b, word_count, counted, tri_count, followers, totals).traverse(b)
        base = np.log10((word_count + 1) / (words.tokens + words.types + 1))[b.of_word]
        known = (word_count > 0)[b.of_word]
        sums = {"n_known": np.add.reduceat(known.astype(np.int64), b.first), "base_score": np.add.reduceat(base, b.first)}
        common.trim()
        return pa.table({"doc_id": left.column("doc_id"), "train": left.column("train"), "n_tokens": pa.array(b.size), **{k: pa.array(v) for k, v in sums.items()}, "score": pa.array(score)})

    return work


def _hot(reported: DataFrame, least: int, most: int, every: int) -> Hot:
    """Hashes (ascending) and numbers of parts of the contexts that stand so often. There are fewer than a fourth as many as
    buckets."""
    found = [common.unpack(bytes(r[0])) for r in reported.where(f"block is null and tokens >= {least}").select("packed").collect()]
    hash_, count = (np.concatenate([np.zeros(0, U), *(x[i] for x in found)]) for i in (0, 1))
    ends = count[hash_ == END]  # as many texts start as end
    hash_, count = np.append(hash_, np.full(len(ends), START, U)), np.append(count, ends)
    order = np.argsort(hash_)
    return hash_[order], np.minimum(1 + (count[order] * U(most) // U(max(every, 1))).astype(np.int64), most)


def score(docs: DataFrame, train: Column, column: str = "text", block_bytes: int = BLOCK, bucket_size: int = BUCKET, passes: int = PASSES) -> DataFrame:
    """One row for each document: doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score.
    train says which rows are learnt from."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(column), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))
    size, number = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)), F.count(F.lit(1))).head()
    every = size // 6 + number  # about as many tokens; only sizes of buckets depend on it
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // block_bytes))))
    blocks = rows.withColumn("block", block)
    buckets = tuple(max(1, -(-every // (n * bucket_size))) for n in (6, 2, 2 * passes))  # a block's words and grams are fewer than its tokens
    least = [max(4 * every // n, 1) for n in buckets[1:]]

    def totals(df: DataFrame) -> Totals:
        return Totals(*df.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "ones", "twos"))).head())

    def kind(df: DataFrame, k: str) -> DataFrame:
        return df.where("block is not null").select("block", F.lit(k).alias("kind"), "bucket", "packed")

    word_answers = common.stored(blocks.groupBy("block").applyInArrow(ask_words(buckets[0]), _REQUEST).groupBy("bucket").applyInArrow(answer_words(least[0]), _ANSWER), "words")
    common.release(spark)
    words, hot = totals(word_answers), _hot(word_answers, least[0], buckets[1], every)
    pair_answers = common.stored(blocks.groupBy("block").applyInArrow(ask_pairs(buckets[1], hot), _REQUEST).groupBy("bucket").applyInArrow(answer_grams(least[1]), _ANSWER), "pairs")
    common.release(spark)
    pairs, hot_pairs = totals(pair_answers), _hot(pair_answers, least[1], buckets[2], every)
    answers, tri = kind(word_answers, "w").unionAll(kind(pair_answers, "p")), []
    for part in range(passes):
        asked = blocks.groupBy("block").cogroup(kind(pair_answers, "p").groupBy("block")).applyInArrow(ask_trigrams(part, passes, buckets[1:], hot, hot_pairs), _REQUEST)
        tri.append(common.stored(asked.groupBy("bucket").applyInArrow(answer_grams(1 << 62), _ANSWER), "trigrams"))
        answers = answers.unionAll(kind(tri[-1], f"t{part}"))
        del asked
        common.release(spark)
    third = [totals(t) for t in tri]
    all_tri = Totals(*(sum(getattr(t, f) for t in third) for f in ("tokens", "types", "ones", "twos")))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, train boolean, n_tokens long, n_known long, base_score double, score double"
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(passes, buckets, hot, hot_pairs, (words, pairs, all_tri)), schema)
    return out.withColumn("train_tokens", F.lit(words.tokens).cast("long"))
