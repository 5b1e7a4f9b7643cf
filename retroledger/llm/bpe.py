"""BPE encoding and decoding by batched numpy merge rounds.

A vocabulary file (byte-level BPE in the tokenizers JSON layout) becomes arrays: merge pairs as sorted integer keys
with their ranks and results, and the bytes of every id. The distinct words of many texts lie in one flat array of
symbols. Each round looks up all neighbouring pairs by binary search over the sorted keys, takes the lowest rank in
each word, and joins every place of that pair (leftmost first), until no word has a pair left. A word of over ``LONG`` bytes
(a run of letters without a break) would take a round for each rank in it, so its pairs are kept in a queue by rank and place
instead, and the work stays near linear. Texts are cut into words first, by the pattern of the byte-level pre-tokenizer;
added tokens are cut out before that.

Edge cases: null or empty text gives no ids and the empty text; very long texts are handled whole, one at a time;
repeated rows are encoded alike; an empty table gives an empty result; other columns of the input pass through except
those whose names the result uses.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Fixed: the pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Python's \s also holds the four separators x1c-x1f, which are no white space in Unicode.
_PATTERN = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\p{White_Space}\p{L}\p{N}])").replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})").replace(r"|\s+", r"|\p{White_Space}+"))
#: Words whose ids a worker keeps at most; beyond it starts anew.
CACHE = 100_000
LONG = 2_000
NONE = np.int64(1 << 62)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The arrays made from a vocabulary file; small (a few MB) and of fixed size, so it goes to all workers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.shift = np.int64(size)
        key = left * self.shift + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] | None = None  # made when a long word comes
        spelled: list[bytes] = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            spelled[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one word after another, and the number of ids of each."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._rounds(words)
        ids, count = self._rounds([b"" if len(w) > LONG else w for w in words])
        parts = np.split(ids, np.cumsum(count)[:-1])
        for i in long:
            parts[i] = self._queued(words[i])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _queued(self, word: bytes) -> np.ndarray:
        """The ids of one long word: the pair of lowest rank, leftmost first, is joined until none is left."""
        if self.pairs is None:
            left, right = np.divmod(self.key, self.shift)
            self.pairs = dict(zip(zip(left.tolist(), right.tolist()), zip(self.rank.tolist(), self.made[self.rank].tolist())))
        pairs, symbol = self.pairs, self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(*found, i, a, b) for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (found := pairs.get((a, b)))]
        queue = [(rank, i, made, a, b) for rank, made, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = behind[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been joined meanwhile
            symbol[i], symbol[j] = made, -1
            k = behind[i] = behind[j]
            if k < n:
                before[k] = i
                if found := pairs.get((made, symbol[k])):
                    heapq.heappush(queue, (found[0], i, found[1], made, symbol[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbol[h], made))):
                heapq.heappush(queue, (found[0], h, found[1], symbol[h], made))
        return np.array([x for x in symbol if x >= 0], np.int64)

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            key = symbol[:-1] * self.shift + symbol[1:]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where((self.key[place] == key) & (word[:-1] == word[1:]), self.rank[place], NONE)
            rank = np.append(rank, NONE)
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(head, len(word)))
            lowest = np.minimum.reduceat(rank, head)
            whole = lowest == NONE
            if whole.any():
                out = np.repeat(whole, count)
                done.append((word[out], symbol[out]))
            each = np.repeat(lowest, count)
            here = (rank == each) & (each != NONE)
            at = np.flatnonzero(here)
            if len(at):  # of places that overlap, such as in a a a, every second one from the left
                run = np.cumsum(np.append(True, np.diff(at) != 1)) - 1
                first = at[np.append(True, np.diff(at) != 1)]
                at = at[(at - first[run]) % 2 == 0]
                symbol[at] = self.made[rank[at]]
            keep = np.repeat(~whole, count)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts with a vocabulary; keeps the ids of words that it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and the number of ids of each."""
        if len(self.known) > CACHE:
            self.clear()
        parts: list[str] = []
        ends = []
        for text in batch:
            if self.split is not None and any(t in text for t in self.v.added):
                for i, piece in enumerate(self.split.split(text)):
                    parts += [(piece,)] if i % 2 else _PATTERN.findall(piece)
            else:
                parts += _PATTERN.findall(text)
            ends.append(len(parts))
        known = self.known
        new = [w for w in dict.fromkeys(parts) if w not in known]
        if new:
            plain = [w for w in new if isinstance(w, str)]
            ids, count = self.v.merge([w.encode() for w in plain]) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            special = [w for w in new if not isinstance(w, str)]
            ids = np.concatenate([ids, np.array([self.v.added[w[0]] for w in special], np.int64)])
            count = np.concatenate([count, np.ones(len(special), np.int64)])
            known.update(zip([*plain, *special], range(len(known), len(known) + len(new))))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
        index = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        count = self.count[index]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.ids[common.expand(self.start[index], count)], np.diff(total[np.array([0, *ends])])


def decoded(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become the replacement character."""
    return v.bytes[common.expand(v.start[ids], v.length[ids])].tobytes().decode("utf-8", "replace")


def _others(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def encode(docs: DataFrame, path: str, column: str = "text", carry: bool = True, packed: bool = False, decoded_to: str | None = None) -> DataFrame:
    """docs with ``ids``: the token ids of each whole text (array<int>; packed: as little-endian 32-bit numbers in one
    binary value), by the vocabulary file at path. decoded_to: a column for the text that the ids give back.

    The file is read on the driver and its arrays are broadcast (their size is that of the vocabulary). Without carry the result lacks the text."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    rest = _others(docs, "ids", decoded_to or "ids", *([] if carry else [column]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for t in common.texts(batches, column, limit=500_000):
            ids, count = encoder.encode([x or "" for x in t.rows.column(column).to_pylist()])
            ends = np.cumsum(count)
            if packed:
                lists = pa.array([x.tobytes() for x in np.split(ids.astype("<u4"), ends[:-1])], pa.binary())
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
            made = [lists] if decoded_to is None else [lists, pa.array([decoded(shared.value, x) for x in np.split(ids, ends[:-1])], pa.string())]
            yield pa.RecordBatch.from_arrays([*(t.rows.column(c) for c in rest), *made], [*rest, "ids", *([decoded_to] if decoded_to else [])])

    return docs.mapInArrow(work, common.added(docs.select(*rest), ids="binary" if packed else "array<int>", **({decoded_to: "string"} if decoded_to else {})))


def decode(df: DataFrame, path: str, to: str = "decoded") -> DataFrame:
    """df with the text that its ``ids`` stand for; null ids give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    rest = _others(df, to)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = [decoded(shared.value, np.array(x.values if x.is_valid else [], np.int64)) for x in rows.column("ids")]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), pa.array(made, pa.string())], [*rest, to])

    out = df.select(*rest)
    return out.mapInArrow(work, common.added(out, **{to: "string"}))
