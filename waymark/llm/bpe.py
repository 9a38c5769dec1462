"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Every task gathers the distinct pre-tokens of its share of the corpus, lays all of those that it has not met before
them out in one symbol list, and keeps an inverted index from a mergeable pair (named by
the rank of its merged token) to the positions where it stands. Merges are then replayed in rank order over all
words at once; a merge touches only the two neighbours of each position it changes.
Words are encoded once and kept, up to WORDS_KEPT of them, for the task's texts that follow; documents are put together from them.

Defined results: a null text counts as empty and gives no ids; an empty table gives an
empty table; equal texts give equal ids; a word of any length is merged in
O(n log n); only the named id column and the text are read, so clashing extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import give_back_memory, text_batches

#: Texts are taken together up to about this many characters before merges are replayed.
CHUNK_CHARS = 4_000_000
#: Words that a task keeps with their ids before it begins anew. They go with the task: a worker that kept them would hold them through other stages.
WORDS_KEPT = 200_000
ID_BITS = 32


class MergeReplay:
    """Merge replay over many words. ranks: token bytes to id, lower merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << ID_BITS) | right)
                    merged.append(i)
        keys, merged = np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], merged[order]
        left, right = keys >> ID_BITS, keys & ((1 << ID_BITS) - 1)
        #: Tokens that can join a token of lower rank: their occurrences are merged one at a time in each word.
        self.one_by_one = set(left[merged < left].tolist()) | set(right[merged < right].tolist())

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair gives, -1 if there is none; negative symbols give none."""
        key = (left.astype(np.int64) << ID_BITS) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after another, and the offsets where each word's begin (one more than words)."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1  # a gap after each word: nothing merges across
        n = int((sizes + 1).sum())
        sym = np.full(n + 1, -1, dtype=np.int32)
        inside = np.ones(n, dtype=bool)
        inside[starts + sizes] = False
        sym[:n][inside] = self.byte_id[flat]
        del inside, flat
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes + 1)
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[n] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            """Put pairs into the inverted index."""
            keep = ranks >= 0
            ranks, places = ranks[keep], places[keep]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            ends = [*cuts.tolist(), len(ranks)]
            begin = 0
            for r, end in zip(ranks[np.concatenate(([0], cuts))].tolist(), ends, strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(places[begin:end])
                begin = end

        def merge(r: int, p: np.ndarray) -> None:
            """Merge the pairs at p into r and index the pairs with the neighbours."""
            q = nxt[p]
            after = nxt[q]
            sym[p], sym[q] = r, -2
            nxt[p] = after
            prv[after] = p
            before = prv[p]
            left = np.where(before >= 0, sym[before], -1)
            merged = np.full(len(p), r, dtype=np.int32)
            add(np.concatenate((self._ranks_of(left, merged), self._ranks_of(merged, sym[after]))), np.concatenate((before, p)))

        for a in range(0, n, 500_000):
            b = min(n, a + 500_000)
            add(self._ranks_of(sym[a:b], sym[a + 1 : b + 1]), np.arange(a, b, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            p = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
            p = p[self._ranks_of(sym[p], sym[nxt[p]]) == r]  # else a neighbour has merged meanwhile
            if not len(p):
                continue
            p.sort()
            if r in self.one_by_one:  # the first of each word now; a pair of lower rank may come before the next
                first = np.ones(len(p), dtype=bool)
                first[1:] = word[p[1:]] != word[p[:-1]]
                merge(r, p[first])
                if not first.all():
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(p[~first])
                continue
            touching = nxt[p[:-1]] == p[1:]
            if touching.any():  # overlapping occurrences: the leftmost wins
                keep, last = [], -1
                for x, y in zip(p.tolist(), nxt[p].tolist(), strict=True):
                    if x != last:
                        keep.append(x)
                        last = y
                p = np.array(keep, dtype=np.int32)
            merge(r, p)
        alive = sym[:n] >= 0
        ids = sym[:n][alive]
        before_word = np.concatenate(([0], np.cumsum(alive)))
        return ids, np.append(before_word[starts], len(ids))


_replays: dict[str, MergeReplay] = {}


def _load(vocab_path: str) -> MergeReplay:
    """The replay of a rank file, kept by the Python worker."""
    if vocab_path not in _replays:
        with open(vocab_path, "rb") as f:
            _replays[vocab_path] = MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    return _replays[vocab_path]


def _split_pattern(pattern: str):
    import regex

    # \s of the pattern's own engine is Unicode White_Space
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class _Words:
    """The words that a task has met, each encoded once. Texts wait as sequences of word numbers until their new words are encoded together."""

    def __init__(self, replay: MergeReplay, pattern):
        self.replay, self.pattern = replay, pattern
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        self.texts: list[np.ndarray] = []
        self.chars = 0

    def add(self, text: str | None) -> None:
        number = self.number
        words = self.pattern.findall(text) if text else []
        self.texts.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32))
        self.chars += len(text or "")

    def encoded(self) -> list[bytes]:
        """Packed little-endian uint32 ids of each waiting text."""
        new = list(islice(self.number, len(self.offsets) - 1, None))
        if new:
            ids, offsets = self.replay.encode_words([w.encode() for w in new])
            self.offsets = np.concatenate((self.offsets, offsets[1:] + self.offsets[-1]))
            self.ids = np.concatenate((self.ids, ids.astype("<u4")))
        sizes, out = np.diff(self.offsets), []
        for t in self.texts:
            k = sizes[t]
            out.append(self.ids[np.repeat(self.offsets[t] - (np.cumsum(k) - k), k) + np.arange(k.sum())].tobytes())
        self.texts, self.chars = [], 0
        if len(self.number) > WORDS_KEPT or len(self.ids) > 8 * WORDS_KEPT:
            self.forget()
        return out


def encode_texts(texts: list[str | None], vocab_path: str, pattern: str) -> list[bytes]:
    """Packed ids of a list of texts, whose words are encoded together."""
    words = _Words(_load(vocab_path), _split_pattern(pattern))
    for t in texts:
        words.add(t)
    return words.encoded()


def _encoder(vocab_path: str, pattern: str, make):
    """A function over batches (id, text) that gives make(id column, packed ids of each text) for the texts in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = _Words(_load(vocab_path), _split_pattern(pattern)), []

        def results():
            packed, at = words.encoded(), 0
            for column in held:
                yield make(column, packed[at : at + len(column)])
                at += len(column)

        for b in batches:
            for x in b.column(1):
                words.add(x.as_py())
            held.append(b.column(0))
            if words.chars >= CHUNK_CHARS:
                yield from results()
                held = []
        if held:
            yield from results()
        del words
        give_back_memory()

    return run


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): ids is the packed little-endian uint32 sequence of the text's token ids."""
    text_batches(docs)
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    run = _encoder(vocab_path, pattern, lambda i, packed: pa.RecordBatch.from_arrays([i, pa.array(packed, pa.binary())], names=[id_col, "ids"]))
    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, ids binary")


def _decoded(packed: bytes | None, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist())) if packed else b""


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decoded): decoded holds the bytes that the ids stand for. Null ids give no bytes."""
    src = encoded.select(F.col(id_col), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _load(vocab_path).tokens
        for b in batches:
            got = [_decoded(x, tokens) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=[id_col, "ids", "decoded"])

    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, ids binary, decoded binary")


def digests(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, and decoded from the packed ids, in one pass of one worker a task."""
    text_batches(docs)
    src = docs.select("doc_id", F.col("text").cast("string").alias("__text"))

    def both(i, packed: list[bytes]) -> pa.RecordBatch:
        tokens = _load(vocab_path).tokens
        columns = [i, pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([sha256(x).hexdigest() for x in packed], pa.string()), pa.array([sha256(_decoded(x, tokens)).hexdigest() for x in packed], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(_encoder(vocab_path, pattern, both), f"doc_id {dict(src.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
