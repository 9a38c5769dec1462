"""Language-model scoring by deleted interpolation.

P(w | v) = l2(b) c(v w)/c(v) + l1(b) c(w)/N + l0(b) / (V + 1): maximum-likelihood estimates of order two, one and
zero, mixed by weights that depend on the bucket b of the context's frequency c(v). A fold of the training documents is held
out ("deleted"): the estimates without it are mixed on its counts by expectation-maximisation. Then
all training documents give the final counts.

Layout: documents are dealt by hash into blocks of about BLOCK_BYTES of text (copies of one row apart, a long text whole), packed, compressed and written once. A block sends each distinct
n-gram (sorted, as compressed differences) once, with its counts, to the ranges of the key space. Up to FANOUT blocks, a
range adds up all blocks and answers each with the totals, in the block's own order, so that answers carry no keys. Of more blocks, groups
of up to FANOUT are added up first, range by range; a group's ranges send on what they have added up, in finer ranges, to a group of
groups, and answers come back the same way. A block or range so sends at most FANOUT rows a level, and rows grow
as the corpus (times the number of levels), not as its square; no task holds more than a bounded share. All counts cover all documents.

N-grams are told apart by 63 bits of a hash: two of them may fall together once there are some billions of distinct ones, which then share a count.

Defined results: a null text counts as empty: one end token; equal texts get equal scores; without training
documents all probability is l0's; repeated rows are documents of their own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import groups_for, id_remainder, materialize, text_or_empty

BLOCK_BYTES = 5_000_000
#: Rows that a block or range sends at one level, at most.
FANOUT = 256
#: Context-frequency buckets: 0 unseen, then powers of two.
BUCKETS = 24
#: Steps of log2 of a probability that the held-out counts tell apart.
GRID = 8
#: Expectation-maximisation stops when a step adds less than this to the log-likelihood of a held-out token, or after EM_STEPS.
EM_TOLERANCE = 1e-8
EM_STEPS = 20_000
#: Training documents whose remainder modulo 7 is this one are held out for the weights.
HELD_REMAINDER = 3
TEST_REMAINDER = 2
END, START = b"\n", b"\t"  # no word holds white space
WORDS_KEPT = 250_000

_words: dict[bytes, int] = {}


def _word_key(w: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(w) & ~1


def _ids(text: str | None) -> np.ndarray:
    """Keys of the words of a text and of its end; even numbers."""
    if len(_words) > WORDS_KEPT:
        _words.clear()
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and the six ASCII white spaces
    words.append(END)
    try:
        return np.array([_words[w] for w in words], dtype=np.uint64)
    except KeyError:
        for w in words:
            if w not in _words:
                _words[w] = _word_key(w)
        return np.array([_words[w] for w in words], dtype=np.uint64)


_START = np.uint64(_word_key(START))


def _pairs(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of bigrams; odd numbers."""
    x = (v ^ (v >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def _squeeze(a: np.ndarray) -> bytes:
    """Compressed byte planes of an array of whole numbers."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _expand(b: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def _pack(docs: DataFrame, blocks: int, held_blocks: int) -> DataFrame:
    """(block, held, docs): documents packed by block; held-out documents have the first held_blocks blocks to themselves."""
    h = F.xxhash64("__id", "__text", F.monotonically_increasing_id())  # rows that repeat are dealt out, too
    block = F.when(F.col("__part") == HELD_REMAINDER, F.pmod(h, F.lit(held_blocks))).otherwise(held_blocks + F.pmod(h, F.lit(blocks - held_blocks)))
    src = docs.select(block.cast("int").alias("block"), "__id", "__part", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            block = b.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            names, blobs = [], []
            for rows in np.split(order, cuts):
                if len(rows):
                    part = pa.RecordBatch.from_arrays([b.column(k).take(pa.array(rows)) for k in (1, 2, 3)], names=["id", "part", "text"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                        out.write_batch(part)
                    names.append(block[rows[0]])
                    blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "docs"])

    return src.mapInArrow(run, "block int, docs binary")


def _unpack(blobs) -> Iterator[tuple[object, int, np.ndarray]]:
    """(id, remainder, word keys) of each document, in a fixed order of the blobs."""
    for blob in sorted(blobs):
        with pa.ipc.open_stream(blob) as f:
            for b in f:
                for i, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    yield i, part, _ids(text.as_py())


class _Block:
    """Tokens of a block: its documents one after another."""

    def __init__(self, blobs):
        self.doc_ids, remainders, texts = [], [], []
        for i, part, ids in _unpack(blobs):
            self.doc_ids.append(i)
            remainders.append(part)
            texts.append(ids)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.remainders = np.array(remainders, dtype=np.int8)
        self.words = np.concatenate(texts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        contexts = np.empty_like(self.words)
        contexts[1:] = self.words[:-1]
        contexts[self.starts] = _START
        n = len(self.words)
        self.keys, place = np.unique(np.concatenate((self.words, _pairs(contexts, self.words), np.array([_START]))), return_inverse=True)
        place = place.astype(np.int32)
        del self.words, contexts
        #: Places of each token's word, bigram and context among the keys.
        self.word, self.pair, self.start = place[:n], place[n : 2 * n], int(place[-1])
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = self.start


def _ends(keys: np.ndarray, first: int, last: int, ranges: int) -> list[int]:
    """Ends of the runs of sorted keys in the ranges first to last - 1, of so many equal ranges of the key space."""
    cuts = np.array([((i << 64) + ranges - 1) // ranges for i in range(first + 1, last)], dtype=np.uint64)
    return [*np.searchsorted(keys, cuts).tolist(), len(keys)]


_COUNT = "node int, range long, child int, keys binary, kept binary, held binary"
_TOTAL = "child int, range long, kept binary, held binary, n long, n_kept long, n_words long, n_kept_words long"


def levels_for(blocks: int, fanout: int) -> tuple[int, int]:
    """(levels, fan-out): the least number of levels, and the least fan-out that it needs."""
    levels = 1
    while fanout**levels < blocks:
        levels += 1
    f = 2
    while f**levels < blocks:
        f += 1
    return levels, f


def _sent(keys: np.ndarray, counts: np.ndarray, node: int, child: int, parent: int, fanout: int, ranges: int) -> pd.DataFrame:
    """Rows of a child's sorted keys and counts (two rows of an array) for the fanout ranges within its own range parent."""
    out, a = [], 0
    for k, z in enumerate(_ends(keys, parent * fanout, (parent + 1) * fanout, ranges)):
        if z > a:
            out.append((node, parent * fanout + k, child, _squeeze(np.diff(keys[a:z], prepend=np.uint64(0))), _squeeze(counts[0, a:z].astype(np.uint64)), _squeeze(counts[1, a:z].astype(np.uint64))))
        a = z
    return pd.DataFrame(out, columns=["node", "range", "child", "keys", "kept", "held"])


def _count_blocks(packed: DataFrame, fanout: int) -> DataFrame:
    """Keys and counts of each block for the first level."""

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        block = _Block(b["docs"])
        train = block.remainders != TEST_REMAINDER
        held = block.remainders == HELD_REMAINDER
        counts = np.zeros((2, len(block.keys)), dtype=np.int64)
        for row, docs in ((0, train & ~held), (1, held)):
            tokens = np.repeat(docs, block.sizes)
            for place in (block.word, block.pair):
                counts[row] += np.bincount(place[tokens], minlength=len(block.keys))
            counts[row][block.start] += int(docs.sum())
        return _sent(block.keys, counts, int(key[0]) // fanout, int(key[0]), 0, fanout, fanout)

    return packed.groupBy("block").applyInPandas(run, _COUNT)


def _added(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of the rows of one range, their summed counts, and the places among them of all rows' keys with the ends of the rows."""
    keys = [np.cumsum(_expand(x, np.uint64), dtype=np.uint64) for x in b["keys"]]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.stack([np.bincount(at, weights=np.concatenate([_expand(x, np.uint64) for x in b[c]]), minlength=len(every)).astype(np.int64) for c in ("kept", "held")])
    return every, total, at, np.cumsum([len(k) for k in keys]).tolist()


def _answers(b: pd.DataFrame, total: np.ndarray, at: np.ndarray, ends: list[int]) -> list[tuple]:
    """A row for each child: the totals of its keys in its own order."""
    out, a = [], 0
    for child, r, z in zip(b["child"], b["range"], ends, strict=True):
        own = at[a:z]
        out.append((int(child), int(r), _squeeze(total[0][own].astype(np.uint64)), _squeeze(total[1][own].astype(np.uint64)), 0, 0, 0, 0))
        a = z
    return out


_TOTAL_COLUMNS = ["child", "range", "kept", "held", "n", "n_kept", "n_words", "n_kept_words"]


def _top(counted: DataFrame) -> DataFrame:
    """Answers to the children of the last level; and for each range a row with child -1: training tokens and distinct words, with and without the held-out fold."""

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        every, total, at, ends = _added(b)
        word = (every & np.uint64(1) == 0) & (every != _START)
        both = total[0] + total[1]
        figures = (-1, int(key[0]), b"", b"", int(both[word].sum()), int(total[0][word].sum()), int((both[word] > 0).sum()), int((total[0][word] > 0).sum()))
        return pd.DataFrame([*_answers(b, total, at, ends), figures], columns=_TOTAL_COLUMNS)

    return counted.groupBy("range").applyInPandas(run, _TOTAL)


def _up(counted: DataFrame, fanout: int, ranges: int) -> DataFrame:
    """What the nodes of a level send to the next one."""

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        node, r = int(key[0]), int(key[1])
        every, total, _, _ = _added(b)
        return _sent(every, total, node // fanout, node, r, fanout, ranges)

    return counted.groupBy("node", "range").applyInPandas(run, _COUNT)


def _down(counted: DataFrame, answers: DataFrame, fanout: int) -> DataFrame:
    """Answers to the children of a level from the answers to its nodes."""

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        if not len(l) or not len(r):
            return pd.DataFrame([], columns=_TOTAL_COLUMNS)
        r = r.sort_values("range")
        total = np.stack([np.concatenate([_expand(x, np.uint64) for x in r[c]]) for c in ("kept", "held")])
        _, _, at, ends = _added(l)
        return pd.DataFrame(_answers(l, total, at, ends), columns=_TOTAL_COLUMNS)

    asked = answers.withColumn("node", F.col("child")).withColumn("parent", F.expr(f"range div {fanout}"))
    return counted.groupBy("node", "range").cogroup(asked.groupBy("node", "parent")).applyInPandas(run, _TOTAL)


def _exchange(packed: DataFrame, blocks: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """Answers to all blocks (child, range, kept, held), and the rows of figures."""
    levels, f = levels_for(blocks, fanout)
    sent = _count_blocks(packed, f)
    below = []
    for level in range(1, levels):
        below.append(materialize(sent, "ngram-level"))
        sent = _up(below[-1], f, f ** (level + 1))
    answers = materialize(_top(sent), "ngram-totals")
    figures, answers = answers.filter("child < 0"), answers.filter("child >= 0")
    while below:
        answers = materialize(_down(below.pop(), answers, f), "ngram-answers")
    return answers.withColumnRenamed("child", "block"), figures


def _totals(r: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Totals for a block's keys, without and with the held-out fold."""
    r = r.sort_values("range")
    kept = np.concatenate([_expand(x, np.uint64) for x in r["kept"]]).astype(np.float64)
    return kept, kept + np.concatenate([_expand(x, np.uint64) for x in r["held"]]).astype(np.float64)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(c, 1))) + 1), 0).astype(np.int64)


def _estimates(block: _Block, totals: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context bucket, bigram and unigram estimate, and word count of every token."""
    context, word, pair = (totals[k] for k in (block.context, block.word, block.pair))
    return _bucket(context), np.divide(pair, context, out=np.zeros_like(pair), where=context > 0), word / max(n, 1.0), word


def _held_out(packed: DataFrame, answers: DataFrame, n_kept: int) -> DataFrame:
    """Held-out tokens by context bucket and by grid of the two estimates: bucket, g2, g1, m, p2, p1 (sums)."""

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        if not len(l):
            return pd.DataFrame({c: [] for c in ("bucket", "g2", "g1", "m", "p2", "p1")})
        block = _Block(l["docs"])
        bucket, p2, p1, _ = _estimates(block, _totals(r)[0], n_kept)
        grid = [np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * GRID), 1).astype(np.int64) for p in (p2, p1)]
        t = pd.DataFrame({"bucket": bucket, "g2": grid[0], "g1": grid[1], "m": 1, "p2": p2, "p1": p1})
        return t.groupby(["bucket", "g2", "g1"], as_index=False).sum()

    cells = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "bucket int, g2 int, g1 int, m long, p2 double, p1 double")
    return cells.groupBy("bucket", "g2", "g1").agg(*[F.sum(c).alias(c) for c in ("m", "p2", "p1")])


def fit_weights(cells: pd.DataFrame, p0: float, tolerance: float = EM_TOLERANCE, steps: int = EM_STEPS) -> np.ndarray:
    """Weights (bucket, 3: order two, one, zero) by expectation-maximisation on held-out counts, to convergence."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    for b in range(BUCKETS):
        c = cells[cells["bucket"] == b]
        if not len(c):
            continue
        m = c["m"].to_numpy(dtype=float)
        p = np.stack([c["p2"] / m, c["p1"] / m, np.full(len(c), p0)], axis=1)
        l, share, before = weights[b], m / m.sum(), -np.inf  # noqa: E741
        for _ in range(steps):
            total = p @ l
            l = l * ((share / total) @ p)  # noqa: E741
            now = share @ np.log(total)  # of the weights before this step
            if now - before < tolerance:
                break
            before = now
        l = np.maximum(l, 1e-9)  # noqa: E741
        weights[b] = l / l.sum()
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    part = id_remainder(F.col(id_col), 7)
    rows = docs.select(F.col(id_col).alias("__id"), part.alias("__part"), text_or_empty(F.col(text_col)).alias("__text"))
    kind = dict(rows.dtypes)["__id"]
    size = rows.agg(F.sum(F.octet_length("__text") + 1)).first()[0] or 0
    blocks = max(2, groups_for(size, block_bytes))
    held_blocks = max(1, blocks // 7)
    packed = materialize(_pack(rows, blocks, held_blocks), "lm-blocks")  # three jobs read it; written, a row keeps its block
    answers, figures = _exchange(packed, blocks, fanout)
    n, n_kept, v, v_kept = (int(x or 0) for x in figures.agg(*[F.sum(c) for c in ("n", "n_kept", "n_words", "n_kept_words")]).first())
    cells = _held_out(packed.filter(F.col("block") < held_blocks), answers.filter(F.col("block") < held_blocks), n_kept).toPandas()  # a grid of fixed size
    weights = fit_weights(cells, 1.0 / (v_kept + 1))

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        names = ["__id", "part", "n_tokens", "n_known", "base_score", "score"]
        if not len(l):
            return pd.DataFrame({c: [] for c in names})
        block = _Block(l["docs"])
        bucket, p2, p1, count = _estimates(block, _totals(r)[1], n)
        w = weights[bucket]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1)
        add = lambda x: np.add.reduceat(x, block.starts)
        return pd.DataFrame({"__id": pd.Series(block.doc_ids, dtype=object), "part": block.remainders, "n_tokens": block.sizes, "n_known": add((count > 0).astype(np.int64)), "base_score": add(np.log10((count + 1) / (n + (v + 1)))), "score": add(np.log10(p))}, columns=names)

    out = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, f"__id {kind}, part int, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("__id").alias(id_col), (F.col("part") == TEST_REMAINDER).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
