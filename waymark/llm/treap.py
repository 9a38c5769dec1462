"""Ranked lexical search by K2-treaps over the grid of terms and documents.

1. One pass over the texts counts, for each document, its terms and those of them that queries have; the corpus figures (N, L, df) are sums over all documents.
2. A second pass takes documents in blocks. A block's grid has a row for each term and a column for each document; a point is
   the impact of a term in a document. Its quadtree keeps the occupied cells of each level alone, each with the largest impact below it
   and its four children.
3. The rows of a query's terms are paths from the root. All of them descend together: a document range is a cell of each path, and the
   sum of the cells' maxima, weighted, bounds every document in it. Ranges are opened best bound first, BATCH at a time, until no bound
   reaches the K-th score so far; at the last level a bound is the score itself, and it is exact.
4. The best K of every task meet in one ranking of each query.

Blocks are cut from a task's share of the documents as they come, so no document moves. Queries are dealt out to blocks of about QUERY_TERMS terms,
which is what each task is sent; every block of queries goes against all documents.

Defined results: null, empty and wordless texts are no documents and no queries; documents of equal id are documents of their own, and of equal scores
the smaller id comes first, a null id last; equal rows take a rank each; queries of equal or null id are ranked apart; texts of any
length are counted whole, in pieces; no documents or no queries give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from waymark.llm.common import groups_for, materialize, named, text_batches

K = 20
#: Documents of a block, and postings after which a block is closed early.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 2_000_000
#: Ranges opened together.
BATCH = 256
#: Terms of the queries that are sent to every task together.
QUERY_TERMS = 200_000
#: Tasks whose results are ranked together; those of more are ranked in so many groups first.
MERGE_TASKS = 1024
#: Bytes of a text that are split together.
PIECE = 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes to terms: A-Z become a-z, other ASCII that is no letter or digit becomes a space; bytes of other characters stay.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a text."""
    b, out, start = text.translate(_TO_TERMS), Counter(), 0
    while start < len(b):
        end = b.find(b" ", start + PIECE)
        end = len(b) if end < 0 else end
        out.update(b[start:end].split())
        start = end
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of terms in documents of n terms, of n_docs documents with n_terms together. All are 64-bit integers."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Grid:
    """The quadtree of one block. Cell 0 is the empty cell; cell 1 is the root.

    rows, cols, values: the points, each place once. Cells of all levels are numbered together; top[c] is the largest value in cell c and child[c] has its
    children at 2 * (lower half of the rows) + (right half of the columns).
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray):
        self.height = max(1, int(max(rows.max(), cols.max())).bit_length())
        code = np.zeros(len(rows), np.int64)
        for bit in range(self.height):
            code |= ((rows.astype(np.int64) >> bit & 1) << (2 * bit + 1)) | ((cols.astype(np.int64) >> bit & 1) << (2 * bit))
        order = np.argsort(code, kind="stable")
        codes, tops = [code[order]], [values[order]]
        for _ in range(self.height):
            up = codes[-1] >> 2
            first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            tops.append(np.maximum.reduceat(tops[-1], first))
            codes.append(up[first])
        codes.reverse()
        tops.reverse()  # the root first
        start = np.cumsum([1, *[len(c) for c in codes]])
        self.top = np.concatenate([np.zeros(1, np.int64), *tops])
        self.child = np.zeros((start[-2], 4), np.int32)  # of all cells but the points
        for level in range(self.height):
            below = codes[level + 1]
            parent = start[level] + np.searchsorted(codes[level], below >> 2)
            self.child[parent, below & 3] = start[level + 1] + np.arange(len(below))

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the k columns of highest weighted sum over rows, of equal ones the first, if they reach least (1 at least)."""
        h = self.height
        bits = np.array([(rows >> (h - 1 - level)) & 1 for level in range(h)], np.int64)
        cells, col, level = np.ones((1, len(rows)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.top[cells] @ weights
        found_col, found_score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), max(1, least)
        while len(bound):
            live = bound >= least
            if not live.all():
                cells, col, level, bound = cells[live], col[live], level[live], bound[live]
                if not len(bound):
                    break
            if len(bound) > BATCH:
                pick = np.argpartition(-bound, BATCH)[:BATCH]
                rest = np.ones(len(bound), bool)
                rest[pick] = False
            else:
                pick, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
            at, down = level[pick], 2 * bits[level[pick]]
            new_cells = np.concatenate([self.child[cells[pick], down], self.child[cells[pick], down + 1]]).astype(np.int64)
            new_col, new_level = np.concatenate([2 * col[pick], 2 * col[pick] + 1]), np.concatenate([at + 1, at + 1])
            new_bound = self.top[new_cells] @ weights
            done = (new_level == h) & (new_bound >= least)
            if done.any():
                found_col, found_score = np.concatenate([found_col, new_col[done]]), np.concatenate([found_score, new_bound[done]])
                if len(found_col) >= k:
                    keep = np.lexsort((found_col, -found_score))[:k]
                    found_col, found_score = found_col[keep], found_score[keep]
                    least = max(least, int(found_score[-1]))
            more = (new_level < h) & (new_bound >= least)
            cells, col, level, bound = np.concatenate([cells[rest], new_cells[more]]), np.concatenate([col[rest], new_col[more]]), np.concatenate([level[rest], new_level[more]]), np.concatenate([bound[rest], new_bound[more]])
        keep = np.lexsort((found_col, -found_score))[:k]
        return found_col[keep], found_score[keep]


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: its count of terms, and the numbers and counts of those of the vocabulary. docs: (id, text as binary)."""
    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, terms, tfs = [], [], [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("text")):
                counts = term_counts(text.as_py()) if text.is_valid else None
                if counts:
                    known = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                    ids.append(i)
                    ns.append(counts.total())
                    terms.append([t for t, _ in known])
                    tfs.append([c for _, c in known])
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("id").type), pa.array(ns, pa.int64()), pa.array(terms, numbers), pa.array(tfs, numbers)], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(counted, schema)


def _order(i) -> tuple:
    """Ids ascending, null last."""
    return (1, 0) if i is None else (0, i)


def _searched(postings: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): for each task, its k best documents of each item. items: (number, terms, weights)."""
    schema = T.StructType([T.StructField("item", T.LongType()), postings.schema["id"], T.StructField("score", T.LongType())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}  # of each item: (score negated, id in order, id)

        def close(rows: list[tuple]) -> None:
            rows.sort(key=lambda r: _order(r[0]))
            ids, sizes = [r[0] for r in rows], np.array([len(r[2]) for r in rows])
            if not sizes.sum():
                return
            terms, tf = np.concatenate([r[2] for r in rows]).astype(np.int64), np.concatenate([r[3] for r in rows]).astype(np.int64)
            cols, n = np.repeat(np.arange(len(rows)), sizes), np.repeat(np.array([r[1] for r in rows], np.int64), sizes)
            present, at = np.unique(terms, return_inverse=True)
            grid = Grid(at, cols, impacts(tf, n, n_docs, n_terms))
            for number, own, weights in items:
                place = np.minimum(np.searchsorted(present, own), len(present) - 1)
                there = (present[place] == own) & (weights > 0)
                if there.any():
                    held = best.setdefault(number, [])
                    least = -held[-1][0] if len(held) == k else 1
                    found, scores = grid.best(place[there], weights[there], k, least)
                    if len(found):
                        held += [(-int(s), _order(ids[c]), ids[c]) for c, s in zip(found, scores)]
                        held.sort(key=lambda x: x[:2])
                        del held[k:]

        rows, held_postings, kind = [], 0, None
        for b in batches:
            kind = b.schema.field("id").type
            for i, n, terms, tfs in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("terms"), b.column("tfs")):
                rows.append((i, n, terms.values.to_numpy(zero_copy_only=False), tfs.values.to_numpy(zero_copy_only=False)))
                held_postings += len(terms)
                if len(rows) == BLOCK_DOCS or held_postings >= BLOCK_POSTINGS:
                    close(rows)
                    rows, held_postings = [], 0
        if rows:
            close(rows)
        out = [(number, i, -s) for number, held in best.items() for s, _, i in held]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], pa.int64())], ["item", "id", "score"])

    return postings.mapInArrow(searched, schema)


def query_blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """(item, query_id, text, block) of the queries that have a text, written, and the number of blocks. queries: (query_id, text as binary)."""
    rows = materialize(queries.filter("text is not null").select(F.monotonically_increasing_id().alias("item"), "query_id", "text"), "search-queries")
    terms = rows.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0]  # a term and its separator have two bytes at least
    blocks = groups_for(int(terms or 0), QUERY_TERMS)
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), blocks


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """query id, rank (from 1), id and score of the k best documents of every query."""
    text_batches(docs)
    src = docs.select(named(id_col).alias("id"), named(text_col).cast("string").cast("binary").alias("text"))
    asked, blocks = query_blocks(queries.select(named(query_id_col).alias("query_id"), named(query_text_col).cast("string").cast("binary").alias("text")))
    out = None
    for number in range(blocks):
        found = _one_block(src, asked.filter(F.col("block") == number), k)
        out = found if out is None else out.unionByName(found)
    return out.join(asked.select("item", "query_id"), "item").select(F.col("query_id").alias(query_id_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _one_block(src: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """(item, id, score, rank) of the queries of one block, which are few enough for every task."""
    vocabulary: dict[bytes, int] = {}
    counted = [(r.item, [(vocabulary.setdefault(t, len(vocabulary)), c) for t, c in term_counts(bytes(r.text)).items()]) for r in own.select("item", "text").collect()]
    postings = materialize(_postings(src, vocabulary), "postings")
    total = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = {r.term: r.n for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row for each term of the block at most
    weights = {t: weight(total.docs, n) for t, n in df.items()}
    items = []
    for number, terms in counted:
        terms = sorted((t, c * weights[t]) for t, c in terms if t in weights)
        if terms:
            items.append((number, np.array([t for t, _ in terms], np.int64), np.array([w for _, w in terms], np.int64)))
    found = _searched(postings, items, total.docs, total.terms or 1, k)
    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    if postings.rdd.getNumPartitions() > MERGE_TASKS:  # the best of very many tasks meet in groups of tasks first
        group = found.withColumn("__g", F.pmod(F.spark_partition_id(), F.lit(MERGE_TASKS)))
        found = group.withColumn("__k", F.row_number().over(W.partitionBy("item", "__g").orderBy(*best))).filter(F.col("__k") <= k).drop("__g", "__k")
    order = W.partitionBy("item").orderBy(*best)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the K best documents of every benchmark item."""
    return search(docs, benchmark)


ORACLE_SQL = rf"""
with t as (select doc_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}')) as term from documents),
p as (select doc_id, term, count(*) as tf from t where term <> '' group by all),
d as (select doc_id, sum(tf) as n from p group by all),
c as (select count(*) as docs, sum(n) as terms from d),
q as (select item_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}')) as term from benchmark),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, c group by term),
s as (
  select q.item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs)::bigint // terms::bigint))))::bigint as score
  from q join p using (term) join w using (term) join d using (doc_id), c group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= {K}
"""
