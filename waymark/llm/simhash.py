"""SimHash near-duplicates through a forest of vantage-point trees.

Fingerprints: 64 bits of the majority of the XXH64 hashes of the 4-word shingles of a whole text.

Search: pairs of distinct fingerprints at Hamming distance <= RADIUS are found exactly.

* The 64 bits are cut into six blocks. Four differing bits touch at most four of them, so
  two near fingerprints agree in at least two whole blocks. Each of the 15 pairs of blocks roots one
  vantage-point tree; its first level partitions by Hamming distance under the mask of the two blocks. A near
  pair has masked distance 0 in some tree, so there the triangle bound has no slack, each
  fingerprint goes to one shard, and a shard is the ball of masked distance 0.
  (With the whole 64 bits as first level the bound prunes next to nothing: distances of unrelated
  fingerprints are 32 +- 4, and a slack of 4 sends most queries into both halves.)
* A shard over SHARD_CAP is split further by vantage points: a fingerprint is stored on its
  own side of the median radius and also queries the other side if the triangle bound allows a partner there
  (boundary-overlapping shards). What vantage points cannot divide is compared in blocks of bounded size.
* Within a shard a vantage-point tree over whole-fingerprint distances answers the queries; the shard returns a star
  over each group it connects, never all pairs.

Components come from label propagation with pointer jumping over those stars.

Defined results: null, empty and blank texts have no words and fingerprint zero, linked like any other; fewer than four
words make one shingle; equal rows are returned each; a null id never becomes a
component id unless all ids of its component are null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import delete_path, materialize, named, new_path, text_batches, whole_rows

RADIUS = 4
SEED = 42
SHINGLE = 4
#: Fingerprints of one shard that a task compares.
SHARD_CAP = 20_000
SPLIT_LEVELS = 6
SMALL = 8
LEAF = 128

_CUTS = (0, 11, 22, 33, 44, 54, 64)
_BLOCKS = [((1 << b) - (1 << a)) for a, b in zip(_CUTS, _CUTS[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the 4-word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and the six ASCII white spaces
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:k].tolist(), ends[-k:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, k, 65536):
        h = np.array([digest(line[i:j], SEED) for i, j in zip(first[a : a + 65536], last[a : a + 65536], strict=True)], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_hash, fp): fp is the fingerprint as a signed long."""
    text_batches(docs)
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), _text_hash(text_col).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), dtype=np.uint64, count=len(b)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], names=[id_col, "text_hash", "fp"])

    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, text_hash long, fp long")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


class _Tree:
    """Vantage-point tree over one shard's stored fingerprints."""

    def __init__(self, points: np.ndarray, at: np.ndarray, depth: int = 0):
        self.at, self.points = at, points
        self.inner = None
        if len(at) > LEAF and depth < 24:
            v = points[len(at) // 2]
            d = np.bitwise_count(points ^ v).astype(np.int64)
            r = int(np.median(d))
            inside = d <= r
            if not inside.all():
                self.v, self.r = v, r
                self.inner, self.outer = _Tree(points[inside], at[inside], depth + 1), _Tree(points[~inside], at[~inside], depth + 1)

    def search(self, queries: np.ndarray, which: np.ndarray, radius: int):
        """Yields (query number, stored numbers) for queries with near stored points."""
        if not len(queries):
            return
        if self.inner is None:
            for a in range(0, len(queries), 256):
                near = _near(queries[a : a + 256], self.points, radius)
                for i in np.flatnonzero(near.any(axis=1)):
                    yield which[a + i], self.at[near[i]]
            return
        d = np.bitwise_count(queries ^ self.v).astype(np.int64)
        inside, outside = d <= self.r + radius, d > self.r - radius  # triangle bounds
        yield from self.inner.search(queries[inside], which[inside], radius)
        yield from self.outer.search(queries[outside], which[outside], radius)


def _stars(stored: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, root) of the groups that near pairs between queries and stored points connect."""
    points = np.unique(np.concatenate((stored, queries)))
    root = np.arange(len(points))
    s, q = np.searchsorted(points, stored), np.searchsorted(points, queries)
    for i, found in _Tree(stored.view(np.uint64), s).search(queries.view(np.uint64), q, radius):
        roots = np.unique(np.concatenate((root[found], root[i : i + 1])))
        while (up := np.unique(root[roots])).tolist() != roots.tolist():
            roots = up
        root[roots] = roots[0]
        root[found] = roots[0]
        root[i] = roots[0]
    while (up := root[root]).tolist() != root.tolist():
        root = up
    moved = root != np.arange(len(points))
    return points[moved], points[root[moved]]


def _shard_edges(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b) of shards given as (stored, queries): arrays of fingerprints; queries null: the stored ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_out, b_out = [], []
            col = batch.column(0)
            flat, off = np.asarray(col.flatten()), np.asarray(col.offsets).astype(np.int64)
            off = off - off[0]
            sizes = np.diff(off)
            alone = np.asarray(batch.column(1).is_null())
            for n in range(2, SMALL + 1):  # many small shards at once
                rows = np.flatnonzero((sizes == n) & alone)
                if len(rows):
                    m = flat[off[rows][:, None] + np.arange(n)].view(np.uint64)
                    for i, j in combinations(range(n), 2):
                        near = np.bitwise_count(m[:, i] ^ m[:, j]) <= radius
                        a_out.append(m[near, i].view(np.int64))
                        b_out.append(m[near, j].view(np.int64))
            for k in np.flatnonzero((sizes > SMALL) | ~alone):
                own = flat[off[k] : off[k + 1]]
                a, b = _stars(own, own if alone[k] else np.array(batch.column(1)[int(k)].as_py(), dtype=np.int64), radius)
                a_out.append(a)
                b_out.append(b)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return shards.select("stored", "queries").mapInArrow(run, "a long, b long")


def _split_large(rows: DataFrame, radius: int, cap: int) -> DataFrame:
    """(stored, queries) of the shards over cap. rows: (tree, key, fp)."""
    spark = rows.sparkSession
    state = materialize(rows.select(F.xxhash64("tree", "key").alias("shard"), "fp", F.lit(True).alias("stored")), "vp-large")
    for level in range(SPLIT_LEVELS):
        own = state.filter("stored")
        vantage = own.groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("v")).filter(F.col("n") > cap)
        if vantage.isEmpty():
            break
        radii = own.join(vantage, "shard").groupBy("shard", "v").agg(F.percentile_approx(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))), 0.5).alias("r"))
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
        sides = F.array(
            F.struct(F.lit(0).alias("side"), (d <= F.col("r") + radius).alias("in"), (F.col("stored") & (d <= F.col("r"))).alias("home")),
            F.struct(F.lit(1).alias("side"), (d > F.col("r") - radius).alias("in"), (F.col("stored") & (d > F.col("r"))).alias("home")),
        )
        split = state.join(radii, "shard").select("shard", "fp", F.explode(sides).alias("x")).filter("x.in").select(F.xxhash64("shard", "x.side").alias("shard"), "fp", F.col("x.home").alias("stored"))
        state = materialize(state.join(radii, "shard", "left_anti").unionByName(split), "vp-large")
    # blocks: chunks of stored points by chunks of queries
    sizes = state.groupBy("shard").agg(F.ceil(F.count_if("stored") / cap).alias("sc"), F.ceil(F.count("*") / cap).alias("qc")).filter("sc > 0")
    state = state.join(sizes, "shard")
    s = state.filter("stored").select("shard", F.pmod(F.xxhash64("fp"), "sc").alias("c"), F.explode(F.sequence(F.lit(0), F.col("qc") - 1)).alias("e"), "fp", F.lit(True).alias("stored"))
    q = state.select("shard", F.explode(F.sequence(F.lit(0), F.col("sc") - 1)).alias("c"), F.pmod(F.xxhash64("fp", F.lit(7)), "qc").alias("e"), "fp", F.lit(False).alias("stored"))
    return s.unionByName(q).groupBy("shard", "c", "e").agg(F.collect_list(F.when(F.col("stored"), F.col("fp"))).alias("stored"), F.collect_list(F.when(~F.col("stored"), F.col("fp"))).alias("queries")).filter("size(stored) > 0")


def near_links(fps: DataFrame, radius: int = RADIUS, cap: int = SHARD_CAP) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all pairs at distance <= radius."""
    if radius > RADIUS:
        raise ValueError(f"six blocks find distances up to {RADIUS}")
    masks = [_signed(x | y) for x, y in combinations(_BLOCKS, 2)]
    trees = F.array(*[F.struct(F.lit(k).alias("tree"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(trees).alias("t")).select("t.tree", "t.key", "fp")
    large = materialize(rows.groupBy("tree", "key").count().filter(F.col("count") > cap).drop("count"), "vp-sizes")
    none = large.isEmpty()
    rest = rows if none else rows.join(large, ["tree", "key"], "left_anti")
    shards = rest.groupBy("tree", "key").agg(F.collect_list("fp").alias("stored")).filter(F.size("stored") > 1)
    edges = _shard_edges(shards.withColumn("queries", F.lit(None).cast("array<long>")), radius)
    if not none:
        edges = edges.unionByName(_shard_edges(_split_large(rows.join(large, ["tree", "key"], "left_semi"), radius, cap), radius))
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): label propagation with pointer jumping; root is the smallest node."""
    spark = edges.sparkSession
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    path = new_path(spark, "cc")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "cc", path)
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("via"))
        jump = lower.join(labels.select(F.col("node").alias("via"), F.col("root").alias("up")), "via").select("node", F.least("via", "up").alias("root"), "old")
        new_at = new_path(spark, "cc")
        new = materialize(jump, "cc", new_at)
        changed = not new.filter("root <> old").isEmpty()
        delete_path(spark, path)
        path, labels = new_at, new.select("node", "root")
        if not changed:
            return labels


def _rooted(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root): each fingerprint of rows (__id, fp), its smallest id and the fingerprint that names its component."""
    fps = materialize(rows.groupBy("fp").agg(F.min("__id").alias("first")), "fps")
    roots = components(near_links(fps.select("fp"), radius))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs."""
    rows = materialize(fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("__id"), "fp"), "fp")
    rooted = _rooted(rows, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest (id, hash of the text) stays, once; null ids come last.

    A component is told by its root fingerprint, so rows that share an id, or have none, do not stand for each other."""
    rows = materialize(fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("__id"), "text_hash", "fp"), "fp")
    counts = rows.groupBy("fp", "__id", "text_hash").count()
    least = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("text_hash").alias("h"), F.col("count").alias("n")))
    keep = counts.join(_rooted(rows, RADIUS).select("fp", "root"), "fp").groupBy("root").agg(least.alias("k")).select(F.col("k.id").alias("__keep"), F.col("k.h").alias("__keep_h"), F.col("k.n").alias("__n"))
    keep = materialize(keep, "groups")
    rows = whole_rows(docs, __id=named(id_col), __h=_text_hash(text_col))
    kept = rows.join(keep.drop("__n"), F.col("__id").eqNullSafe(F.col("__keep")) & F.col("__h").eqNullSafe(F.col("__keep_h")), "left_semi")
    many = not keep.filter("__n > 1").isEmpty()
    return (kept.dropDuplicates(["__id", "__h"]) if many else kept).select("row.*")
