"""Street graphs as edge tables (grp, src, dst, weight). Loops run until nothing changes; tables between rounds are in the shared folder."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from waymark.functions.storage import cut_lineage, delete, scratch_path
from waymark.operators.spatial import near_segments

#: Edges of a block of the search for paths.
BLOCK = 2_000_000
#: Edges that a task joins at a time.
CHUNK = 2_000_000
#: Up to so many routes of up to so many edges are walked edge by edge.
FEW_ROUTES, SHORT_ROUTE = 100_000, 64


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("grp", "src", "dst", "weight").unionByName(edges.select("grp", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


class Bucketed:
    """Rows in buckets by two columns, as many as shuffles have partitions: joins and groups by these columns read them without a shuffle. The table is dropped at the end."""

    def __init__(self, spark, tag: str, *by: str):
        self.spark, self.by, self.name, self.path = spark, by, f"waymark_{tag}_{uuid.uuid4().hex[:12]}", scratch_path(spark, tag)
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, df: DataFrame) -> DataFrame:
        df.write.format("parquet").mode("append").bucketBy(self.n, *self.by).option("path", self.path).saveAsTable(self.name)
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def _grown(lab: np.ndarray, hop: np.ndarray, offsets: np.ndarray, to: np.ndarray, weight: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Relax the nodes f, and what gets better by them, until nothing does; which labels (length lab, edges hop) got better."""
    better = np.zeros(len(lab), bool)
    while len(f):
        n = offsets[f + 1] - offsets[f]
        at = np.repeat(offsets[f] - np.cumsum(n) + n, n) + np.arange(n.sum())
        t, d, h = to[at], np.repeat(lab[f], n) + weight[at], np.repeat(hop[f] + 1, n)
        good = (d < lab[t]) | ((d == lab[t]) & (h < hop[t]))
        t, d, h = t[good], d[good], h[good]
        order = np.lexsort((h, d, t))
        t = t[order]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        f, order = t[first], order[first]
        lab[f], hop[f] = d[order], h[order]
        if len(f) and lab[f].min() < 0:
            raise OverflowError("lengths of paths do not fit their type, or weights are negative")
        better[f] = True
    return better


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of all edges of a task: its nodes in order of id, their names, and where the edges of each begin, lead to and weigh. An edge from a node to itself marks a source."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    del held
    a, b, w, n = t["a"].to_numpy(), t["b"].to_numpy(), t["weight"].to_numpy(), t.num_rows
    ids, first, at = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    at_b, at_a = at[n:], at[:n]
    start, real = np.unique(at_a[at_a == at_b]), at_a != at_b
    if w.min() < 0:
        raise ValueError("weights must not be negative")
    if w.dtype.kind != "f" and w.max() < 2**32:
        w = w.astype(np.min_scalar_type(w.max()))
    src, to, w = np.concatenate([at_a[real], at_b[real]]), np.concatenate([at_b[real], at_a[real]]), np.concatenate([w[real], w[real]])
    order = np.argsort(src, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
    where = pa.array(first % n)
    names = pc.if_else(pa.array(first < n), t["src"].take(where), t["dst"].take(where))
    sink = pa.BufferOutputStream()
    named = pa.table({"grp": t["grp"].take(where), "node": names}).combine_chunks()
    alike = all(pc.all(pc.equal(named[c].take(pa.array(x)), t[end])).as_py() for x, end in ((at_a, "src"), (at_b, "dst")) for c, end in (("node", end), ("grp", "grp")))
    checks = np.array([zlib.crc32(f"{g} {v}".encode()) for g, v in zip(named["grp"].to_pylist(), named["node"].to_pylist())], np.int64)
    with pa.ipc.new_stream(sink, named.schema) as out:
        out.write_table(named)
    arrays = {"ids": ids, "checks": checks, "start": start, "offsets": offsets, "ends": to[order].astype(np.int32), "weights": w[order]}
    yield pa.RecordBatch.from_pydict({"key": pa.array([a[0]]), "alike": [bool(alike)], "width": [w.dtype.str], "names": pa.array([sink.getvalue().to_pybytes()], pa.binary()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}})


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, check) of the nodes of each block."""
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            out = pa.table({"id": ids, "key": np.full(len(ids), r["key"]), "check": np.frombuffer(r["checks"], np.int64)})
            yield from out.to_batches(max_chunksize=100_000)


def _reader(kind: np.dtype):
    """Functions for the groups of a block: one round, and the labels at the end."""
    far = np.inf if kind.kind == "f" else np.iinfo(kind).max

    def arrays(block: pa.Table) -> dict:
        row = {c: block[c][0] for c in block.column_names}
        types = {"ids": np.int64, "start": np.int64, "offsets": np.int64, "ends": np.int32, "weights": str(row.get("width")), "lab": kind, "hop": np.int32, "shared": bool}
        return {c: np.frombuffer(row[c].as_buffer(), t) for c, t in types.items() if c in row and row[c].is_valid}

    def round_of(block: pa.Table, told: pa.Table) -> pa.Table:
        """told: the labels of the block, after the first round, and better ones of nodes that other blocks have too; in the first round the ids of these nodes."""
        x = arrays(block)
        old = told.filter(pc.is_null(told["id"]))
        told = told.filter(pc.is_valid(told["id"]))
        at = np.searchsorted(x["ids"], told["id"].to_numpy())
        if old.num_rows:
            x |= arrays(old)
            lab, hop, shared = x["lab"].copy(), x["hop"].copy(), x["shared"]
            d, h = told["distance"].to_numpy(), told["hops"].to_numpy()
            good = (d < lab[at]) | ((d == lab[at]) & (h < hop[at]))
            f = at[good]
            lab[f], hop[f] = d[good], h[good]
        else:
            lab, hop, shared, f = np.full(len(x["ids"]), far, kind), np.zeros(len(x["ids"]), np.int32), np.zeros(len(x["ids"]), bool), x["start"]
            shared[at] = True
            lab[f] = 0
        better = _grown(lab, hop, x["offsets"], x["ends"], x["weights"], f)
        if not old.num_rows:
            better[f] = True
        tell = np.flatnonzero(better & shared)
        own, n = {"lab": lab, "hop": hop, "shared": shared}, len(tell)
        states = {c: pa.array([v.tobytes(), *[None] * n], pa.binary()) for c, v in own.items()}
        none = lambda v: pa.concat_arrays([pa.nulls(1, (v := pa.array(v)).type), v])
        return pa.table({"key": np.full(n + 1, block["key"][0].as_py()), **states, "id": none(x["ids"][tell]), "distance": none(lab[tell]), "hops": none(hop[tell])})

    def labels(block: pa.Table, state: pa.Table) -> pa.Table:
        """The names and labels of what was reached, and of all parents by the edges of the block the least."""
        x = arrays(block) | arrays(state)
        names = pa.ipc.open_stream(block["names"][0].as_buffer()).read_all().combine_chunks()
        lab, hop, to = x["lab"], x["hop"], x["ends"]
        src = np.repeat(np.arange(len(lab)), np.diff(x["offsets"]))
        known = lab[src] != far
        src, to, w = src[known], to[known], x["weights"][known]
        tight = (lab[src] + w == lab[to]) & (hop[src] + 1 == hop[to])
        order = pc.sort_indices(names["node"]).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        least = np.full(len(lab), len(lab))
        np.minimum.at(least, to[tight], rank[src[tight]])
        out = np.flatnonzero(lab != far)
        parent = pa.array(np.append(order, 0)[least[out]], mask=least[out] == len(lab))
        return pa.table({"grp": names["grp"].take(pa.array(out)), "node": names["node"].take(pa.array(out)), "distance": lab[out], "hops": hop[out], "parent": names["node"].take(parent), "shared": x["shared"][out]})

    return round_of, labels


def _labels(edges: DataFrame, sources: DataFrame, salt: int = 0) -> DataFrame:
    """(grp, node, distance, hops, parent).

    Edges are dealt out once, by the start they are given with, to blocks. A task relaxes within its block until nothing gets better; a round then shuffles only the better labels of nodes
    that stand in several blocks. Nodes are told apart by 64 bits of a hash; where two names in a block, or checksums of names in several, have the same, all is done with another hash.
    """
    spark, kind = edges.sparkSession, edges.schema["weight"].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    number = T.LongType() if isinstance(kind, (T.IntegralType, T.DecimalType)) else kind
    weight = (F.col("weight") * 10**scale).cast(number).alias("weight")
    links = edges.filter("src <> dst and weight is not null").select("grp", "src", "dst", weight)
    blocks = Bucketed(spark, "blocks", "key")
    blocks.n = int(min(blocks.n, max(1, links.count() // BLOCK)))
    links = links.unionByName(sources.filter("node is not null").select("grp", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast(number).alias("weight")).distinct()).filter("grp is not null")
    ids = [F.xxhash64(F.lit(salt), "grp", end).alias(to) for end, to in (("src", "a"), ("dst", "b"))]
    name, binary = links.schema["src"].dataType, T.BinaryType()
    row = T.StructType([T.StructField("key", T.LongType()), T.StructField("alike", T.BooleanType()), T.StructField("width", T.StringType()), *(T.StructField(c, binary) for c in ("names", "ids", "checks", "start", "offsets", "ends", "weights"))])
    state = T.StructType([T.StructField("key", T.LongType()), *(T.StructField(c, binary) for c in ("lab", "hop", "shared")), T.StructField("id", T.LongType()), T.StructField("distance", number), T.StructField("hops", T.IntegerType())])
    done = T.StructType([T.StructField("grp", links.schema["grp"].dataType), T.StructField("node", name), T.StructField("distance", number), T.StructField("hops", T.IntegerType()), T.StructField("parent", name), T.StructField("shared", T.BooleanType())])
    round_of, labels = _reader(np.dtype({"float": np.float32, "double": np.float64}.get(number.typeName(), np.int64)))
    try:
        held = blocks.add(links.select("*", *ids).repartition(blocks.n, "a").mapInArrow(_block, row))
        pairs = held.select("key", "ids", "checks").mapInArrow(_held, "id long, key long, check long")
        shared = pairs.groupBy("id").agg(F.collect_list("key").alias("keys"), (F.min("check") != F.max("check")).alias("clash"))
        shared = cut_lineage(shared.filter("size(keys) > 1"), "shared")
        if not held.filter("not alike").isEmpty() or not shared.filter("clash").isEmpty():
            return _labels(edges, sources, salt + 1)
        each = held.select("key", "ids", "start", "offsets", "ends", "width", "weights").groupBy("key")
        blank = lambda df: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in state])
        told = blank(shared.select("id", F.explode("keys").alias("key")))
        while True:
            now = cut_lineage(each.cogroup(told.groupBy("key")).applyInArrow(round_of, state), "round")
            better = now.filter("id is not null")
            if better.isEmpty():
                break
            better = better.groupBy("id").agg(F.min(F.struct("distance", "hops")).alias("b")).select("id", "b.*")
            better = better.join(shared.select("id", "keys"), "id").select("id", "distance", "hops", F.explode("keys").alias("key"))
            told = now.filter("id is null").unionByName(blank(better))
        found = held.select("key", "names", "ids", "offsets", "ends", "width", "weights").groupBy("key").cogroup(now.groupBy("key")).applyInArrow(labels, done)
        found = cut_lineage(found.withColumn("distance", F.col("distance").cast(kind) if not scale else (F.col("distance").cast("decimal(20,0)") / 10**scale).cast(kind)), "paths")
        own = [c for c in found.columns if c not in ("parent", "shared")]
        several = cut_lineage(found.filter("shared").groupBy(*own).agg(F.min("parent").alias("parent")), "paths")
        return found.filter("not shared").select(*own, "parent").unionByName(several)
    finally:
        blocks.drop()


def _named(steps: DataFrame, edges: DataFrame, edge_id: str | None) -> DataFrame:
    """steps (grp, node, parent, ...) with the edge from parent to node, none where there is no parent."""
    pair = [F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")]
    named = edges.filter("src <> dst").select("grp", *pair, "weight", (F.col(edge_id).cast("string") if edge_id else F.concat_ws("-", F.least("src", "dst"), F.greatest("src", "dst"))).alias("edge"))
    ends = steps.filter("parent is not null").select("grp", "node", "parent", F.least("node", "parent").alias("low"), F.greatest("node", "parent").alias("high")).distinct()
    taken = ends.join(named, ["grp", "low", "high"]).groupBy("grp", "node", "parent").agg(F.min(F.struct("weight", "edge")).alias("e")).select("grp", "node", "parent", "e.edge")
    return steps.join(taken, ["grp", "node", "parent"], "left")


def shortest_paths(edges: DataFrame, sources: DataFrame, edge_id: str | None = None, named: bool = True) -> DataFrame:
    """(grp, node, distance, hops, parent, edge): weighted distance from the nearest source (grp, node), all groups at once. Weights are not negative.

    Labels are ordered by distance, number of edges and parent; a parent has one edge less than its child, so parents have no cycle, zero-length
    edges or not. Of parallel edges the shortest is taken, of equal ones the one of smallest id; edges from a node to itself are never taken. edge_id: a
    column of edges; where there is none, an edge is named by its ends. named: with edge, which takes one more join with the edges.
    """
    found = _labels(edges, sources)
    return _named(found, edges, edge_id).select("grp", "node", "distance", "hops", "parent", "edge") if named else found


def _joined(grp: np.ndarray, a: np.ndarray, b: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes (grp * names + name) of edges (grp, a, b) in order, and the place of the smallest node that each hangs together with."""
    nodes, at = np.unique(np.concatenate([grp * names + a, grp * names + b]), return_inverse=True)
    a, b = at[: len(grp)], at[len(grp) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _stars(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """(grp, node, root) of edges (grp, src, dst): each node of some most edges once, with the smallest node that it hangs together with by them."""

    def star(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        group = pc.dictionary_encode(t["grp"].combine_chunks())
        ends = pc.dictionary_encode(pa.concat_arrays([c for side in ("src", "dst") for c in t[side].chunks]))
        order = pc.sort_indices(ends.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        codes, n = rank[ends.indices.to_numpy()], t.num_rows
        nodes, root = _joined(group.indices.to_numpy().astype(np.int64), codes[:n], codes[n:], len(order))
        name = lambda v: ends.dictionary.take(order.take(pa.array(v % len(order))))
        out = pa.table({"grp": group.dictionary.take(pa.array(nodes // len(order))), "node": name(nodes), "root": name(nodes[root])})
        yield from out.to_batches(max_chunksize=100_000)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= most:
            yield from star(held)
            held, rows = [], 0
    if held:
        yield from star(held)


def _small_components(edges: DataFrame) -> DataFrame:
    """(grp, node, component) by label propagation with pointer jumping."""
    two = cut_lineage(both_ways(edges.withColumn("weight", F.lit(1))).select("grp", "src", "dst").distinct(), "edges")
    labels = cut_lineage(two.groupBy("grp", F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), "labels")
    while True:
        heard = two.join(labels.withColumnRenamed("node", "dst"), ["grp", "dst"]).groupBy("grp", F.col("src").alias("node")).agg(F.min("component").alias("heard"))
        via = labels.join(heard, ["grp", "node"]).select("grp", "node", F.col("component").alias("old"), F.least("component", "heard").alias("via"))
        up = labels.select("grp", F.col("node").alias("via"), F.col("component").alias("up"))
        new = cut_lineage(via.join(up, ["grp", "via"]).select("grp", "node", F.least("via", "up").alias("component"), "old"), "labels")
        labels = new.drop("old")
        if new.filter("component <> old").isEmpty():
            return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """(grp, node, component): smallest node name reachable.

    Tasks replace the edges that they have by stars, node to smallest node, without a shuffle. What hangs together is then told by the roots of stars that share a node, a far
    smaller graph with most edges: stars are made of it again while that halves it, and the rest is left to label propagation. edges: (grp, src, dst).
    """
    name = edges.schema["src"].dataType
    schema = T.StructType([T.StructField("grp", edges.schema["grp"].dataType), T.StructField("node", name), T.StructField("root", name)])
    stars = edges.filter("grp is not null and src is not null and dst is not null").select("grp", "src", "dst").mapInArrow(_stars, schema)
    # a node has its least root where before is null; the others are linked to the one before
    stars = cut_lineage(stars.withColumn("before", F.lag("root").over(W.partitionBy("grp", "node").orderBy("root"))), "roots")
    nodes = stars.filter("before is null").select("grp", "node", "root")
    links = cut_lineage(stars.filter("before <> root").select("grp", F.col("before").alias("src"), F.col("root").alias("dst")).distinct(), "links")
    n = links.count()
    if not n:
        return nodes.withColumnRenamed("root", "component")
    roots = cut_lineage(connected_components(links) if 2 * n <= edges.count() else _small_components(links), "components")  # of known size: few are broadcast
    return nodes.join(roots.select("grp", F.col("node").alias("root"), "component"), ["grp", "root"], "left").select("grp", "node", F.coalesce("component", "root").alias("component"))


def shared_nodes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(main, cross, node) of the nodes that two streets share. pairs: (main, cross) groups."""
    nodes = both_ways(edges).select("grp", F.col("src").alias("node")).distinct()
    left = pairs.join(nodes, pairs["main"] == nodes["grp"]).select("main", "cross", "node")
    return left.join(nodes.withColumnRenamed("grp", "cross"), ["cross", "node"]).select("main", "cross", "node").distinct()


def boundary_nodes(segments: DataFrame, pairs: DataFrame, limit: float = 200.0, top: int = 5, slack: float = 50.0) -> DataFrame:
    """(main, cross, node, by_proximity, distance): shared nodes of two streets; where there are none, the ends of the main street's segments nearest to the cross street,
    at most top of them, within the limit and within the least distance plus slack. segments: (grp, sid, src, dst, x1, y1, x2, y2); pairs: (main, cross).
    """
    shared = shared_nodes(segments.withColumn("weight", F.lit(1)), pairs).select("main", "cross", "node", F.lit(False).alias("by_proximity"), F.lit(0.0).alias("distance"))
    shared = cut_lineage(shared, "shared")
    open_pairs = pairs.join(shared.select("main", "cross").distinct(), ["main", "cross"], "left_anti")
    near = near_segments(segments, open_pairs, limit)
    w = W.partitionBy("main", "cross")
    ranked = near.withColumn("rank", F.row_number().over(w.orderBy(F.round("distance", 9), "sid"))).withColumn("least", F.min("distance").over(w))
    ranked = ranked.filter((F.col("rank") <= top) & (F.round(F.col("distance") - F.col("least"), 9) <= slack))
    ends = segments.select("sid", F.explode(F.array("src", "dst")).alias("node"))
    found = ranked.join(ends, "sid").groupBy("main", "cross", "node").agg(F.min("least").alias("distance")).select("main", "cross", "node", F.lit(True).alias("by_proximity"), "distance")
    return shared.unionByName(found)


def _walked(paths: DataFrame, walk: DataFrame) -> DataFrame:
    """(grp, target, node) of all nodes from the targets (grp, target, node) to their sources, by doubling.

    Ancestors at distances of powers of two come first, then the nodes of a path from the highest power down: a path of n nodes takes 2 log n joins.
    """
    hops = [cut_lineage(paths.filter("parent is not null").select("grp", "node", "parent"), "hops")]
    while not hops[-1].isEmpty():
        up = hops[-1].select("grp", F.col("node").alias("parent"), F.col("parent").alias("next"))
        hops.append(cut_lineage(hops[-1].join(up, ["grp", "parent"]).select("grp", "node", F.col("next").alias("parent")), "hops"))
    for h in reversed(hops[:-1]):
        walk = cut_lineage(walk.unionByName(walk.join(h, ["grp", "node"]).select("grp", "target", F.col("parent").alias("node"))), "route")
    return walk


def routes(paths: DataFrame, targets: DataFrame, edges: DataFrame | None = None, edge_id: str | None = None) -> DataFrame:
    """(grp, target, start, nodes, edges, hops, length): the nodes and the edges from a source to each target (grp, node) that a path reaches, in order; lists are joined by '>'.

    A few short routes are walked edge by edge, others by doubling. edges and their column edge_id: where paths have no edge; only edges of routes are looked up.
    """
    label = [c for c in ("distance", "hops", "parent", "edge") if c in paths.columns]
    steps = cut_lineage(targets.distinct().join(paths, ["grp", "node"]).select("grp", F.col("node").alias("target"), "node", *label), "route")
    n, most = steps.agg(F.count("*"), F.max("hops")).first()
    if n <= FEW_ROUTES and (most or 0) <= SHORT_ROUTE:
        last, walked = steps, [steps]
        for _ in range(most or 0):
            # a parent has one edge less than its child
            up = last.filter("parent is not null").select("grp", "target", F.col("parent").alias("node"), (F.col("hops") - 1).alias("hops"))
            last = cut_lineage(F.broadcast(up).join(paths, ["grp", "node", "hops"]).select("grp", "target", "node", *label), "route")
            walked.append(last)
        steps = reduce(DataFrame.unionByName, walked)
    else:
        steps = _walked(paths, steps.select("grp", "target", "node")).join(paths, ["grp", "node"]).select("grp", "target", "node", *label)
    if "edge" not in label:
        steps = _named(cut_lineage(steps, "route"), edges, edge_id)
    done = steps.groupBy("grp", "target").agg(F.array_sort(F.collect_list(F.struct("hops", "node", "edge"))).alias("r"), F.max("distance").alias("length"))
    line = lambda c: F.array_join(F.transform("r", lambda s: s[c]), ">")  # noqa: E731  the source has no edge
    return done.select("grp", "target", F.element_at("r", 1)["node"].alias("start"), line("node").alias("nodes"), line("edge").alias("edges"), (F.size("r") - 1).alias("hops"), "length")


def route_segments(found: DataFrame, edges: DataFrame, edge_id: str) -> DataFrame:
    """(grp, target, seq, edge, from_node, to_node, weight): the edges of routes one after another. edges: with grp, weight and the column edge_id; rows that are given twice count once."""
    steps = found.filter("hops > 0").select("grp", "target", F.split("nodes", ">").alias("n"), F.posexplode(F.split("edges", ">")).alias("seq", "edge"))
    steps = steps.select("grp", "target", "seq", "edge", F.get("n", F.col("seq")).alias("from_node"), F.get("n", F.col("seq") + 1).alias("to_node"))
    steps = cut_lineage(steps, "steps")  # of known size: few are broadcast
    return steps.join(edges.select("grp", F.col(edge_id).cast("string").alias("edge"), "weight"), ["grp", "edge"]).distinct()
