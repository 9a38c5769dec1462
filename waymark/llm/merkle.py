"""A Merkle manifest of a dataset whose nodes are labelled by the interval of leaf ranks that they cover.

DataFrame operations only. A row is a leaf; the leaves of one group (lang) make a tree of runs of FANOUT, and the groups' roots make one more tree.

1. Ranks: rows are dealt out by ranges of (group, id, leaf), counted by range, and numbered within it; so no task sees a whole group, however large.
   A leaf of rank r covers [r, r + 1).
2. Up: a node of level l + 1 covers the intervals of up to FANOUT neighbours of level l and keeps them as its children. A tree ends with the node that covers
   [0, n). Every level is a table of its own.
3. Down: level by level, nodes meet the parent in whose bucket their interval starts and in whose interval it lies (a containment join in
   which a parent has at most FANOUT partners, so that none is hot), and take over its ancestors. The children of the parent to
   the left and to the right of the own interval are the siblings. A group's root takes over what its leaf in the upper tree has.

A proof is the list of (left, right) siblings from the leaf to the root; folding a leaf with it gives the root again.

Defined results: a null id comes first; rows of equal id are ordered by their leaf digest, and equal rows are leaves of their own, in any
order, as they have the same digest; null groups are one group, before all others; a group of one leaf has that leaf as root, and one group's root
is the root; a null id is never tampered with; texts of any length are hashed whole, once or twice, and never shuffled; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import ascii_lower, groups_for, id_remainder, materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of one range, about.
RANGE_ROWS = 50_000
#: Rows with every third crc32 of the id are tampered with.
TAMPER_MOD = 3


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row: each field as its count of UTF-8 bytes, a colon and its value, or a dash for null."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def with_ranks(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with rank (from 0 within each tree, by order) and n (rows of the tree). rows: a written table."""
    total = rows.count()
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())  # splits equal rows, too
    dealt = salted.repartitionByRange(groups_for(total, RANGE_ROWS), tree, *order, "__salt").withColumn("__range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    sizes = dealt.groupBy(tree, "__range").agg(F.count("*").alias("__n"))  # a row for each range and each tree in it
    by_tree = W.partitionBy(tree)
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(by_tree.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("__n").over(by_tree)).drop("__n")
    numbered = dealt.withColumn("__k", F.row_number().over(W.partitionBy(tree, "__range").orderBy(*order, "__salt")) - 1)
    return numbered.join(before, [tree, "__range"]).withColumn("rank", (F.col("__before") + F.col("__k")).cast("long")).drop("__range", "__salt", "__k", "__before")


def _parents(nodes: DataFrame, width: int) -> DataFrame:
    """The nodes of the next level, each of up to FANOUT neighbours, with their children. nodes: (tree, lo, hi, n, digest), each of width leaves at most."""
    open_ = nodes.filter("hi - lo < n").groupBy("tree", F.expr(f"lo div {width * FANOUT}").alias("bucket"), "n")
    made = open_.agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
    inside = F.transform("children", lambda c: c["digest"])
    return made.select(
        "tree", F.element_at("children", 1)["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), "n", digest(F.array_join(inside, "")).alias("digest"), "children"
    )


def levels_of(leaves: DataFrame) -> list[DataFrame]:
    """The tables of all levels, leaves first, until every tree has a node over [0, n). leaves: (tree, rank, n, digest, load)."""
    levels, width = [leaves.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "n", "digest", "load")], 1
    while not levels[-1].filter("hi - lo < n").isEmpty():
        levels.append(materialize(_parents(levels[-1], width), f"level-{len(levels)}"))
        width *= FANOUT
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the node over [0, n) of every tree."""
    found = [level.filter("hi - lo = n").select("tree", "digest") for level in levels]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda c: c["digest"]), "")


def paths_of(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(load, digest, path) of every leaf; path: the (left, right) siblings from the leaf to the last root. above: (tree, path) of every tree's root."""
    kind = "array<struct<left:string,right:string>>"
    parents = None
    for at in range(len(levels) - 1, -1, -1):
        own, width = levels[at], FANOUT**at
        keep = ["tree", "lo", "hi", "n", "path", "children"] if at else ["load", "digest", "path"]
        top = own.filter("hi - lo = n").join(above, "tree").select(*keep)
        if parents is not None:
            p = parents.select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("children").alias("p_children"), F.col("path").alias("p_path"), F.expr(f"lo div {width * FANOUT}").alias("p_bucket"))
            within = (F.col("tree") == F.col("p_tree")) & (F.expr(f"lo div {width * FANOUT}") == F.col("p_bucket")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            met = own.filter("hi - lo < n").join(p, within)
            left, right = F.filter("p_children", lambda c: c["hi"] <= F.col("lo")), F.filter("p_children", lambda c: c["lo"] >= F.col("hi"))
            step = F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right"))).cast(kind)
            top = top.unionByName(met.withColumn("path", F.concat(step, F.col("p_path"))).select(*keep))
        parents = materialize(top, f"paths-{at}") if at else top
    return parents


def proof_of(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, extra: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, path of every row of docs, and the extra columns (of columns of docs)."""
    extra = extra or {}
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    load = F.struct(F.col(id_col).alias("id"), *[c.alias(f"x_{k}") for k, c in extra.items()])
    rows = materialize(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("digest"), load.alias("load")), "leaves")
    levels = levels_of(materialize(with_ranks(rows, "tree", ["id", "digest"]), "ranked"))
    subroots = materialize(roots_of(levels), "subroots").select(F.lit("").alias("top"), F.col("tree").alias("load"), "digest")
    upper = materialize(with_ranks(subroots, "top", ["load"]).withColumnRenamed("top", "tree"), "ranked-subroots")
    upper_levels = levels_of(upper)
    # the path of a root starts with an entry of its own digests, which is handed down with the path; so no row is joined to its group by name
    root = roots_of(upper_levels).select("tree", F.array(F.struct(F.col("digest").alias("left"), F.lit("").alias("right"))).alias("path"))
    known = paths_of(upper_levels, root)
    ends = F.array(F.struct(F.col("digest").alias("left"), F.element_at("path", -1)["left"].alias("right")))
    known = materialize(known.select(F.col("load").alias("tree"), F.concat(F.slice("path", F.lit(1), F.size("path") - 1), ends).alias("path")), "upper-paths")
    out = paths_of(levels, known).withColumn("__ends", F.element_at("path", -1))
    return out.select(
        F.col("load.id").alias(id_col), F.col("digest").alias("leaf"), F.col("__ends.left").alias("subroot"), F.col("__ends.right").alias("root"),
        F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), *[F.col(f"load.x_{k}").alias(k) for k in extra],
    )


def verify_tampered(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, after some were tampered with."""
    hit = F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), TAMPER_MOD) == 0)
    fields = [F.when(hit, ascii_lower(F.col(f))).otherwise(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]
    made = manifest(docs, extra={"tampered": F.when(hit, leaf_digest(fields))})
    folded = made.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end)), 4294967295::bigint)"""

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({f}::varchar) || ':' || {f}::varchar, '-')" for f in FIELDS[:-1]) + " || coalesce(strlen({text}) || ':' || {text}, '-'))"

ORACLE_SQL = f"""
with recursive d as (
  select doc_id, coalesce('+' || lang, '') as tree, {_LEAF.format(text="text")} as leaf,
    case when doc_id is not null and {_CRC} % {TAMPER_MOD} = 0 then {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as tampered
  from documents),
l as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from d),
low as (
  select tree, 0 as lvl, pos, leaf as digest, n from l
  union all
  select tree, lvl + 1, pos // {FANOUT}, sha256(string_agg(digest, '' order by pos)), (n + {FANOUT - 1}) // {FANOUT} from low where n > 1 group by tree, lvl, pos // {FANOUT}, n),
sub as (select tree, digest, max(lvl) over () as deepest from low where n = 1),
s as (select tree, digest, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as n from sub),
high as (
  select 0 as lvl, pos, digest, n from s
  union all
  select lvl + 1, pos // {FANOUT}, sha256(string_agg(digest, '' order by pos)), (n + {FANOUT - 1}) // {FANOUT} from high where n > 1 group by lvl, pos // {FANOUT}, n),
steps as (
  select l.tree, l.pos, a.lvl, string_agg(a.digest, '' order by a.pos) filter (where a.pos < l.pos // ({FANOUT} ** a.lvl)::bigint) as lhs, string_agg(a.digest, '' order by a.pos) filter (where a.pos > l.pos // ({FANOUT} ** a.lvl)::bigint) as rhs
  from l join low a on a.tree = l.tree and a.n > 1 and a.pos // {FANOUT} = l.pos // ({FANOUT} ** (a.lvl + 1))::bigint group by l.tree, l.pos, a.lvl
  union all
  select l.tree, l.pos, 1000 + a.lvl, string_agg(a.digest, '' order by a.pos) filter (where a.pos < s.pos // ({FANOUT} ** a.lvl)::bigint), string_agg(a.digest, '' order by a.pos) filter (where a.pos > s.pos // ({FANOUT} ** a.lvl)::bigint)
  from l join s on s.tree = l.tree join high a on a.n > 1 and a.pos // {FANOUT} = s.pos // ({FANOUT} ** (a.lvl + 1))::bigint group by l.tree, l.pos, a.lvl),
p as (select tree, pos, list(coalesce(lhs, '') || '|' || coalesce(rhs, '') order by lvl) as path from steps group by tree, pos),
f as (
  select l.doc_id, l.leaf, s.digest as subroot, (select digest from high where n = 1) as root, sha256(coalesce(replace(array_to_string(p.path, ''), '|', ''), '')) as proof_sha256,
    list_reduce(list_prepend(coalesce(l.tampered, l.leaf), coalesce(p.path, []::varchar[])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) as folded_root
  from l join s on s.tree = l.tree left join p on p.tree = l.tree and p.pos = l.pos)
select *, folded_root = root as verified from f
"""
