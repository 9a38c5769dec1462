"""Balanced label propagation: linked documents move to their neighbours' shards under capacity quotas.

DataFrame operations only. A node is a row; what links nodes is a group that they belong to: all rows of equal text, or the two ends of a link. A node starts in the
shard that its own hash names, so that at first nearly all links are cut. Every round, joins by way of the groups bring each linked node the number of its neighbours in
each shard (each group's counts, never its pairs). It proposes the shard that has room and most neighbours, if these are more than where it is; of equally many, if it is the shard of smaller
number. Nodes of several groups take turns by hash, half of them a round, so that neighbours do not swap for ever. Quotas limit the moves between two shards:
opposite moves are matched one for one, and what a shard has free, unlinked nodes left out, is dealt out in proportion to the proposals. Rounds go on until the number of
cut members (away from the shard that most of their group is in) has not fallen for PATIENCE
rounds; the labels with the fewest stay, and a last sweep lets those members join their group that a quota kept back. Then the counts are
made even exactly: shards over their quota give up nodes, unlinked ones first, then whole groups next to each other, to those below; so about one group
is cut for each border between shards, and a group larger than a shard fills shards one after another.

Large groups are hot keys: at most HOT_KEYS groups can have more than 1 / HOT_KEYS of all rows; their counts are sent to every task, and the
rest is joined by a shuffle. Positions within a shard are counted in two levels (bucket, then row within the bucket), and a large group has
several buckets, so no task sees a whole shard.

Defined results: null texts have no bytes and count as empty, and all empty texts form one group; repeated rows are nodes of their own, linked like
other equal texts; of shards with equally many neighbours the one of smaller number is proposed; texts of any length are read once, for size and
hashes; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import delete_path, groups_for, materialize, new_path, text_or_empty

SHARDS = 24
#: Rounds without fewer cuts after which propagation ends; and a bound that only a graph on which cuts fall by ones can meet.
PATIENCE, ROUNDS = 3, 200
#: Slack of a shard over its even share while nodes move, so that groups can pass each other; the last step removes it.
SLACK = 1.0
#: Bound of the number of nodes and groups that count as hot.
HOT_KEYS = 2000
#: Rows of one ranking bucket, about.
BUCKET_ROWS = 20_000


def hot_keys(links: DataFrame, key: str, total: int) -> DataFrame:
    """(key) of the few nodes with more than 1 / HOT_KEYS of all rows of links: at most HOT_KEYS of them."""
    return links.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > max(1000, total // HOT_KEYS)).select(key)


def join_small_or_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left.join(right, key), where right has one row a key; hot: (key) of at most HOT_KEYS keys that many rows of left share."""
    few = F.broadcast(hot)
    direct = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key)
    return direct.unionByName(left.join(few, key, "left_anti").join(right, key))


def star_links(nodes: DataFrame, group: str, total: int) -> DataFrame:
    """(src, dst, n): each node of a group linked to the group's first node, with the group's size. nodes: (nid, group)."""
    first = materialize(nodes.groupBy(group).agg(F.min("nid").alias("dst"), F.count("*").alias("n")).filter("n > 1"), "groups")
    hot = materialize(first.filter(F.col("n") > max(1000, total // HOT_KEYS)).select(group), "hot-groups")
    return join_small_or_hot(nodes, first, group, hot).filter("nid <> dst").select(F.col("nid").alias("src"), "dst", "n")


def with_positions(df: DataFrame, by: str, order: list[Column], total: int, name: str) -> DataFrame:
    """df with a gapless position from 0 within each value of by. Buckets follow the first order column, a double in [0, 1), and __sub, which splits large groups."""
    buckets = groups_for(total, BUCKET_ROWS)
    b = df.withColumn("__b", F.least(F.lit(buckets - 1), F.floor(order[0] * buckets)).cast("int"))
    sizes = b.groupBy(by, "__b", "__sub").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(by).orderBy("__b", "__sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    ranked = b.withColumn("__k", F.row_number().over(W.partitionBy(by, "__b", "__sub").orderBy(*order)) - 1)
    return ranked.join(before, [by, "__b", "__sub"]).withColumn(name, (F.col("__before") + F.col("__k")).cast("long")).drop("__b", "__k", "__before")


def _unit(*cols) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


#: Shards of a group that its members hear of: those with room and most members.
HEARD = 4


def _heard(at: DataFrame, sizes: DataFrame, cap: float) -> DataFrame:
    """(group, held, top, away): a group's members by shard, its HEARD best shards with room, and how many members are not in its main shard. at: (nid, group, now); sizes: (shard, size), a row for each shard."""
    counts = at.groupBy("group", "now").agg(F.count("*").alias("n")).join(F.broadcast(sizes.withColumnRenamed("shard", "now")), "now", "left")
    one = F.struct(F.col("n"), (-F.col("now")).alias("first"), (F.lit(cap) - F.col("size") >= 1).alias("open"))
    g = counts.groupBy("group").agg(F.sort_array(F.collect_list(one), asc=False).alias("a"), (F.sum("n") - F.max("n")).alias("away"))  # at most as many entries as shards
    top = F.slice(F.filter("a", lambda x: x["open"]), 1, HEARD)
    return g.select("group", F.map_from_entries(F.transform("a", lambda x: F.struct(-x["first"], x["n"]))).alias("held"), F.transform(top, lambda x: F.struct((-x["first"]).alias("shard"), x["n"].alias("n"))).alias("top"), "away")


def _wishes(at: DataFrame, heard: DataFrame, hot: DataFrame, number: int) -> DataFrame:
    """(nid, now, target): the moves that nodes propose in a round."""
    met = join_small_or_hot(at, heard, "group", hot)
    mine = met.groupBy("nid", "now").agg(F.count("*").alias("groups"), F.sum(F.col("held")[F.col("now")]).alias("stay"))
    # a node of several groups does not count itself; one of a single group does, so that of two shards with equally many members one gives way
    mine = mine.filter((F.col("groups") == 1) | (_unit("nid", F.lit(-number - 1)) < 0.5)).withColumn("stay", F.col("stay") - F.when(F.col("groups") > 1, F.col("groups")).otherwise(0))
    other = met.select("nid", "now", F.explode("top").alias("t")).groupBy("nid", "t.shard").agg(F.sum(F.col("t.n") - (F.col("t.shard") == F.col("now")).cast("int")).alias("score"))
    best = other.groupBy("nid").agg(F.max(F.struct("score", (-F.col("shard")).alias("first"))).alias("top"))
    found = mine.join(best, "nid").select("nid", "now", (-F.col("top.first")).alias("target"), F.col("top.score").alias("score"), "stay", "groups")
    return found.filter((F.col("target") != F.col("now")) & ((F.col("score") > F.col("stay")) | ((F.col("groups") == 1) & (F.col("score") == F.col("stay")) & (F.col("target") < F.col("now"))))).drop("score", "stay", "groups")


def _round(labels: DataFrame, wish: DataFrame, sizes: DataFrame, cap: float, number: int) -> DataFrame:
    """One round: (nid, shard, moved) of the linked nodes after the moves that the quotas let pass. Nodes without links take no room: they give way at the end."""
    flows = wish.groupBy("now", "target").agg(F.count("*").alias("n"))  # at most shards x shards rows
    back = flows.select(F.col("now").alias("target"), F.col("target").alias("now"), F.col("n").alias("m"))
    paired = flows.join(back, ["now", "target"], "left").withColumn("m", F.least("n", F.coalesce("m", F.lit(0))))
    rest = F.sum(F.col("n") - F.col("m")).over(W.partitionBy("target"))
    room = F.greatest(F.lit(0.0), F.lit(cap) - F.coalesce("size", F.lit(0)))
    quota = paired.join(sizes.withColumnRenamed("shard", "target"), "target", "left").withColumn("share", F.when(rest > 0, F.least(F.lit(1.0), room / rest)).otherwise(0.0))
    quota = quota.select("now", "target", ((F.col("m") + (F.col("n") - F.col("m")) * F.col("share")) / F.col("n")).alias("pass"))
    moves = wish.join(F.broadcast(quota), ["now", "target"]).filter(_unit("nid", F.lit(number)) < F.col("pass")).select("nid", "target")
    return labels.select("nid", "shard").join(moves, "nid", "left").select("nid", F.coalesce("target", "shard").alias("shard"), F.col("target").isNotNull().alias("moved"))


def pair_groups(links: DataFrame) -> DataFrame:
    """(nid, group) of links (src, dst): each link is a group of two."""
    numbered = materialize(links.select("src", "dst", F.monotonically_increasing_id().alias("group")), "links")
    return numbered.select(F.col("src").alias("nid"), "group").unionByName(numbered.select(F.col("dst").alias("nid"), "group"))


def propagate(nodes: DataFrame, members: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """(nid, shard): near-even label propagation from hashed shards. nodes: (nid); members: (nid, group) of groups of two or more. report gets (moved, cut members) of the start and of every round."""
    spark = nodes.sparkSession
    members = materialize(members.select("nid", "group"), "members")
    hot = materialize(hot_keys(members, "group", total), "hot-groups")
    start = nodes.select("nid", F.floor(_unit("nid") * shards).cast("int").alias("shard"))
    linked = members.select("nid").distinct()
    cap, report = total / shards * (1 + SLACK), [] if report is None else report
    path = new_path(spark, "labels")
    labels = materialize(start.join(linked, "nid", "left_semi").withColumn("moved", F.lit(False)), "labels", path)
    best, fewest, waited = (labels, path), None, 0
    for number in range(rounds + 1):
        at_path, heard_path = new_path(spark, "at"), new_path(spark, "heard")
        at = materialize(members.join(labels.select("nid", F.col("shard").alias("now")), "nid"), "at", at_path)
        sizes = labels.groupBy("shard").agg(F.count("*").alias("size"))
        heard = materialize(_heard(at, sizes, cap), "heard", heard_path)
        cut = heard.agg(F.sum("away")).first()[0] or 0
        report.append((labels.filter("moved").count(), cut))
        waited = 0 if fewest is None or cut < fewest else waited + 1
        if waited == 0:
            old, best, fewest = best, (labels, path), cut
            if old[1] != path:
                delete_path(spark, old[1])
        go_on = cut > 0 and waited < PATIENCE and number < rounds
        if go_on:
            path = new_path(spark, "labels")
            labels = materialize(_round(labels, _wishes(at, heard, hot, number), sizes, cap, number), "labels", path)
        delete_path(spark, heard_path)
        delete_path(spark, at_path)
        if not go_on:
            break
    return start.join(linked, "nid", "left_anti").unionByName(best[0].select("nid", "shard"))


def settle(labels: DataFrame, members: DataFrame, total: int) -> DataFrame:
    """(nid, shard): the last sweep, without quotas, of groups that share no node: members away from their group's main shard join it. The evening that follows restores the sizes."""
    members = materialize(members.select("nid", "group"), "settled-members")
    hot = materialize(hot_keys(members, "group", total), "settled-hot")
    counts = members.join(labels, "nid").groupBy("group", "shard").agg(F.count("*").alias("n"))
    main = materialize(counts.groupBy("group").agg((-F.max(F.struct("n", (-F.col("shard")).alias("first")))["first"]).alias("main")), "main-shards")
    new = join_small_or_hot(members, main, "group", hot).select("nid", "main")
    return labels.join(new, "nid", "left").select("nid", F.coalesce("main", "shard").alias("shard"))


def even_out(labels: DataFrame, linked: DataFrame, total: int, shards: int = SHARDS) -> DataFrame:
    """(nid, shard, __o, __sub) with counts at most one apart. linked: (nid, lead, n) of the linked nodes, n the size of their group; others are given up first."""
    spark = labels.sparkSession
    quota = F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    keyed = labels.join(linked, "nid", "left").withColumn("__sub", F.pmod(F.xxhash64("nid"), F.greatest(F.lit(1), F.coalesce(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(1)))).cast("int"))
    # linked nodes first, those of one group next to each other; what lies beyond the quota moves
    order = F.when(F.col("lead").isNotNull(), _unit("lead") / 2).otherwise(_unit("nid") / 2 + 0.5)
    placed = with_positions(keyed.withColumn("__o", order), "shard", [F.col("__o"), F.col("nid")], total // shards + 1, "pos")
    placed = materialize(placed.withColumn("over", F.col("pos") >= quota).select("nid", "shard", "pos", "over", "__o", "__sub"), "placed")
    sizes = placed.groupBy("shard").agg(F.count_if(~F.col("over")).alias("held"), F.count_if("over").alias("spare"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(sizes, "shard", "left").fillna(0, ["held", "spare"]).withColumn("quota", quota)
    running = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # over one row for each shard
    every = every.withColumn("spare_before", F.coalesce(F.sum("spare").over(running), F.lit(0))).withColumn("free_before", F.coalesce(F.sum(F.col("quota") - F.col("held")).over(running), F.lit(0)))
    every = materialize(every, "shard-sizes")
    spare = placed.filter("over").join(F.broadcast(every.select("shard", "spare_before", "quota")), "shard").withColumn("turn", F.col("spare_before") + F.col("pos") - F.col("quota"))
    free = every.filter("quota > held").select(F.col("shard").alias("to"), "free_before", (F.col("free_before") + F.col("quota") - F.col("held")).alias("free_after"))
    gaps = free.agg(F.array_sort(F.collect_list(F.struct("free_after", "to"))).alias("gaps"))  # one row of at most so many entries as shards
    moved = spare.crossJoin(F.broadcast(gaps)).select("nid", F.expr("filter(gaps, g -> turn < g.free_after)[0].to").alias("to"))
    return placed.join(moved, "nid", "left").select("nid", F.coalesce("to", "shard").alias("shard"), "__o", "__sub")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; documents of equal text are linked."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(
        F.monotonically_increasing_id().alias("nid"), F.col(id_col).alias("__id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("group")
    )
    rows = materialize(rows, "nodes")
    total = rows.count()
    links = materialize(star_links(rows.select("nid", "group"), "group", total), "star")
    linked = links.select(F.col("src").alias("nid"), F.col("dst").alias("lead"), "n").unionByName(links.select(F.col("dst").alias("nid"), F.col("dst").alias("lead"), "n").distinct())
    members = linked.select("nid", F.col("lead").alias("group"))
    labels = even_out(settle(propagate(rows.select("nid"), members, total, shards), members, total), linked, total, shards)
    slots = with_positions(materialize(labels, "even"), "shard", [F.col("__o"), F.col("nid")], total // shards + 1, "slot").select("nid", "shard", "slot")
    return rows.join(slots, "nid").select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def cut_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """One row: links and those between two shards."""
    a, b = labels.select(F.col("nid").alias("src"), F.col("shard").alias("s")), labels.select(F.col("nid").alias("dst"), F.col("shard").alias("t"))
    return links.join(a, "src").join(b, "dst").agg(F.count("*").alias("links"), F.count_if(F.col("s") != F.col("t")).alias("cut"))
