"""Document fingerprints from closed syncmers, in DataFrame operations only.

A k-mer of code points is a closed syncmer if the smallest hash of its inner s-mers lies at its first or last
s-mer. Whether it is one depends on the k-mer alone, so an edit changes only the anchors that it
touches. A fingerprint is the SKETCH smallest 31-bit hashes of the distinct syncmers (a bottom-k sketch, written as hex);
the likeness of two is the Jaccard estimate from the sketch of their union. anchors() gives all
syncmers with their positions.

Being context-free, the anchors of an edited text are those of its kept part, of the part lent by the next document and of
the few k-mers across the joint. So every text is gone through once, before any shuffle; what is shuffled are the kept half, the
lent half and sketches, dealt out by the document they belong to. The order of documents is a small table that goes
to the texts: to every task up to BROADCAST_ROWS documents, beyond that by a join. Long texts are cut into chunks of CHUNK
code points, overlapping by k - 1, whose sketches are put together.

Defined results: null texts count as empty; an empty text has an empty fingerprint, like (1) only another empty one; a text
shorter than k is one anchor; repeated rows get equal results and count once in the order of documents; of documents with equal ids
the order is that of a hash of the text; null ids come last; a table of one document is its own
next document; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import groups_for, materialize, text_or_empty

K, S = 7, 4  # the first and last s-mer cover the k-mer
SKETCH = 64
CHUNK = 1 << 16
RANGE_ROWS = 100_000
#: Rows of the order of documents (under 100 bytes each) up to which they are sent to every task.
BROADCAST_ROWS = 1_000_000
_MASK = 0x7FFFFFFF


def _none() -> Column:
    return F.array().cast("array<int>")


def _hash(*c: Column) -> Column:
    return F.xxhash64(*c).bitwiseAND(F.lit(_MASK)).cast("int")


def add_ids(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: at each position of a text without nulls the id of the k-mer that starts there, null where it is no closed syncmer."""
    c, p, h, n = (f"__{x}_{out}" for x in "cphn")
    # arrays shifted against each other meet in zip_with; what runs past the end is cut off at last
    shift = lambda x, by: F.slice(F.col(x), F.lit(by + 1), F.greatest(F.col(n), F.lit(1)))
    d = df.withColumn(n, F.length(text)).withColumn(c, F.split(F.col(text), ""))
    d = d.withColumn(p, F.zip_with(c, shift(c, 1), lambda a, b: F.xxhash64(a, b))).drop(c)
    d = d.withColumn(h, F.zip_with(p, shift(p, 2), lambda a, b: F.xxhash64(a, b))).drop(p)
    d = d.withColumn("__i", F.zip_with(shift(h, 1), shift(h, 2), lambda a, b: F.least(a, b)))
    trio = F.arrays_zip(F.col(h).alias("a"), shift(h, K - S).alias("z"), F.col("__i").alias("i"))
    ids = F.transform(trio, lambda x: F.when(F.least(x["a"], x["z"]) <= x["i"], _hash(x["a"], x["z"])))
    return d.withColumn(out, F.when(F.col(n) >= K, F.slice(ids, F.lit(1), F.greatest(F.col(n) - (K - 1), F.lit(1)))).otherwise(_none())).drop(h, n, "__i")


def _bottom(ids: Column) -> Column:
    return F.slice(F.sort_array(F.array_except(ids, F.array(F.lit(None).cast("int")))), 1, SKETCH)  # distinct, without nulls


def _whole(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.array(_hash(text))).otherwise(_none())


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, anchor): every closed syncmer with its position in code points from 0."""
    d = add_ids(docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("__t")), "__t", "__ids")
    # outer: the plain form puts a filter on the array's size below, where it would be computed twice
    return d.select(id_col, F.posexplode_outer("__ids").alias("pos", "anchor")).filter("anchor is not null")


def preceding(keys: DataFrame, total: int) -> DataFrame:
    """keys (id, rid, n, times) with prev_id, prev_rid, lend: the document that each one follows by descending id, and half its length. The first follows the last."""
    parts = groups_for(total, RANGE_ROWS)
    ranged = keys.repartitionByRange(parts, F.col("id").desc_nulls_last(), F.col("rid"))
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "order")
    w = W.partitionBy("part").orderBy(F.col("id").desc_nulls_last(), "rid")
    this = F.struct("id", "rid", "n")
    inner = ranged.withColumn("before", F.lag(this).over(w))
    # one row for each range
    lasts = ranged.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), F.desc("rid")))).filter("r = 1").select("part", this.alias("last"))
    byp = W.orderBy("part")
    lasts = lasts.select("part", F.coalesce(F.lag("last").over(byp), F.last("last").over(byp.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("wrap"))
    b = inner.join(F.broadcast(lasts), "part").withColumn("before", F.coalesce("before", "wrap"))
    return b.select("id", "rid", "n", "times", F.col("before.id").alias("prev_id"), F.col("before.rid").alias("prev_rid"), F.expr("cast(before.n div 2 as int)").alias("lend"))


def _dealt(linked: DataFrame) -> DataFrame:
    """One row for each document and one for the document before it, for each chunk: halves of the text and sketches. linked: (id, rid, text, n, times, prev_id, prev_rid, lend)."""
    keep = F.expr("n - cast(n div 2 as int)")
    at = F.when(F.col("n") > CHUNK, F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK))).otherwise(F.array(F.lit(0)))
    d = linked.withColumn("keep", keep).withColumn("at", F.explode_outer(at))
    d = d.withColumn("piece", F.when(F.col("n") > CHUNK, F.substring("text", F.col("at") + 1, F.lit(CHUNK + K - 1))).otherwise(F.col("text")))
    d = d.withColumn("kept", F.when(F.col("at") == 0, F.substring("text", F.lit(1), F.col("keep")))).withColumn("lent", F.when(F.col("at") == 0, F.substring("text", F.lit(1), F.col("lend")))).drop("text")
    d = add_ids(d, "piece", "ids")
    upto = lambda size: F.slice("ids", F.lit(1), F.greatest(F.lit(0), size - (K - 1) - F.col("at")))
    d = d.withColumn("own", F.when(F.col("n") >= K, _bottom(F.col("ids"))).otherwise(_whole(F.col("piece"))))
    d = d.withColumn("own_kept", _bottom(upto(F.col("keep")))).withColumn("own_lent", _bottom(upto(F.least("lend", "n")))).drop("ids", "piece")
    null = lambda t: F.lit(None).cast(t)
    sketch = "array<int>"
    mine = F.struct("id", "rid", "n", "times", "kept", null("string").alias("lent"), "own", F.col("own_kept").alias("parts"), null(sketch).alias("next"))
    lent = F.struct(F.col("prev_id").alias("id"), F.col("prev_rid").alias("rid"), null("int").alias("n"), null("bigint").alias("times"), null("string").alias("kept"), "lent", null(sketch).alias("own"), F.col("own_lent").alias("parts"), F.col("own").alias("next"))
    return d.select(F.explode_outer(F.array(mine, lent)).alias("r")).select("r.*")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text")).withColumn("rid", F.xxhash64("text"))
    counted = rows.select("id", "rid", F.length("text").alias("n")).groupBy("id", "rid").agg(F.first("n").alias("n"), F.count("*").alias("times"))
    counted = materialize(counted, "texts")
    total = counted.count()
    if not counted.filter("times > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "rid"])
    link = materialize(preceding(counted, total), "links").withColumnRenamed("id", "l_id").withColumnRenamed("rid", "l_rid")
    sent = F.broadcast(link) if total <= broadcast_rows else link
    linked = rows.join(sent, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("rid") == F.col("l_rid"))).drop("l_id", "l_rid")
    # dealt out first: halves and sketches are not put together before the shuffle
    met = _dealt(linked).repartition("id", "rid").groupBy("id", "rid").agg(
        *[F.max(c).alias(c) for c in ("n", "times", "kept", "lent")], *[_bottom(F.flatten(F.collect_list(c))).alias(c) for c in ("own", "parts", "next")]
    )
    joint = F.concat(F.substring("kept", F.greatest(F.lit(1), F.length("kept") - (K - 2)), F.lit(K - 1)), F.substring("lent", 1, K - 1))
    edited = F.concat("kept", "lent")
    done = met.withColumn("size", F.length("kept") + F.length("lent")).withColumn("edited_sha256", F.sha2(edited, 256)).withColumn("short", F.when(F.col("size") < K, edited)).withColumn("joint", joint).drop("kept", "lent")
    done = add_ids(done, "joint", "ids").withColumn("edited", F.when(F.col("size") >= K, _bottom(F.concat("parts", "ids"))).otherwise(_whole(F.col("short"))))
    done = done.filter("times > 0").withColumn("__t", F.explode_outer(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return done.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
