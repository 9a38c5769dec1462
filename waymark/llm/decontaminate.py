"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is 13 consecutive words of an item (a shorter item is one window). A window stands in a
document exactly if its words stand there in sequence, so all of its five-word shingles do: for full containment one
necessary shingle is the whole prefix.

1. Rarity: one pass over the texts counts the documents' shingles that some window has.
2. Prefix: each window is named by its rarest shingle; windows with a shingle that no document has are dropped.
3. Join: a second pass joins the prefix shingles alone. The shingle's offset gives the one place where the window can start; that place is
   bounded by the text's ends, and the window's words are compared with those that stand there.

Texts are never shuffled while the benchmark has at most BROADCAST_ROWS shingles; a larger benchmark is joined by a
shuffle on the shingle (where Spark splits a frequent one among tasks), and the words are fetched for the bounded places that are left.

Defined results: null or wordless texts have no words and are clean; wordless items have no window; items with equal
windows all count; items without an id count as one item of empty id; equal rows get equal results; empty tables give empty or clean
results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import ascii_lower, materialize, text_or_empty, whole_rows

WINDOW = 13
SHINGLE = 5
#: Distinct benchmark shingles (16 bytes each) up to which they are sent to every task.
BROADCAST_ROWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text_or_empty(text)), SEPARATORS), "")


def _shingle_hashes(w: Column, n: Column, k: int) -> Column:
    empty = F.array().cast("array<bigint>")
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(empty)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, w, wlen): the windows of every item; w is the array of words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - (WINDOW - 1))))
    return items.withColumn("start", starts).select("item_id", F.slice("words", F.col("start"), F.least(F.col("n"), F.lit(WINDOW))).alias("w")).withColumn("wlen", F.size("w"))


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(window, wlen, k, off, h) of distinct windows; window is their text."""
    distinct = windows.select("w", "wlen").distinct()
    parts = None
    for k in range(1, SHINGLE + 1):
        own = distinct.filter(F.least(F.col("wlen"), F.lit(SHINGLE)) == k)
        part = own.select(F.array_join("w", " ").alias("window"), "wlen", F.lit(k).alias("k"), F.posexplode(_shingle_hashes(F.col("w"), F.col("wlen"), k)).alias("off", "h"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _hashed(docs: DataFrame, ks: list[int]) -> DataFrame:
    """docs with words w, n_words and hs: the hashes of all shingles, of each length in turn, and a null."""
    src = docs.withColumn("w", words_of(F.col("__text"))).withColumn("n_words", F.size("w"))
    w, n = F.col("w"), F.col("n_words")
    return src.withColumn("hs", F.concat(*[_shingle_hashes(w, n, k) for k in ks], F.array(F.lit(None).cast("bigint"))))


def _position(ks: list[int]) -> Column:
    """The place in the text of the shingle of length k at idx of hs; negative if the shingle there is shorter."""
    before, at = [], F.lit(0)
    for k in ks:
        before.append(F.when(F.col("k") == k, at))
        at = at + F.greatest(F.lit(0), F.col("n_words") - (k - 1))
    return F.col("idx") - F.coalesce(*before, F.lit(0))


def _rarest(docs: DataFrame, shingles: DataFrame, ks: list[int], small: bool) -> DataFrame:
    """(window, wlen, k, off, h): the prefix of every window that can stand in some document."""
    known = shingles.select("h").distinct()
    # outer: hs is never empty, and the plain form puts a filter on its size below, where the words would be split again for each shingle
    seen = _hashed(docs, ks).select(F.explode_outer("hs").alias("h")).join(F.broadcast(known) if small else known, "h")
    counts = seen.groupBy("h").agg(F.count("*").alias("seen"))
    named = shingles.join(counts, "h", "left").groupBy("window", "wlen").agg(
        F.min_by(F.struct("off", "h", "k"), F.struct("seen", "off")).alias("p"), F.bool_and(F.col("seen").isNotNull()).alias("all_seen")
    )
    return named.filter("all_seen").select("window", "wlen", "p.off", "p.h", "p.k")


def _standing(docs: DataFrame, prefixes: DataFrame, ks: list[int], small: bool) -> DataFrame:
    """(__id, __rid, n_words, start, end, window): where windows stand, and a row with null window for every document."""
    src = _hashed(docs, ks)
    start = F.col("pos") - F.col("off")
    bounded = (F.col("pos") >= 0) & (start >= 0) & (start + F.col("wlen") <= F.col("n_words"))
    exact = F.array_join(F.slice("w", F.col("start") + 1, F.col("wlen")), " ") == F.col("window")
    out = ["__id", "__rid", "n_words", "start", (F.col("start") + F.col("wlen")).alias("end"), "window"]
    if small:
        met = src.select("__id", "__rid", "n_words", "w", F.posexplode_outer("hs").alias("idx", "h")).join(F.broadcast(prefixes), "h", "left").filter("h is null or window is not null")
        met = met.withColumn("pos", _position(ks)).withColumn("start", F.when(bounded, start))
        return met.filter(F.col("h").isNull() | (F.col("start").isNotNull() & exact)).select(*out)
    met = src.select("__id", "__rid", "n_words", F.posexplode_outer("hs").alias("idx", "h")).filter("h is not null").join(prefixes, "h").withColumn("pos", _position(ks)).filter(bounded)
    met = met.select(F.col("__id").alias("b_id"), F.col("__rid").alias("b_rid"), F.struct(start.alias("start"), "wlen", "window").alias("m")).groupBy("b_id", "b_rid").agg(F.collect_set("m").alias("m"))
    kind = met.schema["m"].dataType
    found = src.join(met, F.col("__id").eqNullSafe(F.col("b_id")) & (F.col("__rid") == F.col("b_rid")), "left").withColumn("m", F.coalesce(F.col("m"), F.array().cast(kind)))
    found = found.select("__id", "__rid", "n_words", "w", F.explode(F.concat("m", F.array(F.lit(None).cast(kind.elementType)))).alias("x")).select("__id", "__rid", "n_words", "w", "x.*")
    return found.filter(F.col("window").isNull() | exact).select(*out)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of docs: __id, __rid (hash of id and text), n_words, n_hit, n_items, items (sorted texts of the ids of items with occurring windows)."""
    docs = docs.select(F.col(id_col).alias("__id"), F.xxhash64(id_col, text_col).alias("__rid"), F.col(text_col).alias("__text"))
    windows = materialize(benchmark_windows(benchmark.select("item_id", "text")), "windows")
    shingles = materialize(_window_shingles(windows), "window-shingles")
    known = shingles.select("h", "k").distinct()
    ks = [r.k for r in known.select("k").distinct().orderBy("k").collect()]  # at most five numbers
    small = known.count() <= broadcast_rows  # and so are the prefixes, one a window
    prefixes = materialize(_rarest(docs, shingles, ks, small), "prefixes")
    occ = materialize(_standing(docs, prefixes, ks, small), "standing")
    hits = occ.filter("window is not null").select("__id", "__rid", "start", "end", "window").distinct()

    order = W.partitionBy("__id", "__rid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select("__id", "__rid", "start", "end").distinct().withColumn("reach", F.coalesce(F.max("end").over(order), F.lit(0)))
    n_hit = spans.groupBy("__id", "__rid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).alias("n_hit"))
    owners = windows.select(F.array_join("w", " ").alias("window"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    items = hits.select("__id", "__rid", "window").distinct().join(owners, "window").groupBy("__id", "__rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_doc = n_hit.join(items, n_hit["__id"].eqNullSafe(items["__id"]) & (n_hit["__rid"] == items["__rid"])).select(n_hit["__id"].alias("d_id"), n_hit["__rid"].alias("d_rid"), "n_hit", "items")
    rows = occ.filter("window is null").select("__id", "__rid", "n_words")
    return rows.join(per_doc, F.col("__id").eqNullSafe(F.col("d_id")) & (F.col("__rid") == F.col("d_rid")), "left").select(
        "__id", "__rid", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return scan(docs, benchmark, broadcast_rows=broadcast_rows).select(
        F.col("__id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that are not contaminated."""
    bad = scan(docs, benchmark).filter(contaminated(F.col("n_hit"), F.col("n_words"))).select("__id", "__rid").distinct()
    bad = materialize(bad.withColumnsRenamed({"__id": "__b", "__rid": "__r"}), "contaminated")
    rows = whole_rows(docs, __id=F.col("doc_id"), __rid=F.xxhash64("doc_id", "text"))
    return rows.join(bad, F.col("__id").eqNullSafe(F.col("__b")) & (F.col("__rid") == F.col("__r")), "left_anti").select("row.*")
