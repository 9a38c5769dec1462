"""Exact ranks and percentiles without a task that sees all rows: values are counted, dealt out by ranges, and numbered from the counts of the ranges before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions.storage import cut_lineage

#: Distinct values of one range, about; also the rows up to which one task may rank a whole frame.
RANGE_ROWS = 100_000


def intervals(df: DataFrame, by: list[str], value: str, rows: int | None = None) -> DataFrame:
    """(by, value, __n, __start, __total): of each distinct value of a group how many rows have it, how many come before it, and how many the group has. Nulls do not count.

    Equal values are counted before anything moves, so that a value held by very many rows is one row of the sort.
    """
    rows = rows or RANGE_ROWS
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n")), "counts")
    parts = max(1, math.ceil(counts.count() / rows))
    dealt = cut_lineage(counts.repartitionByRange(parts, *by, value).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*by, "__range").agg(F.sum("__n").alias("__s"))  # a row for each range and each group in it
    group = W.partitionBy(*by)
    before = sizes.select(*by, "__range", F.coalesce(F.sum("__s").over(group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__s").over(group).alias("__total"))
    within = F.coalesce(F.sum("__n").over(W.partitionBy(*by, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("__within", within)
    same = [numbered[c].eqNullSafe(before[c]) for c in by]
    joined = numbered.join(before, [*same, numbered["__range"] == before["__range"]])
    return joined.select(*[numbered[c] for c in by], value, "__n", (F.col("__before") + F.col("__within")).alias("__start"), "__total")


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], rows: int | None = None) -> DataFrame:
    """by and a column for each share (name: share from 0 to 1): the value at that share of the sorted rows of a group, between two rows by interpolation."""
    found = intervals(df, by, value, rows)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__start") + F.col("__n")), F.col(value).cast("double")))

    aggs, out = [], []
    for name, share in shares.items():
        place = (F.col("__total") - 1) * share
        aggs += [at(F.floor(place)).alias(f"__{name}_lo"), at(F.ceil(place)).alias(f"__{name}_hi"), F.max(place - F.floor(place)).alias(f"__{name}_f")]
        out.append((F.col(f"__{name}_lo") + (F.col(f"__{name}_hi") - F.col(f"__{name}_lo")) * F.col(f"__{name}_f")).alias(name))
    return found.groupBy(*by).agg(*aggs).select(*by, *out)


def with_ranks(df: DataFrame, by: list[str], values: dict[str, str], rows: int | None = None) -> DataFrame:
    """df with, for each name: column of values, name_up and name_down (rank from the least and from the largest value, ties share the first place), name_mean (mean rank from
    the least) and name_total (rows of the group that have a value). A frame of at most so many rows is ranked by one task a group, a larger one by ranges.
    """
    rows = rows or RANGE_ROWS
    if df.limit(rows + 1).count() <= rows:
        for name, c in values.items():
            group, known = W.partitionBy(*by, F.col(c).isNotNull()), F.col(c).isNotNull()
            put = {f"{name}_up": F.rank().over(group.orderBy(c)), f"{name}_down": F.rank().over(group.orderBy(F.desc(c))), f"{name}_mean": F.rank().over(group.orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2, f"{name}_total": F.count("*").over(group)}
            df = df.withColumns({k: F.when(known, x.cast("double" if k.endswith("mean") else "long")) for k, x in put.items()})
        return df
    for name, c in values.items():
        i = intervals(df, by, c, rows)
        i = i.select(*[F.col(b).alias(f"__b{k}") for k, b in enumerate(by)], F.col(c).alias("__v"), (F.col("__start") + 1).alias(f"{name}_up"), (F.col("__total") - F.col("__start") - F.col("__n") + 1).alias(f"{name}_down"), (F.col("__start") + (F.col("__n") + 1) / 2).alias(f"{name}_mean"), F.col("__total").alias(f"{name}_total"))
        df = df.join(i, [*[F.col(b).eqNullSafe(F.col(f"__b{k}")) for k, b in enumerate(by)], F.col(c) == F.col("__v")], "left").drop("__v", *[f"__b{k}" for k in range(len(by))])
    return df
