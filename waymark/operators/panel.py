"""Panels of units by month and their features. Column names are parameters; the grid of months comes from the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.operators.order import with_ranks


def month_grid(events: DataFrame, month: str = "month_start") -> DataFrame:
    """(month_start, yr, mon, qtr): every month from the first to the last one of events, also those without any."""
    ends = events.agg(F.min(month).alias("a"), F.max(month).alias("z")).filter("a is not null")
    m = ends.select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias(month))
    return m.select(month, F.year(month).alias("yr"), F.month(month).alias("mon"), F.quarter(month).alias("qtr"))


def severity_counts(events: DataFrame, by: list[str], severity: str, levels: str, severe: str) -> DataFrame:
    """A column of counts for each level (lower case), total and ksi (levels that count as severe), by group. Other levels count as the last one."""
    known = F.col(severity).isin(*levels[:-1])
    each = [F.count_if(F.col(severity) == x).alias(x.lower()) for x in levels[:-1]] + [F.count_if(~F.coalesce(known, F.lit(False))).alias(levels[-1].lower())]
    return events.groupBy(*by).agg(*each, F.count("*").alias("total"), F.count_if(F.col(severity).isin(*severe)).alias("ksi"))


def zero_filled(grid: DataFrame, facts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every row of grid with the values of facts, 0 where there are none. facts: one row a key."""
    return grid.join(facts.select(*keys, *values), keys, "left").fillna(0, values)


def build_panel(units: DataFrame, events: DataFrame, unit: str, month: str, severity: str, levels: str = "KABCOU", severe: str = "KA") -> DataFrame:
    """One row for each unit and month, with counts by severity; units without events have zeros."""
    counts = severity_counts(events, [unit, month], severity, levels, severe)
    grid = units.crossJoin(F.broadcast(month_grid(events, month)))  # months are few
    return zero_filled(grid, counts, [unit, month], [*levels.lower(), "total", "ksi"])


def with_lags(df: DataFrame, unit: str, month: str, values: list[str], lags: tuple[int, ...]) -> DataFrame:
    w = W.partitionBy(unit).orderBy(month)
    return df.withColumns({f"{v}_lag{k}": F.lag(v, k).over(w) for v in values for k in lags})


def with_trailing(df: DataFrame, unit: str, month: str, values: list[str], frames: tuple[int, ...], how: str) -> DataFrame:
    """Means or sums of the rows before, without the current one; null until the frame is full. how: mean or sum."""
    w = W.partitionBy(unit).orderBy(month)
    f = F.avg if how == "mean" else F.sum
    return df.withColumns({f"{v}_{how}{n}": F.when(F.row_number().over(w) > n, f(v).over(w.rowsBetween(-n, -1))) for v in values for n in frames})


def with_history(df: DataFrame, unit: str, month: str, needed: int = 12) -> DataFrame:
    w = W.partitionBy(unit).orderBy(month)
    return df.withColumn("history", F.row_number().over(w) - 1).withColumn("model_ready", F.col("history") >= needed)


def split_label(year: Column, warmup: int, train_until: int, validation: int, test: int) -> Column:
    return F.when(year == warmup, "warmup").when((year > warmup) & (year <= train_until), "train").when(year == validation, "validation").when(year == test, "test").otherwise("unknown")


def with_calendar(df: DataFrame, mon: str, year: str, base_year: int) -> DataFrame:
    turn = 2 * math.pi * F.col(mon) / 12
    return df.withColumns({"year_trend": (F.col(year) - base_year).cast("double"), "month_sin": F.sin(turn), "month_cos": F.cos(turn)})


LAGS, FRAMES = (1, 3, 6, 12), (3, 6, 12)


def build_features(panel: DataFrame, unit: str, month: str, values: list[str], base_year: int) -> DataFrame:
    """panel with history, lags, trailing means and sums of the values, and calendar terms: all over one window."""
    d = with_lags(with_history(panel, unit, month), unit, month, values, LAGS)
    d = with_trailing(with_trailing(d, unit, month, values, FRAMES, "mean"), unit, month, values, FRAMES, "sum")
    return with_calendar(d, "mon", "yr", base_year)


def feature_names(values: list[str]) -> list[str]:
    """The numeric predictors of build_features."""
    return [f"{v}_{x}" for v in values for x in [*(f"lag{k}" for k in LAGS), *(f"mean{n}" for n in FRAMES), *(f"sum{n}" for n in FRAMES)]] + ["year_trend", "month_sin", "month_cos"]


def trend(panel: DataFrame, unit: str, month: str, value: str, rows: int = 12, limit: float = 5.0) -> DataFrame:
    """Per unit: means of the first and last rows, change in per cent, slope on the position, and class of the trend."""
    up, down = W.partitionBy(unit).orderBy(month), W.partitionBy(unit).orderBy(F.desc(month))
    d = panel.select(unit, F.col(value).cast("double").alias("v"), F.row_number().over(up).alias("up"), F.row_number().over(down).alias("down"))
    d = d.groupBy(unit).agg(F.avg(F.when(F.col("up") <= rows, F.col("v"))).alias("first_mean"), F.avg(F.when(F.col("down") <= rows, F.col("v"))).alias("last_mean"), F.regr_slope("v", F.col("up").cast("double")).alias("slope"))
    change = (F.try_divide("last_mean", "first_mean") - 1) * 100
    kind = F.when(F.round("change_pct", 6) > limit, "increasing").when(F.round("change_pct", 6) < -limit, "decreasing").otherwise("stable")
    return d.withColumn("change_pct", change).withColumn("trend", kind)


def anomalies(panel: DataFrame, unit: str, value: str, sigmas: float = 3.0) -> DataFrame:
    """Rows above mean + sigmas standard deviations of their unit, with the excess."""
    w = W.partitionBy(unit)
    return panel.withColumn("excess", F.col(value) - F.avg(value).over(w) - sigmas * F.stddev_samp(value).over(w)).filter(F.round("excess", 6) > 0)


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Correlation of average ranks and the largest difference of descending ranks, by group, over rows that have both values."""
    by = by or []
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    r = with_ranks(both, by, {"rx": "x", "ry": "y"}, rows)
    return r.groupBy(*by).agg(F.corr("rx_mean", "ry_mean").alias("spearman"), F.max(F.abs(F.col("rx_down") - F.col("ry_down"))).alias("max_rank_difference"))
