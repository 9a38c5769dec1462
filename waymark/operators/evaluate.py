"""Metrics of predictions, choice of winners, calibration, shrinkage. Column names are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.operators.panel import spearman

#: Predictions below this count as this in deviances.
FLOOR = 1e-6


def deviance(actual: Column, predicted: Column) -> Column:
    """Poisson deviance of one row."""
    p = F.greatest(predicted, F.lit(FLOOR))
    return 2 * (F.when(actual > 0, actual * F.log(actual / p)).otherwise(0.0) - actual + p)


def metric_suite(pred: DataFrame, by: list[str], unit: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """By group: n, mae, rmse, deviance, bias, calibration, totals, and the rank correlation of the units' sums."""
    a, p = F.col(actual), F.col(predicted)
    suite = pred.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), F.avg(deviance(a, p)).alias("deviance"), F.avg(p - a).alias("bias"),
        F.try_divide(F.sum(p), F.sum(a)).alias("calibration"), F.sum(a).alias("actual_total"), F.sum(p).alias("predicted_total"),
    )
    sums = pred.groupBy(*by, unit).agg(F.round(F.sum(a), 6).alias("x"), F.round(F.sum(p), 6).alias("y"))
    return suite.join(spearman(sums, "x", "y", by).drop("max_rank_difference"), by)


def winners(metrics: DataFrame, target: str, model: str, score: str = "deviance") -> DataFrame:
    """metrics (rows of one split) with rank and is_winner: the lowest score of each target; ties to the first name."""
    w = W.partitionBy(target).orderBy(F.round(score, 9), model)
    return metrics.withColumn("rank", F.row_number().over(w)).withColumn("is_winner", F.col("rank") == 1)


def comparison(metrics: DataFrame, target: str = "target", model: str = "model", split: str = "model_split") -> DataFrame:
    """One row for each target and model: validation deviance, and test metrics of the winner alone."""
    v = winners(metrics.filter(F.col(split) == "validation"), target, model).select(target, model, "is_winner", F.col("deviance").alias("validation_deviance"))
    t = metrics.filter(F.col(split) == "test").select(target, model, *[F.col(c).alias(f"test_{c}") for c in ("deviance", "mae")])
    return v.join(t, [target, model]).select(target, model, "is_winner", "validation_deviance", *[F.when(F.col("is_winner"), F.col(f"test_{c}")).alias(f"test_{c}") for c in ("deviance", "mae")])


def calibration_factors(pred: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """by, factor: sum of actual over sum of predicted; an error where that is not positive."""
    f = pred.groupBy(*by).agg((F.sum(actual) / F.nullif(F.sum(predicted), F.lit(0.0))).alias("factor"))
    return f.withColumn("factor", F.when(F.col("factor") > 0, F.col("factor")).otherwise(F.raise_error("the calibration factor is not positive").cast("double")))


def with_pool(df: DataFrame, part: str, whole: str) -> DataFrame:
    """df with __part and __whole: the sums of two columns over all rows, from one aggregate row that is sent to every task."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(part).cast("double").alias("__part"), F.sum(whole).cast("double").alias("__whole"))))


def shrunk(df: DataFrame, part: str, whole: str, strength: float, out: str, fallback: float | None = None) -> DataFrame:
    """df with out: part / whole drawn to the pooled share of all rows with weight whole / (whole + strength)."""
    pooled = F.try_divide("__part", "__whole")
    if fallback is not None:
        pooled = F.coalesce(pooled, F.lit(fallback))
    weight = F.col(whole) / (F.col(whole) + strength)
    share = weight * F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(pooled) + (1 - weight) * pooled
    return with_pool(df, part, whole).withColumn(out, share).drop("__part", "__whole")


def beta_binomial(df: DataFrame, part: str, whole: str, strength: float, out: str) -> DataFrame:
    """df with out: the posterior share under a beta prior at the pooled share of all rows with this strength."""
    share = (F.col(part) + F.col("__part") / F.col("__whole") * strength) / (F.col(whole) + strength)
    return with_pool(df, part, whole).withColumn(out, share).drop("__part", "__whole")


def gamma_moments(units: DataFrame, count: str, exposure: str) -> DataFrame:
    """One row (alpha, beta) of a gamma prior from the moments of the rates; 1, 1 where they have none."""
    m = units.agg(F.avg(F.col(count) / F.col(exposure)).alias("m"), F.var_samp(F.col(count) / F.col(exposure)).alias("v"))
    ok = (F.col("v") > 0) & (F.col("m") > 0)
    return m.select(F.when(ok, F.col("m") * F.col("m") / F.col("v")).otherwise(1.0).alias("alpha"), F.when(ok, F.col("m") / F.col("v")).otherwise(1.0).alias("beta"))


def gamma_posterior(units: DataFrame, prior: DataFrame, count: str, exposure: str) -> DataFrame:
    """units with rate: the posterior mean. prior: one row."""
    return units.crossJoin(F.broadcast(prior)).withColumn("rate", (F.col("alpha") + F.col(count)) / (F.col("beta") + F.col(exposure))).drop("alpha", "beta")


def hindsight(pred: DataFrame, unit: str, split: str, first: str, second: str, worst: int = 3) -> DataFrame:
    """Per unit over two periods: sums, monthly error, absolute and relative error, direction, combined error, and whether it is among the worst."""
    e = pred.filter(F.col(split).isin(first, second)).groupBy(unit, split).agg(F.sum("actual").alias("a"), F.sum("predicted").alias("p"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("m"))
    of = lambda s, tag: e.filter(F.col(split) == s).select(unit, F.col("a").alias(f"actual_{tag}"), F.col("p").alias(f"predicted_{tag}"), F.col("m").alias(f"mae_{tag}"))
    j = of(first, "v").join(of(second, "t"), unit)
    for tag in "vt":
        a, p = F.col(f"actual_{tag}"), F.col(f"predicted_{tag}")
        j = j.withColumns({f"error_{tag}": F.abs(p - a), f"error_pct_{tag}": F.try_divide(F.abs(p - a), a) * 100, f"direction_{tag}": F.when(F.round(p - a, 6) > 0, "over").otherwise("under")})
    j = j.withColumn("combined_error", F.col("error_v") + F.col("error_t"))
    top = j.orderBy(F.round("combined_error", 6).desc(), unit).limit(worst).select(F.col(unit).alias("__worst"))
    return j.join(F.broadcast(top), F.col(unit) == F.col("__worst"), "left").withColumn("among_worst", F.col("__worst").isNotNull()).drop("__worst")
