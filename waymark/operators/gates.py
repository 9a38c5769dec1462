"""Gates: named checks over a table in one pass, with evidence, and the rolled-up status."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CRITICAL, WARNING = "CRITICAL", "WARNING"


def rolled_up(rows: DataFrame) -> DataFrame:
    """rows (check_name, severity, passed, evidence) with status: FAIL if a critical check failed, PASS_WITH_WARNINGS if another did, else PASS."""
    every = W.partitionBy()  # one row a check
    failed = lambda c: F.max(c & ~F.coalesce("passed", F.lit(False))).over(every)
    return rows.withColumn("status", F.when(failed(F.col("severity") == CRITICAL), "FAIL").when(failed(F.lit(True)), "PASS_WITH_WARNINGS").otherwise("PASS"))


def offences(df: DataFrame, checks: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(check_name, severity, passed, evidence): checks maps a name to its severity and an aggregate that counts offences; a check passes at 0."""
    counted = df.agg(*[F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"c{k}") for k, (_, c) in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), (F.col(f"c{k}") == 0).alias("passed"), F.col(f"c{k}").alias("evidence")) for k, (n, (s, _)) in enumerate(checks.items())])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def gate(*parts: DataFrame) -> DataFrame:
    """The check rows of all parts with their common status."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rolled_up(rows)


def bad(condition: Column | str) -> Column:
    """Rows for which a condition holds."""
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def repeated(*keys: str) -> Column:
    """Rows whose key is not the first of its kind."""
    return F.count("*") - F.count_distinct(F.struct(*keys))
