"""All registered queries of the analytics operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from waymark.plans import frames, library
from waymark.plans.statements import STATEMENTS
from waymark.proxy import run_sql, with_views


def _statement(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return run_sql(spark, sf_dir, text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: partial(_statement, text=v) for k, v in STATEMENTS.items()} | frames.QUERIES | library.QUERIES


def oracle_sql() -> dict[str, str]:
    # one name differs: the anti join
    return {k: with_views(v).replace(" LEFT ANTI JOIN ", " ANTI JOIN ") for k, v in (STATEMENTS | frames.ORACLES | library.ORACLES).items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.QUERIES["flagship_top_units"](spark, sf_dir)
