"""Cutting lineage of iterative jobs with tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_fallback: dict[str, str] = {}


def scratch_path(spark, tag: str) -> str:
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = d or _fallback.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-waymark-"))
    return f"{d.rstrip('/')}/waymark-{tag}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def location(spark, path: str) -> str:
    """The path with its file system."""
    p, fs = _at(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def version(spark, paths: list[str]) -> tuple:
    """A number for all files under the paths that changes when one of them does: from the path, size and time of change of each. Contents are not read."""
    from pyspark.sql import functions as F

    there = [p for p in paths if exists(spark, p)]
    if not there:
        return ()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def delete(spark, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)
