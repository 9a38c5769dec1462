"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one on a single machine, and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        d = _fallback.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-waymark-"))
    return d.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/waymark-{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = path or new_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table of this run that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII text takes the fast built-in; other text is translated letter by letter."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: Rows of an Arrow batch to a Python worker; whole texts are long.
TEXT_BATCH_ROWS = 1000


def text_batches(df: DataFrame) -> None:
    """Keep Arrow batches of whole texts small in df's session."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def give_back_memory() -> None:
    """Return what a Python worker has freed to the machine, so that the workers of the next stage find room. Does nothing where the C library cannot."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def row_key(*cols: Column) -> Column:
    """A key that tells rows of different content apart; equal rows share it."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def named(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_rows(docs: DataFrame, **extra: Column) -> DataFrame:
    """(row, ...): every row of docs as one struct beside the extra columns, so that no column of docs can clash with them; select('row.*') undoes it."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in extra.items()])


def groups_for(n: int, per_group: int) -> int:
    return max(1, math.ceil(n / per_group))
