"""Paged snapshots: text parts with a manifest, GeoJSON pages, gated sinks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.storage import cut_lineage, location

#: Bytes of a file that a checksum task holds.
CHUNK_BYTES = 8_000_000
#: File systems whose files the workers open by themselves.
STREAMED = ("file", "hdfs", "gs", "s3")


def read_text_parts(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Union of CSV parts (also gzipped) as strings of a fixed column list; nothing is inferred."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("enforceSchema", False).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(folder)


def write_parts(df: DataFrame, folder: str, compression: str = "gzip") -> None:
    df.select([F.col(c).cast("string").alias(c) for c in df.columns]).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("compression", compression).csv(folder)


def write_dual(df: DataFrame, folder: str) -> None:
    """Parquet and CSV beside it."""
    df.write.parquet(f"{folder}/parquet")
    df.write.option("header", True).csv(f"{folder}/csv")


def publish_if_passed(df: DataFrame, checks: DataFrame, folder: str) -> bool:
    """Write df only if no CRITICAL check row (severity, passed) failed. The committer makes the write atomic."""
    if not checks.filter("severity = 'CRITICAL' and not passed").isEmpty():
        return False
    df.write.mode("overwrite").parquet(folder)
    return True


def publish_parts(df: DataFrame, folder: str, key: str, parts: int, compression: str = "gzip") -> None:
    """Write df as CSV parts (rows of equal key modulo parts) and, beside them, the manifest: part, name, bytes, sha256 and canonical checksum of the files as written, and rows as counted in df."""
    numbered = df.withColumn("part", F.pmod(F.col(key), F.lit(parts)).cast("int"))
    numbered.repartition(parts, "part").sortWithinPartitions("part", *df.columns).write.partitionBy("part").option("header", True).option("compression", compression).csv(f"{folder}/data")
    counted = numbered.groupBy("part").agg(F.count("*").alias("rows"))
    counted.join(_files(df.sparkSession, folder), "part", "full_outer").write.parquet(f"{folder}/manifest")


def _name(path: Column) -> Column:
    """The part's folder and the file in it."""
    return F.concat_ws("/", F.slice(F.split(path, "/"), -2, 2))


def _digests(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """(path, length) to (path, length, sha256, canonical_sha256) of each file, read chunk_bytes at a time."""
    for b in batches:
        raws, canonicals = [], []
        for path in b.column(0).to_pylist():
            files, at = fs.FileSystem.from_uri(quote(path, safe="/:@"))
            raw, canonical, held = sha256(), sha256(), b""
            with files.open_input_stream(at, compression=None) as f:
                while chunk := f.read(chunk_bytes):
                    raw.update(chunk)
                    chunk = held + chunk
                    held = b"\r" if chunk.endswith(b"\r") else b""  # its LF may begin the next chunk
                    canonical.update(chunk[: len(chunk) - len(held)].replace(b"\r\n", b"\n"))
            canonical.update(held)
            raws.append(raw.hexdigest())
            canonicals.append(canonical.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raws, pa.string()), pa.array(canonicals, pa.string())], names=["path", "length", "sha256", "canonical_sha256"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(part, name, bytes, sha256, canonical_sha256) of the files there are; canonical: with LF for CRLF.

    A task reads a file of any size in chunks where Arrow knows the folder's file system (STREAMED). Elsewhere `binaryFile` reads it whole, and a file has at most 2 GB.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/data")
    if location(spark, folder).split(":")[0] in STREAMED:
        f = f.select("path", "length").mapInArrow(_digests, "path string, length long, sha256 string, canonical_sha256 string")
    else:
        canonical = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
        f = f.select("path", "length", F.sha2("content", 256).alias("sha256"), F.sha2(F.encode(canonical, "ISO-8859-1"), 256).alias("canonical_sha256"))
    return f.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), _name(F.col("path")).alias("name"), F.col("length").alias("bytes"), "sha256", "canonical_sha256")


def audit_parts(spark: SparkSession, folder: str, canonical_newlines: bool = False, required: tuple[str, ...] = ()) -> DataFrame:
    """One row for each file of the manifest or the folder: size_ok, sha_ok, expected_rows and found_rows, parts_ok (as many files as the manifest names), columns_ok. A lost or extra file fails."""
    manifest, there = spark.read.parquet(f"{folder}/manifest"), _files(spark, folder)
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).csv(f"{folder}/data")
    header = F.lit(all(c in rows.columns for c in required))
    found = rows.groupBy(_name(F.col("_metadata.file_path")).alias("name")).agg(F.count("*").alias("found_rows"))
    sha = "canonical_sha256" if canonical_newlines else "sha256"
    j = manifest.select("part", "name", F.col("bytes").alias("b"), F.col(sha).alias("s"), F.col("rows").alias("expected_rows")).join(there.select(F.col("part").alias("p"), "name", "bytes", F.col(sha).alias("found")), "name", "full_outer").join(found, "name", "left")
    numbers = manifest.agg(F.count("name").alias("n")).crossJoin(there.agg(F.count("name").alias("m"))).select((F.col("n") == F.col("m")).alias("parts_ok"))
    size = F.lit(True) if canonical_newlines else F.coalesce(F.col("b") == F.col("bytes"), F.lit(False))
    return j.select(
        F.coalesce("part", "p").alias("part"), "name", size.alias("size_ok"), F.coalesce(F.col("s") == F.col("found"), F.lit(False)).alias("sha_ok"), F.coalesce("expected_rows", F.lit(0)).alias("expected_rows"), F.coalesce("found_rows", F.lit(0)).alias("found_rows"), header.alias("columns_ok")
    ).crossJoin(F.broadcast(numbers))


REGISTER = "issue_id string, metric string, n long, run_id string"


def append_issues(metrics: DataFrame, folder: str, run_id: str) -> None:
    """Put a row DQ-<run>-NNN for each metric (metric, n) above zero into the register. A run has a partition of its own, which is replaced whole when the run is repeated, also after it broke off; other runs stay."""
    w = Window.orderBy("metric")  # one row a metric
    rows = metrics.filter("n > 0").withColumn("issue_id", F.format_string(f"DQ-{run_id}-%03d", F.row_number().over(w)))
    done = metrics.sparkSession.createDataFrame([(None, None, 0, run_id)], REGISTER)  # a run without issues leaves a row, too, which replaces those of an earlier try
    out = rows.select("issue_id", "metric", F.col("n").cast("long").alias("n"), F.lit(run_id).alias("run_id")).unionByName(done)
    out.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def read_issues(spark: SparkSession, folder: str) -> DataFrame:
    """(issue_id, metric, n, run_id) of all runs."""
    return spark.read.schema(REGISTER).parquet(folder).filter("issue_id is not null")


GEOJSON = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<double>>>>>"


def read_geojson(spark: SparkSession, folder: str, bad_ids: tuple[str, ...] = (), id_field: str = "id") -> DataFrame:
    """(id, geometry_type, seq, x, y) of the line features of GeoJSON pages; empty geometry and listed ids go."""
    pages = spark.read.schema(GEOJSON).option("multiLine", True).json(folder)
    f = pages.select(F.explode("features").alias("f")).select(F.col("f.properties")[id_field].alias("id"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("c"))
    f = f.filter(F.size("c") > 0).filter(~F.col("id").isin(*bad_ids)) if bad_ids else f.filter(F.size("c") > 0)
    return f.select("id", "geometry_type", F.posexplode("c").alias("seq", "p")).select("id", "geometry_type", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def profile_geojson(spark: SparkSession, folder: str, id_field: str = "id", required: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row: features, empty geometries, missing and distinct ids, ids repeated within a page and across pages, a histogram of geometry types, missing required properties."""
    pages = spark.read.schema(GEOJSON).option("multiLine", True).json(folder)
    f = pages.select(F.monotonically_increasing_id().alias("page"), "features").select("page", F.explode("features").alias("f"))
    f = f.select("page", F.col("f.properties")[id_field].alias("id"), F.size("f.geometry.coordinates").alias("n"), F.col("f.geometry.type").alias("type"), sum((F.col("f.properties")[r].isNull().cast("int") for r in required), F.lit(0)).alias("lacking"))
    f = cut_lineage(f, "features")  # page numbers stay as they are
    whole = f.agg(F.count("*").alias("features"), F.count_if(F.coalesce(F.col("n"), F.lit(0)) <= 0).alias("empty"), F.count_if(F.col("id").isNull()).alias("missing_ids"), F.countDistinct("id").alias("ids"), F.sum("lacking").alias("missing_properties"))
    in_page = f.filter("id is not null").groupBy("page", "id").agg(F.count("*").alias("k"))
    repeats = in_page.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated_in_page"), (F.count("*") - F.countDistinct("id")).alias("repeated_across_pages"))
    kinds = f.filter("type is not null").groupBy("type").agg(F.count("*").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", "k"))), ", ").alias("geometry_types"))
    return whole.crossJoin(F.broadcast(repeats)).crossJoin(F.broadcast(kinds))


def schema_rows(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(column_name, expected, found, passed) for a contract of names and types."""
    found = dict(df.dtypes)
    return df.sparkSession.createDataFrame([(c, expected.get(c), found.get(c), expected.get(c) == found.get(c)) for c in sorted({*expected, *found})], "column_name string, expected string, found string, passed boolean")
