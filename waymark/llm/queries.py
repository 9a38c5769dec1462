"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.llm import bpe, decontaminate, htmltext, licenses, lm, merkle, pii, sharding, simhash, syncmers, toxicity, treap, warc

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


#: The setting that holds a deployment's own secret for surrogates, and the key where it is unset.
SURROGATE_SETTING, SURROGATE_KEY = "spark.waymark.surrogateKey", "waymark surrogates"


def surrogate_key(spark: SparkSession) -> bytes:
    return spark.conf.get(SURROGATE_SETTING, SURROGATE_KEY).encode()


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_replaced and the text with surrogates of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, surrogate_key(spark), count_col="n_replaced").select("doc_id", "n_replaced", "text")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(_read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_tampered(_read(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.top_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc": op1_warc, "op2_pii": op2_pii, "op3_sharding": op3_sharding, "op4_toxicity": op4_toxicity, "op5_licenses": op5_licenses, "op6_lm": op6_lm, "op7_decontaminate": op7_decontaminate, "op8_simhash": op8_simhash, "op9_syncmers": op9_syncmers, "op10_bpe": op10_bpe, "op11_html": op11_html, "op12_merkle": op12_merkle, "op13_search": op13_search}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE_SQL, "op5_licenses": licenses.oracle_sql(), "op11_html": htmltext.ORACLE_SQL, "op12_merkle": merkle.ORACLE_SQL, "op13_search": treap.ORACLE_SQL}
