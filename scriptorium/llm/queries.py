"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, langid, linededup, packing, quality, sharding, simhash, warc
from .common import expire, fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_histogram_sort(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.histogram_sort(spark.read.parquet(f"{sf}/documents.parquet"), ["source", "doc_id"])


def op2_harmonic_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.harmonic_packing(spark.read.parquet(f"{sf}/documents.parquet"))


def op3_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.near_groups(spark.read.parquet(f"{sf}/documents.parquet"))
    return groups.select(F.col("doc").alias("doc_id"), "group_id", "n_rows", "kept")


def op4_warc_normalise(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write_monolithic(spark.read.parquet(f"{sf}/pages.parquet"), f"{folder}/in")
    index, files = warc.normalise(spark, f"{folder}/in", f"{folder}/out")
    expire(spark, folder)
    if not files.where("NOT whole").isEmpty():
        raise ValueError("a WARC file was cut")
    return index.withColumn("page_id", F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).cast("long"))


def op5_prefix_target(spark: SparkSession, sf: str) -> DataFrame:
    return chat.prefix_target(spark.read.parquet(f"{sf}/conversations.parquet"))


def op6_distribution_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return quality.divergence(spark.read.parquet(f"{sf}/documents.parquet"))


def op7_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(spark.read.parquet(f"{sf}/documents.parquet"))


def op8_code_switch_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf}/documents.parquet"))


def op9_patience_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.align(spark.read.parquet(f"{sf}/documents.parquet"))


def op10_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_groups(spark.read.parquet(f"{sf}/embeddings.parquet"))


_ALL = (op1_histogram_sort, op2_harmonic_packing, op3_simhash_near_dedup, op4_warc_normalise, op5_prefix_target, op6_distribution_divergence, op7_bpe_round_trip, op8_code_switch_language, op9_patience_line_dedup, op10_embedding_near_dedup)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op2_harmonic_packing": packing.SQL, "op5_prefix_target": chat.SQL, "op6_distribution_divergence": quality.SQL, "op10_embedding_near_dedup": embeddings.SQL}
