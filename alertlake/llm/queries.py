"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm.bpe import round_trip
from alertlake.llm.exact_dedup import exact_dedup
from alertlake.llm.hard_negatives import hard_negatives, hard_negatives_sql, shifted
from alertlake.llm.language_id import identify
from alertlake.llm.line_dedup import dedup_lines, dedup_lines_sql
from alertlake.llm.near_vectors import near_vectors
from alertlake.llm.packing import pack
from alertlake.llm.periodic_runs import digest, periodic_runs, planted
from alertlake.llm.pii import key_of, pseudonymise
from alertlake.llm.sharding import shard_rows
from alertlake.llm.simhash import near_duplicates
from alertlake.llm.substring_dedup import dedup_substrings, dedup_substrings_sql
from alertlake.llm.url_filter import judge, judge_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), key_of(spark)).select("doc_id", "text", "n_entities")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted()), F.col("vec_id") % 100 == 0)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_near_vectors": op4_near_vectors,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": dedup_lines_sql(),
    "op9_url_filter": judge_sql(),
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_hard_negatives": hard_negatives_sql(),
    "op12_substring_dedup": dedup_substrings_sql(),
}
