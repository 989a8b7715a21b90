"""The queries of this subpackage, over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.clusters import CLUSTERS_SQL, clustered
from corvane.llm.codes import CODES_SQL, code_report
from corvane.llm.decontamination import contamination, contamination_report
from corvane.llm.exact import exact_groups
from corvane.llm.language import identify
from corvane.llm.lines import line_report
from corvane.llm.packing import pack
from corvane.llm.secrets import SCAN_SQL, scan, scan_report
from corvane.llm.simhash import simhash_groups
from corvane.llm.storage import shared_folder, stored
from corvane.llm.substrings import removal_report
from corvane.llm.suffixes import string_report
from corvane.llm.token_files import read_digests, write_token_files
from corvane.llm.toxicity import toxicity_report


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), end_id=2)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_token_files(_documents(spark, sf_dir), path, end_id=1)
    return read_digests(spark, path)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_report(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir), keep="max")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_report(scan(_documents(spark, sf_dir)))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=4)
    return contamination_report(found)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), stored)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_token_files": op5_token_files,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_clusters": op12_clusters,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op8_secrets": SCAN_SQL,
    "op11_vector_codes": CODES_SQL,
    "op12_clusters": CLUSTERS_SQL,
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
