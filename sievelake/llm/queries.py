"""Queries of this subpackage: opN_<name> applies operator N, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import bpe, fingerprints, langid, leaks, lexical, licences, mixing, near_dup, pages, pii, quality, repeats, whitening
from sievelake.runtime import cut, table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and beside them the text that is left (a character that a cut went through shows as U+FFFD; kept_sha256 is of the bytes)."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=True)
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), *bpe.default_vocabulary(), ids=False, warm=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(cut(lexical.index(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_pii, op3_benchmark_leaks, op4_near_duplicates, op5_main_text, op6_byte_bpe, op7_language_id, op8_fingerprints, op9_quality, op10_licences, op11_whitening, op12_search, op13_mixing)}
ORACLE_SQL: dict[str, str] = {"op12_search": lexical.sql(), "op13_mixing": mixing.sql()}
