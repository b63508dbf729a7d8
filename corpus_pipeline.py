"""Corpus pipeline: documents to token ids in five stages, each written and read again by whoever runs it.

Every stage takes null ids, null, empty and very long texts, repeated rows and
further columns of any name; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import bpe, leaks, near_dup, pii, quality
from sievelake.runtime import broadcast_if_small, cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws stay; those that look unlike the good ones go. Rows without n-grams (null, empty, blank texts) and rows with a null id stay; rows that share an id go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id. Rows repeated with one id share their fate. Null, empty and blank texts are nobody's copy and stay, as do rows with a null id."""
    found = near_dup.near_duplicates(docs, k=5, percent=80)
    out = cut(found.where("NOT kept").select("doc_id").distinct())
    return docs.join(broadcast_if_small(out), "doc_id", "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; rows with a null id stay; rows that share an id go together."""
    return leaks.remove(docs, table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced; every document stays, repeated ones each; null and empty texts stay as they are."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, repeated ones each; null and empty texts have none."""
    return bpe.encode(docs, *bpe.default_vocabulary())


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("pii", sanitised), ("tokens", tokens)]
#: Hashed models and similarity joins have no SQL form; tests/llm holds their operators against brute force, and each stage against awkward tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
