"""Scans in order over groups of any size: a group as large as the table is spread over all tasks.

Rows are range-partitioned by group and order, so a group lies in a run of
neighbouring partitions. Each partition hands on one row a group that it holds
(its sum, or its last value); only these go through a window by group, at most
one row for each partition, and each partition's rows then start from what they were handed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.runtime import broadcast_if_small, cut


def ordered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df in order within groups, kept, with _id (ascending in that order) and _p (its range partition). by may be empty: the whole table is one group."""
    keys = [*[F.col(c) for c in by], *order]
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(d.withColumn("_id", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_id", 33))


def _handed(d: DataFrame, by: list[str], parts: DataFrame) -> DataFrame:
    """d with the column _handed of parts (by, _p, _handed). Null groups are groups."""
    parts = parts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), "_handed")
    on = [*[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col("_p") == F.col("_q")]
    return d.join(broadcast_if_small(cut(parts)), on, "left").drop("_q", *[f"_g{i}" for i in range(len(by))])


def _inside(by: list[str]):
    return Window.partitionBy(*by, "_p").orderBy("_id")


def _across(by: list[str]):
    return Window.partitionBy(*by).orderBy("_p")


def running(d: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """An ordered table with the running sum of value in its group, the row's own included; null values add nothing."""
    d = d.withColumn(name, F.coalesce(value, F.lit(0)))
    parts = d.groupBy(*by, "_p").agg(F.sum(name).alias("_s"))
    before = F.coalesce(F.sum("_s").over(_across(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = _handed(d, by, parts.select(*by, "_p", before.alias("_handed")))
    inside = F.sum(name).over(_inside(by).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, inside + F.col("_handed")).drop("_handed")


def previous(d: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """An ordered table with the value of the row before in its group; null for a group's first row."""
    d = d.withColumn(name, F.struct(value.alias("v")))
    parts = d.groupBy(*by, "_p").agg(F.max_by(name, "_id").alias("_l"))
    d = _handed(d, by, parts.select(*by, "_p", F.lag("_l").over(_across(by)).alias("_handed")))
    return d.withColumn(name, F.coalesce(F.lag(name).over(_inside(by)), F.col("_handed"))["v"]).drop("_handed")


def plain(d: DataFrame) -> DataFrame:
    """Without the columns that ordered added."""
    return d.drop("_id", "_p")
