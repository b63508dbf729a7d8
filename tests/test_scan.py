"""Scans in order against windows, with one group as large as the table, nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.operators import rank, scan


@pytest.fixture(autouse=True)
def spread(spark):
    """Small tables keep their partitions, so that values are handed on between them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(kind, n=1500):
    rng = random.Random(kind)
    group = {"one": lambda: "g", "hot": lambda: rng.choice(["hot"] * 8 + ["a", "b", None]), "many": lambda: f"g{rng.randrange(900)}", "empty": None}[kind]
    return [] if group is None else [(group(), rng.choice([rng.randrange(400), rng.randrange(40_000)]), k, None if rng.random() < 0.1 else rng.randrange(9)) for k in range(n)]


@pytest.mark.parametrize("kind", ["one", "hot", "many", "empty"])
@pytest.mark.parametrize("by", [["g"], []])
def test_running_and_previous(spark, kind, by):
    df = spark.createDataFrame(rows(kind), "g string, v long, k long, x long")
    w = Window.partitionBy(*by).orderBy("v", "k")
    want = df.select("*", F.sum(F.coalesce("x", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.lag("x").over(w).alias("prev"))
    d = scan.ordered(df, by, [F.col("v"), F.col("k")])
    got = scan.plain(scan.previous(scan.running(d, by, F.col("x"), "run"), by, F.col("x"), "prev"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("kind", ["one", "hot", "many", "empty"])
def test_islands_equal_the_window(spark, kind):
    df = spark.createDataFrame(rows(kind), "g string, v long, k long, x long")
    w = Window.partitionBy("g").orderBy("v", "k")
    prev = F.lag("v").over(w)
    gap = F.when(F.col("v") - prev > F.greatest(F.lit(3.0), F.lit(0.01) * F.greatest(prev, "v")), 1).otherwise(0)
    want = df.withColumn("gap", gap).withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
    got = rank.islands(df, ["g"], "v", "k", 3.0, 0.01)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_one_group_goes_to_all_tasks(spark):
    """A group as large as the table: no task gets more than about its share."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), F.xxhash64("id").alias("v"))
    d = scan.ordered(df, ["g"], [F.col("v")])
    share = [r["count"] for r in d.groupBy("_p").count().collect()]
    assert len(share) >= 2 and max(share) < 2.5 * 40_000 / len(share)
    plan = scan.running(d, ["g"], F.lit(1), "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "_p" in plan.split("Window")[1]
