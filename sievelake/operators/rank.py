"""Best of a group by composite order, without a window where an aggregate will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.operators import scan


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by a total order, with map-side combine."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark trims each partition to k a group before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def islands(df: DataFrame, by: list[str], value: str, tie: str, floor: float, share: float) -> DataFrame:
    """df with column island: a new one where the gap to the value before is over max(floor, share of the larger). Numbers from 0 in each group; a group may be as large as the table."""
    d = scan.ordered(df, by, [F.col(value), F.col(tie)])
    d = scan.previous(d, by, F.col(value), "_prev")
    gap = F.when(F.col(value) - F.col("_prev") > F.greatest(F.lit(floor), F.lit(share) * F.greatest("_prev", value)), 1).otherwise(0)
    return scan.plain(scan.running(d, by, gap.cast("long"), "island").drop("_prev"))


def band_pairs(df: DataFrame, key: str, value: str, width: float, by: list[str]) -> DataFrame:
    """Pairs (a, b) with a < b of rows equal in `by` whose values differ by at most width: one side stands in its bucket, the other in three."""
    one = df.select(*by, F.col(key).alias("a"), F.col(value).alias("va"), F.floor(F.col(value) / width).alias("_b"))
    many = df.select(*by, F.col(key).alias("b"), F.col(value).alias("vb"), F.explode(F.expr(f"array(floor({value} / {width}) - 1, floor({value} / {width}), floor({value} / {width}) + 1)")).alias("_b"))
    return one.join(many, [*by, "_b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= width)).select(*by, "a", "b")


def hamming_pairs(df: DataFrame, key: str, bits: str, radius: int, width: int = 64) -> DataFrame:
    """Pairs (a, b, distance) with a < b of bit words at most `radius` apart: they agree in one of radius + 1 blocks."""
    n = radius + 1
    at = [round(i * width / n) for i in range(n + 1)]
    blocks = F.expr("array(" + ", ".join(f"shiftrightunsigned({bits}, {a}) & {(1 << (b - a)) - 1}L" for a, b in zip(at, at[1:], strict=False)) + ")")
    e = df.select(F.col(key).alias("k"), F.col(bits).alias("w"), F.posexplode(blocks).alias("i", "v"))
    p = e.alias("x").join(e.alias("y"), ["i", "v"]).where("x.k < y.k").select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.bit_count(F.col("x.w").bitwiseXOR(F.col("y.w"))).cast("long").alias("distance"))
    return p.where(F.col("distance") <= radius).distinct()
