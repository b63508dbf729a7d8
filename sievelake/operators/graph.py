"""Graphs as edge tables: connected components and alias resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.runtime import cut


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of an undirected edge table; component is the smallest id reachable.

    Alternates the large-star and small-star steps: O(log n) rounds, each two
    aggregations with map-side combine. Joins of edges with their vertex's least
    neighbour go by vertex: a hub's edges meet in one partition, which Spark splits
    where it is skewed, as only the hub's one row stands on the other side. Null ends and self loops add no edge. No
    edges: no rows. Raises if max_rounds don't suffice.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    before = _digest(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = cut(small)
        after = _digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    tops = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(tops).groupBy("id").agg(F.min("component").alias("component"))


def resolve_aliases(mapping: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(name, canonical): each name's last alias, by pointer doubling. A name that maps to itself is its own; names on a cycle stay where doubling leaves them, the smallest seen."""
    m = mapping.select("name", "alias").where("name IS NOT NULL AND alias IS NOT NULL AND name <> alias").dropDuplicates(["name"])
    m = cut(m)
    for _ in range(max_rounds):
        nxt = m.alias("a").join(m.alias("b"), F.col("a.alias") == F.col("b.name"), "left")
        step = cut(nxt.select(F.col("a.name").alias("name"), F.when(F.col("b.alias") == F.col("a.name"), F.least("a.name", "a.alias")).otherwise(F.coalesce("b.alias", "a.alias")).alias("alias")))
        changed = step.join(m, ["name", "alias"], "left_anti").limit(1).count()
        m = step
        if not changed:
            break
    else:
        raise RuntimeError(f"aliases are not settled after {max_rounds} rounds")
    return m.select("name", F.col("alias").alias("canonical"))


def fixpoint(facts: DataFrame, resolvers: list[tuple[str, str, DataFrame]], max_rounds: int = 5) -> DataFrame:
    """facts (entity, field, value, round) grown by resolvers (needs, gives, lookup of value to result) until a round adds nothing. A fact once known stays. Raises if max_rounds don't suffice."""
    known = cut(facts.withColumn("round", F.lit(0)))
    for n in range(1, max_rounds + 1):
        new = None
        for needs, gives, look in resolvers:
            got = known.where(F.col("field") == needs).join(look.select(F.col("key").alias("value"), "result"), "value").select("entity", F.lit(gives).alias("field"), F.col("result").alias("value"), F.lit(n).alias("round"))
            new = got if new is None else new.unionByName(got)
        new = cut(new.join(known, ["entity", "field"], "left_anti").groupBy("entity", "field", "round").agg(F.min("value").alias("value")).select("entity", "field", "value", "round"))
        if not new.limit(1).count():
            break
        known = known.unionByName(new)
    else:
        raise RuntimeError(f"facts are not settled after {max_rounds} rounds")
    return known
