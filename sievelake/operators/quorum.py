"""Agreement and dissent, counted over independent families of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.runtime import broadcast_if_small, is_blank


def families(obs: DataFrame, dim: DataFrame) -> DataFrame:
    """obs with column family; a source that the dimension doesn't know is its own family."""
    return obs.join(broadcast_if_small(dim), "source", "left").withColumn("family", F.coalesce("family", "source"))


def agreement(obs: DataFrame) -> DataFrame:
    """Per (entity, field) the value with a human family, then most families, then largest text; who agrees, who dissents, the runner-up, the margin.

    obs: entity, field, value, family. Blank values say nothing. Families count
    once a value. Dissent leaves out the family `local`; the runner-up is the
    next value that a family other than `local` gave, the margin counts such families.
    """
    by = obs.where(~is_blank(F.col("value"))).groupBy("entity", "field", "value").agg(F.sort_array(F.collect_set("family")).alias("families"))
    ranked = by.withColumn("r", F.struct(F.array_contains("families", "human").alias("human"), F.size("families").alias("n"), "value", "families"))
    one = ranked.groupBy("entity", "field").agg(F.sort_array(F.collect_list("r"), asc=False).alias("v"))
    win = F.col("v")[0]
    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    other = F.array_distinct(F.flatten(F.transform(rest, lambda x: x["families"])))
    free = lambda x: F.size(F.array_remove(x["families"], "local"))
    second = F.get(F.filter(rest, lambda x: free(x) > 0), F.lit(0))
    return one.select(
        "entity",
        "field",
        win["value"].alias("value"),
        win["n"].cast("long").alias("n_families"),
        F.array_join(win["families"], ",").alias("agree"),
        F.array_join(F.sort_array(F.array_remove(F.array_except(other, win["families"]), "local")), ",").alias("dissent"),
        second["value"].alias("runner_up"),
        (free(win) - F.coalesce(free(second), F.lit(0))).cast("long").alias("margin"),
        win["human"].alias("human"),
    )


def penalty(agreed: DataFrame, proposal: DataFrame, fields: list[str], factor: float = 0.8) -> DataFrame:
    """proposal (entity, field, value, confidence) with confidence times factor where the value proposed wins against dissent and no human spoke."""
    contested = (F.col("a.dissent") != "") & ~F.col("a.human") & F.col("p.field").isin(fields) & F.col("p.value").eqNullSafe(F.col("a.value"))
    joined = proposal.alias("p").join(agreed.alias("a"), ["entity", "field"], "left")
    return joined.select("entity", "field", F.col("p.value").alias("value"), F.coalesce(contested, F.lit(False)).alias("contested"), F.round(F.col("confidence") * F.when(contested, factor).otherwise(1.0), 6).alias("confidence"))


def silent(obs: DataFrame) -> DataFrame:
    """Per entity and field: the sources asked, those that found something, and those that never did."""
    by = obs.groupBy("entity", "field").agg(F.collect_set("source").alias("asked"), F.collect_set(F.when((F.col("state") == "FOUND") & ~is_blank(F.col("value")), F.col("source"))).alias("found"))
    text = lambda x: F.array_join(F.sort_array(x), ",")
    return by.select("entity", "field", text("asked").alias("asked"), text("found").alias("found"), text(F.array_except("asked", "found")).alias("silent"))
