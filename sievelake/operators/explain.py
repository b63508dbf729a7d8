"""Evidence put into words: what won and what it beat, who was silent, what a file says of itself, and where these differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import skeleton
from sievelake.runtime import is_blank

FOUND = "FOUND"
LOCAL = ("tags", "band", "filename", "folder")


def _families(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " family").otherwise(" families"))


def beat(votes: DataFrame) -> DataFrame:
    """(entity, field, beat): what the winner beat, and how; empty where nothing came second.

    votes (entity, field, value, human, families, rank): the families of each value, ranked;
    the family `local` doesn't count against it, and comes second to nothing.
    """
    free = F.array_remove("families", "local")
    v = votes.select("entity", "field", F.struct("rank", "value", "human", free.alias("free")).alias("v"))
    by = v.groupBy("entity", "field").agg(F.min_by("v", "v.rank").alias("w"), F.min_by("v", F.when((F.col("v.rank") > 1) & (F.size("v.free") > 0), F.col("v.rank"))).alias("s"), F.min(F.when((F.col("v.rank") > 1) & (F.size("v.free") > 0), F.col("v.rank"))).alias("r"))
    n, m = F.size("w.free"), F.size("s.free")
    settled = F.concat(F.lit('you settled it, over "'), F.col("s.value"), F.lit('" from '), F.array_join("s.free", ", "))
    counted = F.concat(_families(n), F.when(n > m, " beat ").otherwise(" tied with, and sorted above "), m.cast("string"), F.lit(' for "'), F.col("s.value"), F.lit('"'))
    return by.select("entity", "field", F.when(F.col("r").isNull(), "").when(F.col("w.human"), settled).otherwise(counted).alias("beat"))


def why_review(checked: DataFrame, beats: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(entity, why): of each field in order who agrees, who disagrees, who gave no answer, and what was beaten. checked: (entity, field, agree, dissent, silent) as comma-joined text."""
    said = lambda c, words: F.when(F.col(c) != "", words(F.replace(F.col(c), F.lit(","), F.lit(", "))))
    parts = F.array_join(F.array_compact(F.array(said("agree", lambda x: F.concat(x, F.lit(" agree"))), said("dissent", lambda x: F.concat(x, F.lit(" disagree"))), said("silent", lambda x: F.concat(F.lit("no answer from "), x)), F.when(F.col("beat") != "", F.col("beat")))), "; ")
    d = checked.join(beats, ["entity", "field"], "left").where(F.col("field").isin(*fields)).withColumn("p", parts).where("p <> ''")
    return d.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, fields)), F.col("field")).alias("i"), F.concat("field", F.lit(": "), "p").alias("p")))), lambda x: x["p"]), " | ").alias("why"))


def local_claims(obs: DataFrame) -> DataFrame:
    """(entity, claims): what tags, band, file name and folder say, each apart. obs: (entity, field, source, state, value); of a source's values the largest."""
    d = obs.where((F.col("state") == FOUND) & ~is_blank(F.col("value")) & F.col("source").isin(*LOCAL) & F.col("field").isin("artist", "title", "collection"))
    v = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    by = d.groupBy("entity", "source").agg(v("artist").alias("a"), v("title").alias("t"), v("collection").alias("c"))
    text = F.concat("source", F.lit(": "), F.when(F.col("c").isNotNull(), F.col("c")).otherwise(F.concat(F.coalesce("a", F.lit("(no artist)")), F.lit(" - "), F.coalesce("t", F.lit("(no title)")))))
    return by.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, LOCAL)), F.col("source")).alias("i"), text.alias("x")))), lambda x: x["x"]), " | ").alias("claims"))


def local_disagreement(obs: DataFrame) -> DataFrame:
    """(entity, field) where the file's name and its tags or band differ in ASCII letters and digits."""
    d = obs.where((F.col("state") == FOUND) & ~is_blank(F.col("value")))
    by = d.groupBy("entity", "field").agg(F.max(F.when(F.col("source") == "filename", F.col("value"))).alias("named"), F.collect_set(F.when(F.col("source").isin("tags", "band"), skeleton(F.col("value")))).alias("inside"))
    return by.where(F.col("named").isNotNull() & (F.size("inside") > 0) & ~F.array_contains("inside", skeleton(F.col("named")))).select("entity", "field")


def verdict(obs: DataFrame) -> DataFrame:
    """(entity, field, verdict) of obs (entity, field, family, state, value): who is for the value of most families; ties are called ties; of equally many the smallest value is named first."""
    ok = F.col("state") == FOUND
    states = obs.groupBy("entity", "field").agg(F.array_join(F.sort_array(F.collect_set("state")), ", ").alias("states"))
    v = obs.where(ok).groupBy("entity", "field", "value").agg(F.sort_array(F.collect_set("family")).alias("f"))
    by = v.groupBy("entity", "field").agg(F.array_sort(F.collect_list(F.struct((-F.size("f")).alias("n"), "value", "f"))).alias("r"), F.bool_or(F.array_contains("f", "human")).alias("human"))
    top, second = F.col("r")[0], F.get("r", F.lit(1))
    line = F.concat(_families(-top["n"]), F.lit(" on '"), top["value"], F.lit("': "), F.array_join(top["f"], ", "))
    line = F.when(second["n"] == top["n"], F.concat(F.lit("TIE, "), line, F.lit("  vs '"), second["value"], F.lit("'"))).when(F.size("r") > 1, F.concat(line, F.lit("  ("), (F.size("r") - 1).cast("string"), F.lit(" other value(s) disagree)"))).otherwise(line)
    said = by.select("entity", "field", F.concat(line, F.when(F.col("human"), "  [you answered this]").otherwise("")).alias("line"))
    return states.join(said, ["entity", "field"], "left").select("entity", "field", F.coalesce("line", F.concat(F.lit("nothing answered ("), "states", F.lit(")"))).alias("verdict"))


def resolve(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, path): each wanted text's track by exact path, else by file name, else those whose file name holds it, whatever the case.

    wanted is what somebody typed: a few texts; it is counted and refused beyond a thousand, as the last step compares each with every path.
    """
    if wanted.limit(1001).count() > 1000:
        raise ValueError("at most 1000 texts can be looked up at once")
    base = F.substring_index("path", "/", -1)
    p = paths.select("path").distinct().withColumn("base", base)
    w = F.broadcast(wanted.select("wanted").distinct())
    how = F.when(F.col("path") == F.col("wanted"), 0).when(F.col("base") == F.col("wanted"), 1).otherwise(2)
    hit = p.join(w, (F.col("path") == F.col("wanted")) | (F.col("base") == F.col("wanted")) | F.contains(F.lower("base"), F.lower("wanted"))).select("wanted", "path", how.alias("how"))
    least = hit.groupBy("wanted").agg(F.min("how").alias("how"))
    return hit.join(F.broadcast(least), ["wanted", "how"]).select("wanted", "path")
