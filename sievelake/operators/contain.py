"""Names within names, and names that are nearly the same, without comparing all pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import sequence_ratio
from sievelake.runtime import broadcast_if_small, cut

#: Letters of a gram by which a pattern is looked for; shorter patterns are grams themselves.
GRAM = 3


def _grams(c: str, n: str) -> str:
    return f"array_distinct(transform(sequence(1, length({c}) - {n} + 1), i -> substring({c}, i, {n})))"


def containing_pairs(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pid, p, tid, t): every pattern (pid, p) with every text (tid, t) that holds it, at any place.

    A pattern is looked for by that one of its grams that the fewest texts hold, so
    candidates grow with what a pattern's rarest letters match. Null and empty patterns are in
    nothing; rows that share an id are rows of their own, if their texts differ; equal rows are one.
    """
    p = cut(patterns.where("length(p) > 0").select("pid", "p").distinct().withColumn("n", F.least(F.length("p"), F.lit(GRAM))))
    t = texts.where("length(t) > 0").select("tid", "t").distinct()
    held = None
    for n in sorted(r["n"] for r in p.select("n").distinct().collect()):
        one = t.where(F.length("t") >= n).select("tid", "t", F.explode(F.expr(_grams("t", str(n)))).alias("g"), F.lit(n).alias("n"))
        held = one if held is None else held.unionByName(one)
    if held is None:
        return p.select("pid", "p").join(t, F.lit(False))
    wanted = p.select("pid", "p", "n", F.explode(F.expr(_grams("p", "n"))).alias("g"))
    often = cut(held.join(wanted.select("n", "g").distinct(), ["n", "g"], "left_semi").groupBy("n", "g").agg(F.count(F.lit(1)).alias("often")))
    rarest = wanted.join(often, ["n", "g"], "left").groupBy("pid", "p", "n").agg(F.min_by(F.struct("g", "often"), F.struct(F.coalesce("often", F.lit(0)), "g")).alias("x")).where("x.often IS NOT NULL")
    return held.join(rarest.select("pid", "p", "n", F.col("x.g").alias("g")), ["n", "g"]).where(F.contains("t", F.col("p"))).select("pid", "p", "tid", "t")


def longest_within(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(tid, t, answer): the longest of names (p) that each text holds, of equal lengths the last in order; texts that hold none are left out."""
    got = containing_pairs(names.select(F.col("p").alias("pid"), "p"), texts)
    return got.groupBy("tid", "t").agg(F.max_by("p", F.struct(F.length("p"), "p")).alias("answer"))


def closest_names(orphans: DataFrame, present: DataFrame) -> DataFrame:
    """(oid, pid): for each orphan (oid, key) the present name (pid, key) that holds it or that it holds, the longest, of equal lengths the smallest pid."""
    # Names are compared once each, whoever bears them: of present ones the smallest pid counts, and orphans of one name have one answer.
    names = cut(present.where("length(key) > 0").groupBy("key").agg(F.min("pid").alias("pid")))
    asked = cut(orphans.where("length(key) > 0").select("key").distinct())
    within = containing_pairs(names.select("pid", F.col("key").alias("p")), asked.select(F.col("key").alias("tid"), F.col("key").alias("t"))).select(F.col("t").alias("key"), "pid", F.length("p").alias("n"))
    around = containing_pairs(asked.select(F.col("key").alias("pid"), F.col("key").alias("p")), names.select(F.col("pid").alias("tid"), F.col("key").alias("t"))).select(F.col("p").alias("key"), F.col("tid").alias("pid"), F.length("t").alias("n"))
    best = within.unionByName(around).groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "pid")).alias("x"))
    return orphans.select("oid", "key").join(best, "key").groupBy("oid").agg(F.min("x").alias("x")).select("oid", "x.pid")


@dataclass
class Similar:
    """pairs (a, b, ratio) of texts a < b; compared: how many pairs reached the ratio, of `all` pairs."""

    pairs: DataFrame
    compared: int
    all: int


def _segment(edits: str, short: str) -> str:
    """SQL: struct(i, at, n) of the edits + 1 even segments of a text of `short` letters."""
    return f"transform(sequence(0, {edits}), i -> struct(i AS i, cast(floor(i * {short} / ({edits} + 1)) as int) AS at, cast(floor((i + 1) * {short} / ({edits} + 1)) as int) - cast(floor(i * {short} / ({edits} + 1)) as int) AS n))"


def similar_texts(texts: DataFrame, least: float, column: str = "t") -> Similar:
    """All pairs of different texts whose matching-blocks ratio, in either order, is `least` (over 2/3) at least.

    With ratio 2 M / (la + lb), at most e = floor((1 - least)(la + lb)) letters of both texts are in no
    block. Of e + 1 segments of the shorter text one at least then stands whole in the longer, at most
    e places off, so texts meet on (lengths, segment). Pairs whose counts of letters
    can't reach the ratio go before it is worked out. Null and empty texts are in no pair; equal ones are one.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be over 2/3, as shorter texts have too few letters to share a segment, and at most 1")
    t = cut(texts.select(F.col(column).alias("t")).where("length(t) > 0").distinct().withColumn("l", F.length("t")))
    far = (2.0 - least) / least
    e = f"cast(floor({1 - least!r} * (s + g) + 1e-9) as int)"
    lengths = t.select("l").distinct()
    # Lengths of the shorter and the longer text that can be similar: as many rows as there are such pairs of lengths.
    both = lengths.select(F.col("l").alias("s")).join(broadcast_if_small(lengths.select(F.col("l").alias("g"))), F.expr(f"g >= s AND g <= s * {far!r} + 1e-9")).withColumn("e", F.expr(e))
    both = cut(both.withColumn("parts", F.expr(_segment("e", "s"))))
    short = t.join(broadcast_if_small(both), F.col("l") == F.col("s")).select(F.col("t").alias("a"), "s", "g", F.inline("parts")).select("a", "s", "g", "i", F.expr("substring(a, at + 1, n)").alias("part"))
    long = t.join(broadcast_if_small(both), F.col("l") == F.col("g")).select(F.col("t").alias("b"), "s", "g", "e", F.inline("parts"))
    place = F.explode(F.expr("sequence(greatest(0, at - e), least(g - n, at + e))")).alias("o")
    long = long.where("greatest(0, at - e) <= least(g - n, at + e)").select("b", "s", "g", "i", "n", place).select("b", "s", "g", "i", F.expr("substring(b, o + 1, n)").alias("part")).distinct()
    met = short.join(long, ["s", "g", "i", "part"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    common = "aggregate(array_distinct(split(a, '')), 0L, (m, c) -> m + least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))) div greatest(1, length(c)))"
    bound = F.expr(f"2.0D * ({common}) / (length(a) + length(b))")
    met = cut(met.where(bound >= least - 1e-9))
    n = t.count()
    found = met.withColumn("ratio", F.greatest(sequence_ratio(F.col("a"), F.col("b")), sequence_ratio(F.col("b"), F.col("a")))).where(F.col("ratio") >= least)
    return Similar(found, met.count(), n * (n - 1) // 2)
