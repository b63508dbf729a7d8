"""Facts offered one after the other by sources of different trust: what is accepted, refused and why; gates before a fact is offered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import names as N
from sievelake.operators.candidates import mapped
from sievelake.runtime import is_blank

#: How far a source is believed; any other is not at all.
TRUST = {"musicbrainz": 3, "coverartarchive": 3, "seed": 2, "deezer": 2, "itunes": 2}
#: Least fit of an album to take its cover or year, and of a hit to take its artwork.
ALBUM_FIT, ART_FIT = 0.6, 0.6


def attempts(offers: DataFrame, trust: dict[str, int] = TRUST) -> DataFrame:
    """(entity, field, seq, value, source, resolver, accepted, why) of every offer (entity, field, seq, value, source, resolver) that isn't blank.

    Offers are taken by seq. One is accepted if the field has no value, or if
    its source is believed more than the value's and says another value; else it
    agrees or is outranked. A field's offers are few: one of each resolver and round.
    """
    o = offers.where(~is_blank(F.col("value"))).withColumn("t", mapped(F.col("source"), trust, 0))
    row = F.struct("seq", "value", "source", "resolver", "t")
    state = "struct<value:string,source:string,t:int,log:array<struct<seq:bigint,value:string,source:string,resolver:string,accepted:boolean,why:string>>>"
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("source"), F.lit(-1).alias("t"), F.array().alias("log")).cast(state)

    def step(s, x):
        same = s["value"] == x["value"]
        why = F.when(s["value"].isNull(), "accepted").when(same, "agrees").when(x["t"] <= s["t"], F.concat(F.lit("outranked by "), s["source"])).otherwise("accepted")
        ok = why == "accepted"
        entry = F.struct(x["seq"].cast("bigint").alias("seq"), x["value"].alias("value"), x["source"].alias("source"), x["resolver"].alias("resolver"), ok.alias("accepted"), why.alias("why"))
        return F.struct(F.when(ok, x["value"]).otherwise(s["value"]).alias("value"), F.when(ok, x["source"]).otherwise(s["source"]).alias("source"), F.when(ok, x["t"]).otherwise(s["t"]).alias("t"), F.concat(s["log"], F.array(entry)).alias("log")).cast(state)

    by = o.groupBy("entity", "field").agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step)["log"].alias("log"))
    return by.select("entity", "field", F.inline("log"))


def recorded(tried: DataFrame, seeds: DataFrame) -> DataFrame:
    """Attempts as observations (entity, field, source, query_key, state, value), keyed by the resolver and the identity (seeds: entity, artist, title) it worked from; of a key the last counts."""
    key = F.concat(F.lit("cascade:"), F.coalesce("resolver", F.lit("?")), F.lit(":"), F.coalesce("artist", F.lit("None")), F.lit("|"), F.coalesce("title", F.lit("None")))
    d = tried.join(seeds, "entity", "left").withColumn("query_key", key)
    return d.groupBy("entity", "field", "source", "query_key").agg(F.max_by("value", "seq").alias("value")).withColumn("state", F.lit("FOUND"))


def held(tried: DataFrame) -> DataFrame:
    """(entity, field, value, source): the last accepted offer of each field."""
    return tried.where("accepted").groupBy("entity", "field").agg(F.max_by(F.struct("value", "source"), "seq").alias("x")).select("entity", "field", "x.*")


def gained(before: DataFrame, after: DataFrame) -> DataFrame:
    """(field, before, after, gained): how many entities have each field in two sets of facts."""
    n = lambda d, name: d.groupBy("field").agg(F.countDistinct("entity").alias(name))
    both = n(before, "before").join(n(after, "after"), "field", "full_outer").fillna(0, ["before", "after"])
    return both.withColumn("gained", F.col("after") - F.col("before"))


def cover_allowed(ours: Column, theirs: Column) -> Column:
    """Whether a cover may be taken: no album is known, or the cover's album fits it."""
    return is_blank(ours) | (N.fit(ours, theirs) >= ALBUM_FIT)


def art_fits(artist: Column, album: Column, title: Column, c_artist: Column, c_album: Column, c_title: Column) -> Column:
    """Whether a hit is plausibly the same record: its artist fits, and its album the album, or without one its album or title the title."""
    near = lambda want, got: ~is_blank(got) & (N.fit(want, got) >= ART_FIT)
    return (N.fit(artist, c_artist) >= ART_FIT) & F.when(is_blank(album), near(title, c_album) | near(title, c_title)).otherwise(near(album, c_album))


def first_of_sources(tables: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """(key, value, source): the value of the first source, in the order given, that has one; tables are (key, value, ok)."""
    all_ = None
    for i, (name, d) in enumerate(tables):
        one = d.where(F.col("ok") & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value)).withColumns({"source": F.lit(name), "_i": F.lit(i)})
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy(key).agg(F.min_by(F.struct(value, "source"), "_i").alias("x")).select(key, "x.*")


def stale(cached: DataFrame, rows: DataFrame, seed: list[str]) -> DataFrame:
    """The rows (key entity) without a cache entry, or whose entry was grown from another seed; an entry without a seed (stamped false) is left alone."""
    c = cached.select("entity", F.col("stamped"), F.struct(*seed).alias("_old"))
    d = rows.join(c, "entity", "left")
    return d.where(F.col("stamped").isNull() | (F.col("stamped") & ~F.col("_old").eqNullSafe(F.struct(*[rows[s] for s in seed])))).drop("stamped", "_old")
