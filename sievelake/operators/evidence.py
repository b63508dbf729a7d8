"""The evidence store: keyed upsert, outcome states, expiry, scoped replacement, relocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.runtime import broadcast_if_small, is_blank

KEY = ["entity", "field", "source", "query_key"]
#: Outcome states, and after how many seconds an answer of a state is asked again (none: never).
STATES = ("FOUND", "NO_MATCH", "AMBIGUOUS", "RATE_LIMITED", "TEMPORARY_FAILURE", "AUTH_FAILURE", "SOURCE_CHANGED", "NOT_APPLICABLE")
TTL_SECONDS = {"FOUND": None, "NOT_APPLICABLE": None, "NO_MATCH": 2592000, "AMBIGUOUS": 604800, "SOURCE_CHANGED": 21600, "TEMPORARY_FAILURE": 21600, "AUTH_FAILURE": 3600, "RATE_LIMITED": 3600}


def valid(batch: DataFrame) -> DataFrame:
    """batch without rows of an unknown state, or FOUND without a value."""
    return batch.where(F.col("state").isin(*STATES) & ((F.col("state") != "FOUND") | ~is_blank(F.col("value"))))


def checked(batch: DataFrame) -> DataFrame:
    """batch; a row of an unknown state, or FOUND without a value, raises when it is read."""
    state = F.col("state")
    bad = F.when(~F.coalesce(state.isin(*STATES), F.lit(False)), F.concat(F.lit("unknown state: "), F.coalesce(state, F.lit("null")))).when((state == "FOUND") & is_blank(F.col("value")), "FOUND needs a value")
    return batch.withColumn("state", F.when(bad.isNull(), state).otherwise(F.raise_error(bad)))


def latest(batch: DataFrame, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in batch.columns if c not in KEY]
    return batch.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*KEY, "r.*")


def upsert(store: DataFrame, batch: DataFrame) -> DataFrame:
    """store with batch merged in by key; first_seen is kept while the value stays the same, null-safely. Unknown states and FOUND without a value raise."""
    s, b = store.alias("s"), checked(batch).alias("b")
    both = s.join(b, KEY, "full_outer")
    new = F.col("b.seen_at").isNotNull()
    pick = lambda c: F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    same = F.col("s.seen_at").isNotNull() & F.col("s.value").eqNullSafe(F.col("b.value"))
    first = F.when(new & ~same, F.col("b.seen_at")).otherwise(F.col("s.first_seen")).alias("first_seen")
    return both.select(*KEY, pick("state"), pick("value"), first, pick("seen_at"))


def fresh(now: Column) -> Column:
    """Whether a row's answer may still be used at `now`: strictly younger than its state's time to live."""
    ttl = F.lit(None).cast("long")
    for state, seconds in TTL_SECONDS.items():
        if seconds is not None:
            ttl = F.when(F.col("state") == state, F.lit(seconds).cast("long")).otherwise(ttl)
    return ttl.isNull() | (F.unix_timestamp(now) - F.unix_timestamp("seen_at") < ttl)


def observations(store: DataFrame, **equal) -> DataFrame:
    """The rows of store (with column family) that equal what is given, by field, family, source and first_seen."""
    for name, value in equal.items():
        if value is not None:
            store = store.where(F.col(name) == value)
    return store.orderBy("field", "family", "source", "first_seen")


def asked(store: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    """The rows of store that answer exactly one of questions (the key columns) and are still fresh."""
    return store.join(questions.select(*KEY).distinct(), KEY, "left_semi").where(fresh(now))


def found(entity: Column, field: str, source: Column, query_key: Column, value: Column) -> Column:
    """A FOUND row as a struct, null where there is no value."""
    v = value.cast("string")
    return F.when(v.isNotNull() & (v != ""), F.struct(entity.alias("entity"), F.lit(field).alias("field"), source.alias("source"), query_key.alias("query_key"), F.lit("FOUND").alias("state"), v.alias("value")))


def _rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array_compact(F.array(*structs))))


def _of(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.coalesce(a, F.lit("None")), F.coalesce(b, F.lit("None")))


def backfill(facts: DataFrame, hits: DataFrame, failures: DataFrame, lyrics: DataFrame, reviews: DataFrame, sources_of) -> DataFrame:
    """Observations (key columns, state, value) of four caches, with reconstructed questions.

    facts (entity, field, value, source, artist, title): a fact without a source is
    the seed's. hits (entity, source, artist, title, album, year, q_artist, q_title) and
    failures (entity, source, q_artist, q_title): web answers and outages. lyrics (key,
    synced, plain, status, source) fan out to the reviews with that lower-case artist|title.
    reviews (entity, file, artist, title, album, year, source): each source that
    sources_of() reads from the label gave every field that isn't blank.
    """
    c = F.col
    one = facts.where(~is_blank(c("value"))).select("entity", "field", F.coalesce("source", F.lit("seed")).alias("source"), F.concat(F.lit("backfill:cascade:"), _of(c("artist"), c("title"))).alias("query_key"), F.lit("FOUND").alias("state"), "value")
    q = F.concat(F.lit("webmatch:"), _of(c("q_artist"), c("q_title")))
    two = _rows(hits, [found(c("entity"), f, c("source"), q, c(f)) for f in ("artist", "title", "album", "year")])
    three = failures.select("entity", F.lit("artist").alias("field"), "source", q.alias("query_key"), F.lit("TEMPORARY_FAILURE").alias("state"), F.lit(None).cast("string").alias("value"))
    by = reviews.where("entity IS NOT NULL").select("entity", F.lower(F.concat(F.coalesce("artist", F.lit("")), F.lit("|"), F.coalesce("title", F.lit("")))).alias("key"))
    sheet = lyrics.withColumn("source", F.coalesce("source", F.lit("lrclib"))).join(by, "key")
    absent = F.coalesce(c("status") == "absent", F.lit(False))
    said = lambda f, v: F.when(absent | ~is_blank(c(v)), F.struct(c("entity"), F.lit(f).alias("field"), c("source"), F.concat(F.lit("lyrics:"), "key").alias("query_key"), F.when(absent, "NO_MATCH").otherwise("FOUND").alias("state"), F.when(~absent, c(v)).alias("value")))
    four = _rows(sheet, [said("lyrics_synced", "synced"), said("lyrics_plain", "plain")])
    each = reviews.where("entity IS NOT NULL AND source IS NOT NULL").withColumn("one", F.explode(sources_of(c("source"))))
    five = _rows(each, [found(c("entity"), f, c("one"), F.concat(F.lit("review:"), "file"), c(f)) for f in ("artist", "title", "album", "year")])
    return one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)


LOCAL = ("tags", "band", "filename", "folder")


def local_rows(files: DataFrame) -> DataFrame:
    """Observations of what files (entity, stem, folder, file_artist, file_title, tag_artist, tag_title, band) say of themselves: name, tags, band and folder apart, blank ones none."""
    c = F.col
    name, tags = F.concat(F.lit("filename:"), "stem"), F.concat(F.lit("tags:"), _of(c("tag_artist"), c("tag_title")))
    return _rows(files, [
        found(c("entity"), "artist", F.lit("filename"), name, c("file_artist")),
        found(c("entity"), "title", F.lit("filename"), name, c("file_title")),
        found(c("entity"), "artist", F.lit("tags"), tags, c("tag_artist")),
        found(c("entity"), "title", F.lit("tags"), tags, c("tag_title")),
        found(c("entity"), "artist", F.lit("band"), F.concat(F.lit("band:"), "band"), c("band")),
        found(c("entity"), "collection", F.lit("folder"), F.concat(F.lit("folder:"), "folder"), c("folder")),
    ])


def replace_scoped(store: DataFrame, batch: DataFrame, scope: Column, by: str = "entity") -> DataFrame:
    """store with the rows in scope of batch's entities replaced by batch."""
    gone = store.where(scope).join(batch.select(by).distinct(), by, "left_semi")
    return store.join(gone.select(*KEY), KEY, "left_anti").unionByName(batch)


def relocation(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, new_path, clash): each path under the longest prefix that ends at a separator; clash if two paths, or an unmoved one, land on it.

    Each path meets prefixes (old, new) on its ancestors and itself, so any number of prefixes will do. Null paths are left out.
    """
    up = F.explode(F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))"))
    hit = paths.where("path IS NOT NULL").select("path", up.alias("old")).join(broadcast_if_small(prefixes), "old", "left")
    hit = hit.select("path", F.when(F.col("new").isNotNull(), F.col("old")).alias("old"), "new")
    best = hit.groupBy("path").agg(F.max_by(F.struct("old", "new"), F.coalesce(F.length("old"), F.lit(-1))).alias("p"))
    moved = best.select("path", F.when(F.col("p.old").isNull(), F.col("path")).otherwise(F.concat("p.new", F.expr("substring(path, length(p.old) + 1)"))).alias("new_path"))
    n = moved.groupBy("new_path").agg(F.count(F.lit(1)).alias("n"))
    return moved.join(n, "new_path").select("path", "new_path", ((F.col("n") > 1)).alias("clash"))


def collapse(df: DataFrame, key: str, order: list[Column], count: str = "copies") -> DataFrame:
    """The first row of each key and how many there were."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count(F.lit(1)).alias(count)).select(key, "r.*", count)


def first_known(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with blank values filled by the first known value of the row's key."""
    known = df.where(~is_blank(F.col(value))).groupBy(key).agg(F.min_by(value, order).alias("_known"))
    return df.join(known, key, "left").withColumn(value, F.when(is_blank(F.col(value)), F.col("_known")).otherwise(F.col(value))).drop("_known")


def ranked(by: list[str], order: list[Column], name: str = "rank"):
    """row_number over a group as a long column."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long").alias(name)
