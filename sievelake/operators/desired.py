"""Outputs as a table of what is wanted: what a run has to write, found without reading what hasn't moved; tags of several dialects as one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators.bucketed import Store
from sievelake.operators.candidates import mapped
from sievelake.runtime import cut


class Outputs:
    """The state last written (entity, field, value), in buckets by entity, with a digest of each bucket.

    A field is wanted with a value, wanted gone (value null), or unknown (no row), and then what stands there is left alone.
    Digests of the wanted rows are compared bucket by bucket; only buckets whose digest moved are read and compared row by row.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.store = Store(spark, f"{path.rstrip('/')}/state", key=["entity", "field"], buckets=buckets)
        self.path = path.rstrip("/")

    def _digests(self, rows: DataFrame) -> dict[str, str]:
        """Digest of each bucket's rows: two sums over the rows' hashes that don't depend on their order, and their number."""
        h = lambda seed: F.xxhash64(F.lit(seed), "entity", "field", F.coalesce("value", F.lit("")), F.col("value").isNull())
        got = rows.groupBy(self.store.bucket().alias("b")).agg(F.bit_xor(h(1)).alias("x"), F.bit_xor(h(2)).alias("y"), F.count(F.lit(1)).alias("n"))
        return {str(r["b"]): f"{r['x']:x}.{r['y']:x}.{r['n']}" for r in got.collect()}  # as many rows as there are buckets

    def _last(self) -> dict[str, str]:
        version = self.store.manifest()["version"]
        names = self.store.files.names(f"{self.path}/digests")
        return json.loads(self.store.files.get(f"{self.path}/digests/{version:010d}.json")) if f"{version:010d}.json" in names else {}

    def moved(self, wanted: DataFrame) -> list[int]:
        """The buckets whose digest isn't that of the last state."""
        new, old = self._digests(wanted), self._last()
        return sorted(int(b) for b in new.keys() | old.keys() if new.get(b) != old.get(b))

    def changes(self, wanted: DataFrame, buckets: list[int]) -> DataFrame:
        """(entity, field, action, old, new) in some buckets: set, changed, deleted, or released where a field is no longer known."""
        held = self.store._read(self.store.manifest(), buckets)
        new = wanted.select("entity", "field", F.struct("value").alias("w")).where(self.store.bucket().isin(buckets) if buckets else F.lit(False))
        if held is None:
            held = new.select("entity", "field", F.lit(None).cast("string").alias("value")).limit(0)
        both = held.select("entity", "field", F.struct("value").alias("h")).join(new, ["entity", "field"], "full_outer")
        was, now = F.col("h.value"), F.col("w.value")
        action = F.when(F.col("w").isNull(), "released").when(now.isNull() & F.col("h").isNotNull() & was.isNull(), None).when(now.isNull(), "deleted").when(F.col("h").isNull() | was.isNull(), "set").when(was != now, "changed")
        return both.select("entity", "field", action.alias("action"), was.alias("old"), now.alias("new")).where("action IS NOT NULL")

    def apply(self, wanted: DataFrame) -> DataFrame:
        """The changes that make the last state wanted (entity, field, value; unique by entity and field), once the new state is kept."""
        wanted = cut(wanted.select("entity", "field", "value"))
        moved = self.moved(wanted)
        out = cut(self.changes(wanted, moved))
        if moved:
            version = self.store.replace(wanted, moved)
            self.store.files.put(f"{self.path}/digests/{version:010d}.json", json.dumps(self._digests(wanted)))
        return out


#: Frames of one dialect, keys of the two others in the order in which they are asked, where one keeps fields of its own, and what tells art and lyrics.
FRAMES = {"TPE1": "artist", "TIT2": "title", "TALB": "album", "TDRC": "year", "TCON": "genre", "TBPM": "bpm", "TKEY": "key", "TLAN": "language"}
KEYS = {"artist": ("artist", "\u00a9art"), "title": ("title", "\u00a9nam"), "album": ("album", "\u00a9alb"), "year": ("date", "\u00a9day"), "genre": ("genre", "\u00a9gen"), "bpm": ("bpm", "tmpo")}
OWN = "----:com.apple.iTunes:"
SHOWN = {"APIC": "_art", "USLT": "_lyrics", "pictures": "_art", "covr": "_art", "lyrics": "_lyrics", "\u00a9lyr": "_lyrics"}


def tags_of(raw: DataFrame) -> DataFrame:
    """(path, field, value) of tags (path, dialect, seq, key, name, value), whose dialect is id3 or another: fields by their common name, a file's own ones as x:NAME, art and lyrics as _art and _lyrics (value true).

    The first value of a key counts. name is the description of a TXXX frame. Of the other dialects own fields
    are those after OWN; every key without a colon stands as x:KEY too, unless an own field has that name. Null values and keys give nothing.
    """
    id3, key = F.col("dialect") == "id3", F.col("key")
    low = F.lower(key)
    r = raw.where(key.isNotNull() & F.col("value").isNotNull())
    own = key.startswith(OWN)
    shown = F.when(id3, mapped(key, {k: v for k, v in SHOWN.items() if k.isupper()}, None)).otherwise(mapped(low, {k: v for k, v in SHOWN.items() if not k.isupper()}, None))
    known = F.lit(None).cast("struct<field:string,rank:int>")
    for field, names in KEYS.items():
        for i, n in enumerate(names):
            known = F.when(low == n, F.struct(F.lit(field).alias("field"), F.lit(i).alias("rank"))).otherwise(known)
    field = F.when(id3, F.when(key == "TXXX", F.concat(F.lit("x:"), F.coalesce("name", F.lit("")))).otherwise(mapped(key, FRAMES, None))).otherwise(known["field"])
    rank = F.when(id3, 0).otherwise(known["rank"])
    extra = F.when(~id3 & own, F.concat(F.lit("x:"), F.substring_index(key, ":", -1))).when(~id3 & ~F.contains(key, F.lit(":")), F.concat(F.lit("x:"), F.upper(key)))
    said = F.array(
        F.struct(field.alias("field"), rank.cast("int").alias("rank"), F.col("value").alias("value")),
        F.struct(extra.alias("field"), F.when(own, 0).otherwise(1).alias("rank"), F.col("value").alias("value")),
        F.struct(shown.alias("field"), F.lit(0).alias("rank"), F.lit("true").alias("value")),
    )
    rows = r.select("path", "seq", F.inline(said)).where("field IS NOT NULL")
    return rows.groupBy("path", "field").agg(F.min_by("value", F.struct("rank", "seq")).alias("value"))
