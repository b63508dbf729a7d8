"""What tracks are filed under and reported as: numbers, crates, sheets, scenes, genres, origins, aliases, links, health, coverage, desired outputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import names as N
from sievelake.operators.candidates import mapped
from sievelake.runtime import broadcast_if_small, cut, is_blank


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each group's rows numbered from 1 in order, also where a group is as large as the table.

    Rows are sorted by range, counted within partitions, and each partition adds what
    its groups have before it; only the counts of (group, partition) go through a window.
    """
    d = df.repartitionByRange(*[F.col(c) for c in by], *order).sortWithinPartitions(*[F.col(c) for c in by], *order)
    d = cut(d.withColumn("_id", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_id", 33))
    parts = d.groupBy(*by, "_p").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_p").alias("_q"), "_first", "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by] + [F.col("_p") == F.col("_q")]
    return d.join(broadcast_if_small(cut(parts)), on).select(*df.columns, (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias(name))


def crates(tracks: DataFrame, scenes: list[str], languages: tuple[str, ...], least: int = 15, small: int = 5) -> DataFrame:
    """(crate, path): every crate of tracks (path, bpm, language, origin, other_folder, genres, camelot, quality, audio_only, video, danceability, year).

    An artist's origin, a language of the region or its folder make a track regional, whatever its language says. Languages of
    fewer than `small` tracks become Other; other crates of fewer than `least` are dropped.
    """
    from sievelake.functions.decisions import band

    c = F.col
    regional = c("origin").isNotNull() | c("language").isin(*languages) | c("other_folder")
    regional = F.coalesce(regional, F.lit(False))
    at = lambda shelf, v: F.concat(F.lit(shelf + "/"), v)
    one = F.array(
        at("BPM", band(c("bpm"))),
        F.when(regional, F.lit("Language/Balkan")),
        F.when(regional, at("Language", c("origin"))).otherwise(at("Language", F.when(~is_blank(c("language")), c("language")))),
        at("Camelot", c("camelot")),
        F.when(c("quality") == "low", F.lit("Check quality")),
        F.when(c("audio_only"), F.lit("Needs identification")),
        F.when(~is_blank(c("video")), F.lit("Has YouTube link")),
        F.when(c("danceability") >= 1.2, F.lit("Mood/danceable")),
        at("Decade", F.concat((F.floor(F.substring(c("year"), 1, 4).try_cast("int") / 10) * 10).cast("string"), F.lit("s"))),
    )
    genre = F.transform(F.filter(F.coalesce(c("genres"), F.array().cast("array<string>")), lambda g: F.trim(g).isin(*scenes)), lambda g: F.concat(F.lit("Genre/"), F.trim(g)))
    all_ = cut(tracks.select("path", F.explode(F.concat(F.array_compact(one), genre)).alias("crate")))
    n = all_.groupBy("crate").agg(F.count(F.lit(1)).alias("n"))
    lang = c("crate").startswith("Language/")
    to = F.when(lang & ~c("crate").endswith("Balkan") & (c("n") < small), "Language/Other").otherwise(F.when(lang | (c("n") >= least), c("crate")))
    return all_.join(broadcast_if_small(n.select("crate", to.alias("to"))), "crate").where("to IS NOT NULL").select(c("to").alias("crate"), "path")


def scenes_of(tracks: DataFrame, members: DataFrame) -> DataFrame:
    """(track, scenes): the scenes of tracks (track, artist, year) in the order of members (scene, pos, artist, year_from, year_to); a range of years counts only where the year is known."""
    m = members.select("scene", "pos", N.fold_scene(F.col("artist")).alias("key"), "year_from", "year_to")
    t = tracks.select("track", N.fold_scene(F.col("artist")).alias("key"), "year")
    ok = F.col("year_from").isNull() | F.col("year").isNull() | F.col("year").between(F.col("year_from"), F.col("year_to"))
    hit = t.join(broadcast_if_small(m), "key").where(ok)
    return hit.groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "scene"))), lambda x: x["scene"]).alias("scenes"))


def from_tags(tags: Column, table: dict[str, str], junk: str, least: int = 10, share: float = 0.25) -> Column:
    """The name that the first tag (name, weight) which is heavy enough stands for; weights count from max(least, share of the top tag's)."""
    top = F.coalesce(F.array_max(F.transform(tags, lambda t: t["weight"])), F.lit(0))
    heavy = F.filter(tags, lambda t: (t["weight"] >= F.greatest(F.lit(least), top * share)) & ~is_blank(t["name"]) & ~F.trim(t["name"]).rlike(junk))
    to = lambda t: _first_match(F.trim(t["name"]), table)
    return F.get(F.filter(F.transform(heavy, to), lambda x: x.isNotNull()), 0)


def _first_match(name: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, to in reversed(table.items()):
        out = F.when(name.rlike(pattern), to).otherwise(out)
    return out


def allowed(name: Column, genres: tuple[str, ...], merge: dict[str, str], drop: tuple[str, ...], rules: dict[str, str]) -> Column:
    """The listed genre that a name means: by its folded form, by a merge, or by the first rule that fits; null for what is dropped or unknown."""
    k = F.trim(F.regexp_replace(N.unmarked(F.lower(F.trim(N.blank(name)))), "[^a-z0-9&+]+", " "))
    key = lambda g: re.sub("[^a-z0-9&+]+", " ", g.lower()).strip()
    known = {**{key(g): g for g in genres}, **{key(a): b for a, b in merge.items()}}
    direct = mapped(k, known, None).cast("string")
    ruled = F.lit(None).cast("string")
    for pattern, to in reversed(rules.items()):
        final = merge.get(key(to)) or (to if to in genres else None)
        if final:
            ruled = F.when(k.rlike(pattern), final).otherwise(ruled)
    return F.when((k == "") | k.isin(*drop), None).otherwise(F.coalesce(direct, ruled))


def genre_of(c: dict[str, Column], allow, from_, titlecase) -> Column:
    """struct(genre, why): scene; then, where the origin is known by code only, the shop's genre or nothing; track tags; artist tags; styles; the shop's genre; a broad shared tag of weight 50.

    c: scene, code_only, track_tags, artist_tags, styles, shop, and broad (the first shared tag of that weight, in order). allow maps a name to a listed
    genre, from_ tags to a name.
    """
    rung = lambda v, why: F.when(v.isNotNull(), F.struct(v.alias("genre"), F.lit(why).alias("why")))
    shop = rung(allow(c["shop"]), "deezer")
    rest = F.coalesce(rung(allow(from_(c["track_tags"])), "lastfm track"), rung(allow(from_(c["artist_tags"])), "lastfm artist"), rung(allow(c["styles"]), "discogs style"), shop, rung(allow(titlecase(c["broad"])), "lastfm broad"))
    return F.when(c["scene"].isNotNull(), F.struct(c["scene"].alias("genre"), F.lit("scene list").alias("why"))).when(c["code_only"], shop).otherwise(rest)


def origins(tags: DataFrame, codes: DataFrame, names: dict[str, str]) -> DataFrame:
    """(artist, country, label, why): by the country that most tags name (tags: artist, country, pos), else by that of most recordings' codes (artist, country, seq); of equally many the first. why says which, and whether the code disagrees."""

    def most(d, order):
        n = d.groupBy("artist", "country").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
        return n.groupBy("artist").agg(F.min_by("country", F.struct(-F.col("n"), F.col("o"))).alias("country"))

    d = most(tags, "pos").withColumnRenamed("country", "t").join(most(codes, "seq").withColumnRenamed("country", "i"), "artist", "full_outer")
    why = F.when(F.col("t").isNull(), "isrc").when(F.col("i") != F.col("t"), "lastfm (isrc disagrees)").otherwise("lastfm")
    country = F.coalesce("t", "i")
    return d.select("artist", country.alias("country"), mapped(country, names, None).cast("string").alias("label"), why.alias("why"))


def preferred_spellings(credits: DataFrame) -> DataFrame:
    """(key, spelling) of artists that credits (artist) spell in several ways: not Cyrillic, not shouted, most accents, most frequent, shortest, then the last in order."""
    a = F.col("artist")
    n = credits.where(~is_blank(a)).groupBy("artist").agg(F.count(F.lit(1)).alias("n")).withColumn("key", N.fold_artist(a))
    rank = F.struct((~N.is_cyrillic(a)).alias("a"), (~N.shouty(a)).alias("b"), N.accents(a).alias("c"), "n", (-F.length(a)).alias("e"), "artist")
    return n.groupBy("key").agg(F.max_by("artist", rank).alias("spelling"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "spelling")


def alias_mapping(facts: DataFrame, pinned: DataFrame, casing: DataFrame, rounds: int = 20) -> DataFrame:
    """(key, canonical, why): spellings of one artist id (facts: artist_id, artist, canonical) go to its canonical or most frequent name; pinned (key, canonical) replaces these, also where its name was a key; casing (key, spelling) adds what neither decides. Rules are followed to their end; on a cycle the last name before it closes."""
    from sievelake.operators.graph import resolve_aliases

    f = facts.where("artist_id IS NOT NULL AND artist IS NOT NULL").withColumn("artist", N.lead_of(F.col("artist")))
    n = f.groupBy("artist_id", "artist").agg(F.count(F.lit(1)).alias("n"), F.max("canonical").alias("c"))
    g = n.groupBy("artist_id").agg(F.coalesce(F.max("c"), F.min_by("artist", F.struct(-F.col("n"), F.col("artist")))).alias("best"), F.collect_set("artist").alias("all"))
    mb = g.select("best", F.explode("all").alias("s")).select(N.fold_artist(F.col("s")).alias("key"), F.col("best").alias("canonical")).where(F.col("key") != N.fold_artist(F.col("canonical"))).groupBy("key").agg(F.min("canonical").alias("canonical"))
    p = pinned.select(N.fold_artist(F.col("key")).alias("key"), "canonical")
    gone = p.select("key").unionByName(p.select(N.fold_artist(F.col("canonical")).alias("key"))).distinct()
    two = p.withColumn("why", F.lit("pinned")).unionByName(mb.join(gone, "key", "left_anti").withColumn("why", F.lit("musicbrainz")))
    three = two.unionByName(casing.select("key", F.col("spelling").alias("canonical")).join(two.select("key"), "key", "left_anti").withColumn("why", F.lit("casing")))
    m = cut(three)
    ends = resolve_aliases(m.select(F.col("key").alias("name"), N.fold_artist(F.col("canonical")).alias("alias")), rounds).select(F.col("name").alias("key"), F.col("canonical").alias("end"))
    # A chain's last rule gives the name as it is written.
    last = m.select(N.fold_artist(F.col("canonical")).alias("end"), "canonical").groupBy("end").agg(F.min("canonical").alias("final"))
    return m.join(ends, "key", "left").join(last, "end", "left").select("key", F.coalesce("final", "canonical").alias("canonical"), "why")


#: Origins of links in order, and seconds by which a lone search hit may drift.
ORIGINS, DRIFT = ("file comment", "your link", "redownloaded audio"), 30.0


def link_decisions(tracks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(track, video, trust, reason) of tracks (track, title, seconds, refused, confirmed) by candidates (track, video, source, tier, title, duration, inherited).

    Refused: nothing. Confirmed: that. An origin beats all, a track's own before an inherited
    one, then in the order of ORIGINS. Else the video that most sources name, if no other
    has as many; two sources are enough, or one exact; a lone search hit must be of the
    same version and length.
    """
    c = candidates
    o = c.where("tier = 'origin'").groupBy("track").agg(F.min_by("video", F.struct(F.coalesce("inherited", F.lit(False)), mapped(F.col("source"), {s: i for i, s in enumerate(ORIGINS)}, 9), F.col("video"))).alias("origin"))
    v = c.groupBy("track", "video").agg(F.countDistinct("source").alias("n"), F.min_by(F.struct("tier", "title", "duration"), F.struct("source", "tier", "title", "duration")).alias("f"))
    r = v.groupBy("track").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "video", "f"))).alias("r"))
    d = tracks.join(o, "track", "left").join(r, "track", "left")
    top, second = F.col("r")[0], F.get("r", F.lit(1))
    mine, theirs = N.version_words(F.col("title")), N.version_words(top["f"]["title"])
    far = F.abs(top["f"]["duration"] - F.col("seconds"))
    lone = F.when(mine != theirs, "version markers differ").when(~F.coalesce((top["f"]["duration"] > 0) & (F.col("seconds") > 0), F.lit(False)), "lone search hit, nothing to check it against").when(far > DRIFT, "search hit is too long or short")
    reason = F.when(F.col("refused") | F.col("confirmed").isNotNull() | F.col("origin").isNotNull() | F.col("r").isNull(), None).when(top["n"] >= second["n"], "sources disagree").when((top["n"] <= -2) | (top["f"]["tier"] == "exact"), None).otherwise(lone)
    video = F.when(F.col("refused"), None).otherwise(F.coalesce("confirmed", "origin", F.when(reason.isNull(), top["video"])))
    trust = F.when(video.isNull(), None).when(F.col("confirmed").isNotNull() | F.col("origin").isNotNull(), "origin").otherwise("reference")
    return d.select("track", video.alias("video"), trust.alias("trust"), reason.alias("reason"))


def health(probes: DataFrame, now: Column, ttl: float) -> DataFrame:
    """(source, state, usable, blocked): the last probe (source, state, detail, at) of each source that isn't older than ttl seconds; older ones say nothing."""
    last = probes.groupBy("source").agg(F.max_by(F.struct("state", "detail", "at"), F.struct("at", "state")).alias("p"))
    new = (now.cast("double") - F.col("p.at").cast("double")) < ttl
    state = F.when(new, F.col("p.state"))
    return last.select("source", state.alias("state"), F.coalesce(state == "FOUND", F.lit(False)).alias("usable"), F.when(state != "FOUND", F.concat(state, F.lit(": "), "p.detail")).alias("blocked"))


def sheet_of(tier: Column, artist: Column, title: Column, reasons: Column) -> Column:
    """The review sheet of a row: none for auto, unknown without a name, confirm where a reason contradicts the file's name, else verify."""
    against = F.exists(reasons, lambda r: F.contains(r, F.lit("mismatch vs filename")) | F.contains(r, F.lit("differs from filename")))
    return F.when(tier == "auto", None).when(is_blank(artist) | is_blank(title), "unknown").when(against, "confirm").otherwise("verify")


def coverage(sample: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(what, n): how many rows a sample has, and of how many each flag holds."""
    row = sample.agg(F.count(F.lit(1)).alias("tracks"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in ("tracks", *flags)])))


def pruned(outputs: DataFrame, intended: DataFrame) -> DataFrame:
    """Outputs (path, song) that nothing intends any more (path), and of whose song another intended output exists; the only copy of a song is never among them."""
    kept = outputs.join(intended.select("path"), "path", "left_semi").select("song").distinct()
    return outputs.join(intended.select("path"), "path", "left_anti").join(kept, "song", "left_semi").select("path", "song")


def unsent(rows: DataFrame, sent: DataFrame, size: int = 50) -> DataFrame:
    """(path, batch): the rows (path, tier, id) of tier auto with an id that weren't sent (path), in batches of `size` by path."""
    d = rows.where((F.col("tier") == "auto") & ~is_blank(F.col("id").cast("string"))).join(sent.select("path").distinct(), "path", "left_anti")
    return numbered(d.select(F.lit(0).alias("_all"), "path"), ["_all"], [F.col("path")], "n").select("path", F.floor((F.col("n") - 1) / size).alias("batch"))


def inserted_after(df: DataFrame, after: str, new: dict[str, Column]) -> DataFrame:
    """df with new columns right after one of its own; those that it has already are moved there and filled where they are blank."""
    cols = [c for c in df.columns if c not in new]
    at = cols.index(after) + 1
    fill = [(F.when(is_blank(F.col(n)), v).otherwise(F.col(n)) if n in df.columns else v).alias(n) for n, v in new.items()]
    return df.select(*cols[:at], *fill, *cols[at:])


def refreshed(rows: DataFrame, seeds: DataFrame, value: str, force: bool = False) -> DataFrame:
    """rows (path, base, value) with missing values taken from seeds (base, value); a base that seeds or rows have twice says nothing; force takes them everywhere."""
    once = lambda d: d.groupBy("base").count().where("count = 1").select("base")
    s = seeds.join(once(seeds), "base", "left_semi").join(once(rows), "base", "left_semi").select("base", F.col(value).alias("_new"))
    known = F.coalesce("_new", value) if force else F.coalesce(value, "_new")
    return rows.join(s, "base", "left").withColumn(value, known).drop("_new").select(rows.columns)


def top_tags(tags: DataFrame, stop: tuple[str, ...], least: int = 10, k: int = 3) -> DataFrame:
    """(track, genres): of tags (track, level, pos, name, weight) the first k that aren't in `stop` and weigh `least`, of the first level that has any."""
    d = tags.where(~is_blank(F.trim("name")) & ~F.lower(F.trim("name")).isin(*stop) & (F.col("weight") >= least))
    by = d.groupBy("track", "level").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.initcap(F.trim("name")).alias("name")))), lambda x: x["name"]), 1, k).alias("g"))
    return by.groupBy("track").agg(F.min_by("g", "level").alias("genres"))
