"""Candidates of catalogues scored, ranked, confirmed and merged into one proposal a track."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import names as N
from sievelake.functions.text import sequence_ratio
from sievelake.runtime import cut

#: Rank of a release's type; weight of a name by how far it is trusted; confidence of a grade; order in which a source's album and cover are taken.
TYPE_RANK = {"Album": 0, "EP": 1, "Single": 2, "Compilation": 5, "Live": 6, "Soundtrack": 6, "Remix": 6, "Broadcast": 8, "Other": 8}
NAME_WEIGHT = {"weak": 0.35, "filename": 0.65, "tag": 0.70, "description": 0.75, "override": 0.75}
CONFIDENCE = {"A": 0.90, "B": 0.80, "C": 0.70}
PREFERRED = ("deezer", "itunes", "ytmusic")
#: Titles of compilations and of dated bootlegs.
COMPILATION = r"(?i)(promo only|now that'?s|now \d+|ultimate|greatest hits|\bhits\b|anthems|classics|essential|the best of|best of \d{4}|\bvol\.?\s*\d|\bvolume\s*\d|compilation|sampler|megamix|\d{2,3}% hits|top \d+|mixtape|radio \d)"
BOOTLEG = r"^\s*\d{4}-\d{2}-\d{2}"
#: Identities of equal names need this ratio.
SAME = 0.92


def mapped(key: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def release_rank(kind: Column, secondary: Column, artists: Column, recorded_by: Column, title: Column) -> Column:
    """Rank of a release group, least first: its type, and penalties for a secondary type, various or other artists, a compilation's title, a bootleg's date. artists and recorded_by are arrays of norm_identity() forms."""
    credit = F.when(F.array_contains(artists, "various artists"), 4).when((F.size(artists) > 0) & (F.size(recorded_by) > 0) & ~F.arrays_overlap(artists, recorded_by), 2).otherwise(0)
    t = N.blank(title)
    return mapped(kind, TYPE_RANK, 7) + F.when(secondary, 4).otherwise(0) + credit + F.when(t.rlike(COMPILATION), 3).otherwise(0) + F.when(t.rlike(BOOTLEG), 6).otherwise(0)


def best_fit(readings: list[tuple[Column, Column, Column, Column]]) -> Column:
    """struct(fit, artist_similarity, title_similarity) of the best reading (is there one, has it an artist, artist similarity, title similarity); of equal ones the first."""
    tried = [F.when(there, F.struct(F.when(has, 0.4 * a + 0.6 * t).otherwise(t).alias("fit"), F.lit(-i).alias("first"), F.when(has, a).otherwise(0.0).alias("a"), t.alias("t"))) for i, (there, has, a, t) in enumerate(readings)]
    best = F.array_max(F.array_compact(F.array(*tried)))
    return F.struct(best["fit"].alias("fit"), best["a"].alias("artist_similarity"), best["t"].alias("title_similarity"))


def with_name_fit(pairs: DataFrame, artist: str, title: str, credited: list[str], found: str, name: str = "f") -> DataFrame:
    """pairs with column `name`: best_fit() of artist and title against credited artists and a found title, read in both orders, and with an act featured in the title for the artist.

    Similarities are matching-blocks ratios of identity forms, 0 where one is blank. Each is worked out once, as a column of its own, before they are weighed.
    """
    feat = F.regexp_replace(F.regexp_extract(N.blank(F.col(title)), N.FEATURED_BY, 1), r"^[ ()\[\]]+|[ ()\[\]]+$", "")
    d = pairs.withColumn("_feat", feat)
    plain = {"_a": artist, "_t": title, "_f": "_feat", "_g": found} | {f"_c{i}": c for i, c in enumerate(credited)}
    d = d.withColumns({k: N.norm_identity(F.col(v)) for k, v in plain.items()})
    asked = [("_t", "_g"), ("_a", "_g")] + [(w, f"_c{i}") for w in ("_a", "_t", "_f") for i in range(len(credited))]
    d = d.withColumns({f"_s{x}{y}": sequence_ratio(F.col(x), F.col(y)) for x, y in asked})
    s = lambda x, y: F.when((F.col(x) == "") | (F.col(y) == ""), 0.0).otherwise(F.col(f"_s{x}{y}"))
    d = cut(d)
    most = lambda x: reduce(lambda p, q: F.greatest(p, q), [s(x, f"_c{i}") for i in range(len(credited))])
    has = lambda c: N.blank(F.col(c)) != ""
    fit = best_fit([(F.lit(True), has(artist), most("_a"), s("_t", "_g")), (has(artist) & has(title), F.lit(True), most("_t"), s("_a", "_g")), (N.blank(F.col(title)).rlike(N.FEATURED_BY), F.col("_feat") != "", most("_f"), s("_t", "_g"))])
    return d.select(*pairs.columns, fit.alias(name))


def heard_score(heard: Column, fit: Column, title: Column, trust: Column) -> Column:
    """Score of a candidate found by sound: its own, and the name's fit by how far the name is trusted; without a name its own alone."""
    w = mapped(trust, NAME_WEIGHT, NAME_WEIGHT["filename"])
    return F.when(N.blank(title) == "", heard).otherwise((1 - w) * heard + w * fit)


def searched_score(engine: Column, fit: Column) -> Column:
    """Score of a candidate found by text: three tenths the engine's, seven tenths the name's fit; without an engine's score the fit."""
    return F.when(engine.isNull(), fit).otherwise(0.3 * engine + 0.7 * fit)


def mutual(a: Column, b: Column) -> Column:
    """Whether one of two normal forms holds the other, and the first isn't blank."""
    return (a != "") & (F.contains(b, a) | F.contains(a, b))


def first_confirmed(candidates: DataFrame, key: str, position: str, ok: Column, value: Column, most: int = 5) -> DataFrame:
    """(key, value): of each key the first of its `most` candidates that satisfies ok."""
    return candidates.where((F.col(position) < most) & ok).groupBy(key).agg(F.min_by(value, F.col(position)).alias("value"))


def confirms(artist: Column, title: Column, found_artist: Column, found_title: Column) -> Column:
    return (N.fit(artist, found_artist) >= 0.6) & (N.fit(title, found_title) >= 0.6)


def corroborate(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(track, grade, confidence, sources, how, limited) of every track asked (track, artist, title, duration).

    answers (track, stage, source, pos, artist, title, duration, failed) are what
    sources said at the stages direct, cleaned and title. A stage counts only
    where the earlier ones gave nothing; a third source, itunes, only where fewer than two
    of the others hit. Of a source's answers that confirm artist and title the best fit
    counts, the nearest duration breaking ties, then the least pos; at stage title the first
    whose title fits and that has the artist anywhere. Answers that tie in all of it are told
    apart by their names, so that every run takes the same. Hits of another version are dropped, and the grade
    counts what is left.
    """
    a = answers.join(asked.select("track", F.col("artist").alias("wa"), F.col("title").alias("wt"), F.col("duration").alias("wd")), "track")
    fa, ft = N.fit(F.col("wa"), F.col("artist")), N.fit(F.col("wt"), F.col("title"))
    anywhere = (N.norm_catalogue(F.col("wa")) != "") & F.contains(N.norm_catalogue(F.concat_ws(" ", "artist", "title")), N.norm_catalogue(F.col("wa")))
    far = F.when((F.col("wd") > 0) & (F.col("duration") > 0), F.abs(F.col("wd") - F.col("duration"))).otherwise(999.0)
    titled = F.col("stage") == "title"
    ok = ~F.col("failed") & F.when(titled, (ft >= 0.8) & anywhere).otherwise((fa >= 0.6) & (ft >= 0.6))
    rank = F.struct(F.when(titled, 0.0).otherwise(fa + ft).alias("f"), F.when(titled, 0.0).otherwise(-far).alias("d"), (-F.col("pos")).alias("p"), "artist", "title")
    stage = mapped(F.col("stage"), {"direct": 0, "cleaned": 1, "title": 2}, 3)
    hits = a.where(ok).groupBy("track", stage.alias("s"), "source").agg(F.max_by(F.struct("artist", "title", "wt"), rank).alias("h"))
    per = hits.groupBy("track", "s").agg(F.sort_array(F.collect_list(F.struct("source", "h"))).alias("hs"))
    two = F.filter("hs", lambda x: x["source"] != "itunes")
    per = per.withColumn("hs", F.when((F.size(two) >= 2) | (F.col("s") > 0), two).otherwise(F.col("hs")))
    first = per.where(F.size("hs") > 0).groupBy("track").agg(F.min_by(F.struct("s", "hs"), "s").alias("b"))
    kept = F.filter(F.col("b.hs"), lambda x: F.size(F.array_union(F.array_except(N.version_words(x["h"]["wt"]), N.version_words(x["h"]["title"])), F.array_except(N.version_words(x["h"]["title"]), N.version_words(x["h"]["wt"])))) == 0)
    graded = first.select("track", F.col("b.s").alias("s"), kept.alias("kept"))
    down = answers.where("failed").select("track").distinct().withColumn("down", F.lit(True))
    all_ = asked.select("track").join(graded, "track", "left").join(down, "track", "left")
    n = F.coalesce(F.size("kept"), F.lit(0))
    grade = F.when(n >= 2, "A").when(n == 1, "B").otherwise("C")
    how = F.when(n == 0, "nothing found").when(F.col("s") == 0, "direct").when(F.col("s") == 1, "cleaned query").otherwise("title only, artist found in credit")
    names = F.transform("kept", lambda x: x["source"])
    best = F.array_max(F.transform("kept", lambda x: F.struct(mapped(x["source"], {s: len(PREFERRED) - i for i, s in enumerate(PREFERRED)}, 0).alias("o"), x["h"]["artist"].alias("artist"), x["h"]["title"].alias("title"))))
    return all_.select("track", grade.alias("grade"), mapped(grade, CONFIDENCE, 0.0).alias("confidence"), F.coalesce(F.array_join(names, "+"), F.lit("")).alias("sources"), how.alias("how"), best["artist"].alias("artist"), best["title"].alias("title"), ((grade != "A") & F.coalesce("down", F.lit(False))).alias("limited"))


def judged(c: dict[str, Column]) -> tuple[Column, Column]:
    """(confidence, reasons) of a proposal, from columns error, matched, n_results, combined, artist_similarity, title_similarity, heard, parsed_artist, parsed_title, source, release, release_type, n_candidates."""
    web = F.coalesce(c["source"].startswith("web:") & F.contains(c["source"], F.lit("+")), F.lit(False))
    two = lambda x: F.format_string("%.2f", x)
    no_artist = N.blank(c["parsed_artist"]) == ""
    # Factors, bounds and texts of the reasons.
    rules = [
        (no_artist, 0.85, F.lit("filename has no artist to corroborate")),
        (~no_artist & (c["artist_similarity"] < 0.5), 0.55, F.concat(F.lit("artist mismatch vs filename (similarity "), two(c["artist_similarity"]), F.lit(")"))),
        ((c["title_similarity"] < 0.6) & (N.blank(c["parsed_title"]) != ""), 0.7, F.concat(F.lit("title differs from filename (similarity "), two(c["title_similarity"]), F.lit(")"))),
        (c["heard"].isNull() & web, 1.0, F.concat(F.lit("corroborated by "), F.replace(F.substring(c["source"], 5, 1000), F.lit("+"), F.lit(" and ")))),
        (c["heard"].isNull() & ~web, 0.9, F.concat(F.lit("name-only match via "), F.coalesce(c["source"], F.lit("text search")), F.lit(", no audio confirmation"))),
        (c["heard"] < 0.8, 0.9, F.concat(F.lit("weak fingerprint score ("), two(c["heard"]), F.lit(")"))),
        (~c["release"], 0.95, F.lit("no album/year resolved")),
        (c["release"] & c["release_type"].isNotNull() & ~c["release_type"].isin("Album", "EP", "Single", "Compilation"), 1.0, F.concat(F.lit("album is a "), c["release_type"], F.lit(", may not be the original release"))),
        (c["n_candidates"] > 12, 1.0, F.concat(c["n_candidates"].cast("string"), F.lit(" competing candidates"))),
    ]
    conf = reduce(lambda x, r: F.when(F.coalesce(r[0], F.lit(False)), x * r[1]).otherwise(x), rules, c["combined"])
    said = F.array_compact(F.array(*[F.when(cond, why) for cond, _, why in rules]))
    said = F.when(F.size(said) == 0, F.array(F.lit("clean match"))).otherwise(said)
    none = F.when(c["error"].isNotNull(), F.concat(F.lit("lookup error: "), c["error"])).when(~c["matched"] & (c["n_results"] > 0), "fingerprint found but no usable recording metadata").when(~c["matched"], "no acoustic fingerprint match")
    return F.when(none.isNotNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))), F.when(none.isNotNull(), F.array(none)).otherwise(said)


def same_recording(old_artist: Column, old_title: Column, artist: Column, title: Column, ratio=sequence_ratio) -> Column:
    """Whether a name only respells the match it replaces: artist and title as one string, ratio of 0.92 at least."""
    a, b = (N.norm_identity(F.concat_ws(" ", F.nullif(x, F.lit("")), F.nullif(y, F.lit("")))) for x, y in ((old_artist, old_title), (artist, title)))
    return (a != "") & (b != "") & (ratio(a, b) >= SAME)


def answered(kind: Column, c: dict[str, Column]) -> dict[str, Column]:
    """A proposal after a person's answer: columns confidence, artist, title, recording_id, album, why.

    c has confidence, artist, title, recording_id, album (the proposal),
    said_artist, said_title, said_album (typed), link_artist, link_title, link_id,
    link_album, from_search (what the link resolved to) and respelled (same_recording()
    of old and new name). Facts of the replaced recording stay only if the answer
    respells it and names no other id.
    """
    linked = (kind == "url") & c["link_title"].isNotNull() & (c["link_artist"].isNotNull() | c["said_artist"].isNotNull())
    typed = kind == "override"
    kept = c["respelled"] & ~(linked & c["link_id"].isNotNull() & c["recording_id"].isNotNull() & (c["link_id"] != c["recording_id"]))
    noted = F.coalesce(c["said_artist"], c["said_title"], c["said_album"]).isNotNull()
    old = lambda x: F.when(kept, x)
    reject = kind == "reject"
    confirmed = (kind == "confirm") & (N.blank(c["artist"]) != "")
    return {
        "confidence": F.when(confirmed | typed, 1.0).when(reject, 0.0).when(linked, F.when(c["from_search"] & ~noted, 0.85).otherwise(1.0)).otherwise(c["confidence"]),
        "artist": F.when(reject, None).when(linked, F.coalesce(c["said_artist"], c["link_artist"])).when(typed, F.coalesce(c["said_artist"], c["artist"])).otherwise(c["artist"]),
        "title": F.when(reject, None).when(linked, F.coalesce(c["said_title"], c["link_title"])).when(typed, F.coalesce(c["said_title"], c["title"])).otherwise(c["title"]),
        "recording_id": F.when(reject, None).when(linked, F.coalesce(c["link_id"], old(c["recording_id"]))).when(typed, old(c["recording_id"])).otherwise(c["recording_id"]),
        "album": F.when(reject, None).when(linked, F.coalesce(c["said_album"], c["link_album"], old(c["album"]))).when(typed, F.coalesce(c["said_album"], old(c["album"]))).otherwise(c["album"]),
        "why": F.when(confirmed, "confirmed by you").when(reject, "rejected by you").when(linked, F.when(c["from_search"], "from a search you pasted").otherwise("from your link")).when((kind == "url") & c["link_title"].isNotNull(), "your link names no artist").when(kind == "url", "link not resolved yet").when(typed, "set by you").when(kind == "note", "your note"),
    }


def tier(kind: Column, confidence: Column, matched: Column, answered_: Column, auto: float = 0.90, review: float = 0.55) -> Column:
    """unmatched, auto, hinted, review or suspect, by the answer first."""
    return F.when(kind == "reject", "unmatched").when(kind.isin("confirm", "override") | ((kind == "url") & (confidence >= 1.0)), "auto").when(answered_, "hinted").when(~matched, "unmatched").when(confidence >= auto, "auto").when(confidence >= review, "review").otherwise("suspect")


def proposal(tracks: DataFrame, heard: DataFrame, text: DataFrame, named: DataFrame, web: DataFrame) -> DataFrame:
    """(track, artist, title, combined, source): by sound; by text where sound found nothing; by file name where neither did; and by the web where its grade isn't C and its confidence is better.

    heard and text: (track, artist, title, combined, source); named: (track, artist, title,
    status); web: (track, artist, title, grade, confidence, sources). Each table has a track once.
    """
    one = lambda d, n: d.select("track", F.struct(*[c for c in d.columns if c != "track"]).alias(n))
    d = tracks.select("track").join(one(heard, "h"), "track", "left").join(one(text, "x"), "track", "left").join(one(named, "n"), "track", "left").join(one(web, "w"), "track", "left")
    sure = F.col("n.status") == "musicbrainz-confirmed"
    pick = lambda c: F.struct(F.col(f"{c}.artist").alias("artist"), F.col(f"{c}.title").alias("title"), F.col(f"{c}.combined").alias("combined"), F.col(f"{c}.source").alias("source"))
    guessed = F.struct(F.col("n.artist").alias("artist"), F.col("n.title").alias("title"), F.when(sure, 0.95).otherwise(0.70).alias("combined"), F.when(sure, "filename+musicbrainz").otherwise("filename-only").alias("source"))
    base = F.when(F.col("h").isNotNull(), pick("h")).when(F.col("x").isNotNull(), pick("x")).when(F.col("n.status").isNotNull() & (F.col("n.status") != "unsplittable"), guessed)
    d = d.withColumn("b", base)
    online = F.struct(F.col("w.artist").alias("artist"), F.col("w.title").alias("title"), F.col("w.confidence").alias("combined"), F.concat(F.lit("web:"), "w.sources").alias("source"))
    better = (F.col("w.grade") != "C") & (F.coalesce(F.col("b.combined"), F.lit(0.0)) < F.col("w.confidence"))
    return d.select("track", F.when(better, online).otherwise(F.col("b")).alias("p")).select("track", "p.*")
