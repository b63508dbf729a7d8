"""What people type: answers parsed into kinds, notes beside links, links classified, answers kept and applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may be typed for yes, no, drop this copy, fetch again.
YES = ("y", "yes", "ok", "correct", "da", "+", "1", "true", "right")
NO = ("n", "no", "wrong", "ne", "-", "0", "false", "bad")
DROP = ("drop", "dupe", "duplicate", "skip", "remove", "obrisi", "obriši")
REFETCH = ("redownload", "redl", "refetch", "download again", "ponovo")
FIELDS = ("artist", "title", "album", "year", "version")
#: Fixed value: the longest opening, in seconds, that an answer may cut.
MAX_CUT = 30.0
#: Links, videos and searches; who a note says is the artist; fields that a note gives.
URL = r"(?i)https?://\S+"
NOTE_ARTIST = r"(?iU)\(?\s*([^()]{2,60}?)\s+(?:is|are)\s+the\s+(?:real\s+)?artist\b"
NOTE_FIELD = r"(?iU)\b(artist|title|album|year)\s*[:=]\s*([^;|)\n]{2,60})"
VIDEO = r"(?:v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})"
SEARCH = r"(?i)youtube\.com/results\?[^ ]*search_query=([^&\s]+)"
#: Host with user and port, path and query of a link that may hold spaces.
PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Hosts and paths of searches, and of pages of one track.
SEARCH_PAGES = (("youtube.com", "/results"), ("music.youtube.com", "/search"), ("google.com", "/search"), ("deezer.com", "/search"), ("open.spotify.com", "/search"), ("soundcloud.com", "/search"), ("discogs.com", "/search"), ("musicbrainz.org", "/search"), ("last.fm", "/search"), ("bing.com", "/search"), ("duckduckgo.com", "/"))
TRACK_PAGE = r"(?i)(youtu\.be/|youtube\.com/watch|music\.youtube\.com/watch|deezer\.com/(\w\w/)?track/|open\.spotify\.com/track/|musicbrainz\.org/recording/|discogs\.com/release/)"


def _field(parts: Column, name: str) -> Column:
    """The last non-blank value of a named field among `name=value` and `name: value` parts."""

    def pair(p):
        sep = F.when(F.contains(p, F.lit("=")), "=").otherwise(":")
        at = F.locate("=", p)
        cut = F.when(sep == "=", at).otherwise(F.locate(":", p))
        return F.struct(F.lower(F.trim(F.substring(p, F.lit(1), cut - 1))).alias("k"), F.trim(F.substring(p, cut + 1, F.length(p))).alias("v"), (cut > 0).alias("ok"))

    return F.try_element_at(F.filter(F.transform(parts, pair), lambda x: x["ok"] & (x["k"] == name) & (x["v"] != "")), F.lit(-1))["v"]


def parse_answer(c: Column) -> Column:
    """struct(kind, text, artist, title, album, year): the first rule that fits, in this order: confirm, reject, drop, refetch, url, trim, intro (true, false or seconds), override by fields, else note. Blank: nulls."""
    h = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(h)
    trim_ = F.lower(F.regexp_extract(h, r"(?i)^trim\s*[=:]?\s*(\S+)\s*$", 1))
    intro = F.lower(F.regexp_extract(h, r"(?i)^intro\s*[=:]?\s*(\S+)\s*$", 1))
    secs = F.replace(intro, F.lit(","), F.lit(".")).try_cast("double")
    parts = F.split(h, r"\s*[;|]\s*")
    got = {k: _field(parts, k) for k in FIELDS}
    fields = F.coalesce(*got.values()).isNotNull()
    kind = (
        F.when(h == "", None)
        .when(low.isin(*YES), "confirm")
        .when(low.isin(*NO), "reject")
        .when(low.isin(*DROP), "drop")
        .when(low.isin(*REFETCH), "refetch")
        .when(h.rlike(URL), "url")
        .when(trim_.isin(*YES, *NO), "trim")
        .when(intro.isin(*YES, *NO) | ((secs > 0) & (secs <= MAX_CUT)), "intro")
        .when(fields, "override")
        .otherwise("note")
    )
    yes = lambda x: F.when(x.isin(*YES), "true").when(x.isin(*NO), "false")
    text = F.when(kind.isin("url", "note"), h).when(kind == "trim", yes(trim_)).when(kind == "intro", F.coalesce(yes(intro), secs.cast("string")))
    title = F.when(got["version"].isNotNull() & got["title"].isNotNull(), F.concat(got["title"], F.lit(" ("), got["version"], F.lit(")"))).otherwise(got["title"])
    only = lambda x: F.when(kind == "override", x)
    return F.struct(kind.alias("kind"), text.alias("text"), only(got["artist"]).alias("artist"), only(title).alias("title"), only(got["album"]).alias("album"), only(got["year"]).alias("year"))


def note_fields(c: Column) -> Column:
    """struct(artist, title, album, year) written beside a link: `X is the artist`, else the first `field: value` of each field. A value goes on to the next ; | ) or line end, for 60 characters at most, and what stands in it names no further field."""
    rest = F.regexp_replace(F.coalesce(c, F.lit("")), URL, " ")
    who = F.regexp_replace(F.trim(F.regexp_extract(rest, NOTE_ARTIST, 1)), r"^[ ,.-]+|[ ,.-]+$", "")
    fields, values = (F.regexp_extract_all(rest, F.lit(NOTE_FIELD), F.lit(i)) for i in (1, 2))
    said = lambda k: F.nullif(F.trim(F.get(values, F.array_position(F.transform(fields, F.lower), k).cast("int") - 1)), F.lit(""))
    return F.struct(F.coalesce(F.nullif(who, F.lit("")), said("artist")).alias("artist"), *[said(k).alias(k) for k in ("title", "album", "year")])


def link_kind(c: Column) -> Column:
    """text, search, track or other-url. A host counts on a label's boundary only; a search engine's root needs a query."""
    h = F.trim(F.coalesce(c, F.lit("")))
    part = lambda i: F.regexp_extract(h, PARTS, i)
    host = F.regexp_replace(F.split(F.lower(part(1)), ":")[0], r"^www\.", "")
    path, query = part(2), F.regexp_extract(part(3), "(?:^|&)q=([^&]*)", 1)
    search = F.lit(False)
    for name, start in SEARCH_PAGES:
        hit = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        search = search | ((hit & (query != "")) if name == "duckduckgo.com" else hit)
    return F.when(~F.lower(h).rlike("^https?://"), "text").when(search, "search").when(F.concat(host, path).rlike(TRACK_PAGE), "track").otherwise("other-url")


def link_key(c: Column) -> Column:
    """What a link is filed under: its video, its search, or itself without closing marks; null without a link."""
    c = F.coalesce(c, F.lit(""))
    video, search = F.regexp_extract(c, VIDEO, 1), F.regexp_extract(c, SEARCH, 1)
    other = F.get(F.filter(F.regexp_extract_all(c, F.lit(r"https?://\S+"), 0), lambda u: ~u.rlike(VIDEO) & ~u.rlike(SEARCH)), 0)
    return F.when(video != "", video).when(search != "", F.concat(F.lit("ytsearch1:"), F.try_url_decode(search))).otherwise(F.regexp_replace(other, r"[.,;)]+$", ""))


def merge_answers(answers: DataFrame) -> DataFrame:
    """(file, answer): of each file the answer read last (column seq); a note never displaces a real answer. Blank answers are none."""
    kind = parse_answer(F.col("answer"))["kind"]
    return answers.where(kind.isNotNull()).groupBy("file").agg(F.max_by("answer", F.struct((kind != "note").cast("int"), "seq")).alias("answer"))


def durable_answers(answers: DataFrame, links: DataFrame) -> DataFrame:
    """(file, answer, link) of every file that has either, blank where it has not, by file."""
    both = answers.select("file", "answer").join(links.select("file", "link"), "file", "full_outer")
    return both.select("file", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("link", F.lit("")).alias("link")).orderBy("file")


def typed_answers(answers: DataFrame, kind: str) -> DataFrame:
    """(file, value) of the answers of one kind: true, false or seconds."""
    return answers.select("file", parse_answer(F.col("answer")).alias("p")).where(F.col("p.kind") == kind).select("file", F.col("p.text").alias("value"))
