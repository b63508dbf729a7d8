"""Titles as uploaders write them: decorations, slogans and tails taken off, and artist and title told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions.names import blank

#: Decorations of a lyric query; of a video's title; tokens of wholly decorative brackets; slogans of channels; tails.
LYRIC_CRUFT = r"(?iU)\s*[(\[|]?\s*(?:official\s*(?:music\s*)?(?:video|audio|lyric\s*video|4k|hd)|lyrics?\s*video|lyric\s*video|lyrics?|official|audio|video|hq|hd|4k|full\s*hd|visualizer|mv|m/?v|free\s*download|out\s*now|\d{4}\.?)\s*[)\]|]?\s*"
VIDEO_CRUFT = r"(?iU)\s*[(\[|]?\s*(?:official\s*(?:music\s*)?(?:video|audio|lyric\s*video)|lyrics?\s*video|lyric\s*video|lyrics?|official|audio|video|hq|hd|4k|full\s*hd|visualizer|mv|remaster(?:ed)?(?:\s*\d{4})?|tekst|prevod|spot|u[zxž]ivo)\s*[)\]|]?\s*"
GROUP_TOKEN = r"official|music|video|audio|lyrics?|lyric|letra|text|tekst|prevod|spot|hq|hd|4k|uhd|visualizer|mv|remaster(?:ed)?|live|u[zxž]ivo|full|version|versi[oó]n|oficial|hq/hd|(?:19|20)\d{2}"
GROUP = r"(?iU)[(\[](?:[\s/,;:|.–—_+-]*(?:" + GROUP_TOKEN + r")(?=[\s/,;:|.–—_+\-)\]]))*[\s/,;:|.–—_+-]*[)\]]"
SLOGAN = r"(?iU)\|\s*(?:[^|]{1,24}?\s*[-–—]\s*)?(?:copyright[\s-]*free|no[\s-]*copyright|ncs[\s-]*release|royalty[\s-]*free|free[\s-]*download)(?:\s*(?:music|download|release))?\s*(?:\||$)"
TAIL = r"(?iU)\s*[(\[]?\s*(?:oficial|oficjalne|officiel|resmi|napisy|из\s+фильма|from\s+\S+.*)\s*[)\]]?\s*$"
#: Marks that quote a name, a quote and a dash that part a title without a space, and what describes a recording instead of naming it.
QUOTES = "\"'\u2018\u2019\u201c\u201d\u00ab\u00bb"
QUOTE_DASH = r"(?U)(?<=[" + QUOTES + r"])\s*[-\u2013\u2014]\s+"
DESCRIBES = r"(?iU)^\s*(?:an?\s+[\w' ]{0,40}?)?(?:parody|cover|remix|tribute|mashup|medley|rendition)\b"
SPLIT = r"\s+[-–—]\s+|\s*：\s*|\s+:\s+|\s*\|\s*"
PAIR = r"^\s*(.{2,60}?)\s+[-–—]\s+(.{2,80}?)\s*$"
FIELD = r"(?iU)^\s*(artist|izvo[dđ]a[cč]|izvodjac|pjeva|peva|performer|music|muzika|vokal|song|pjesma|pesma|naslov|title|tekst)\s*[:\-]\s*(.{2,80}?)\s*$"
ARTISTY = r"(?iU)^\s*(?:artist|izvo[dđ]a[cč]|izvodjac|pjeva|peva|performer|music|muzika|vokal)"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _stripped(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def lyric_title(c: Column) -> Column:
    """A title as lyrics are asked for: without decorations and a year at the end; itself where nothing would be left."""
    out = F.regexp_replace(c, LYRIC_CRUFT, " ")
    out = F.regexp_replace(out, r"\s*[(\[]?\s*(?:19|20)\d{2}\.?\s*[)\]]?\s*$", "")
    out = _stripped(F.regexp_replace(out, r"\s{2,}", " "), r" \-_|.")
    return F.when(out == "", c).otherwise(out)


def video_title(c: Column) -> Column:
    """A video's title without decorative brackets, slogans, decorations, tails, a stray closing bracket; a year at the end goes only with some decoration. Itself where nothing would be left."""
    n = lambda x, ch: F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))
    slogan = lambda g: F.when(g.rlike(SLOGAN), F.substring_index(g, "|", 1)).otherwise(g)
    year = lambda x: F.when(x["gone"], F.regexp_replace(x["t"], r"\s+(?:19|20)\d{2}\s*$", "")).otherwise(x["t"])
    tails = lambda p: F.regexp_replace(F.regexp_replace(p, TAIL, ""), r"\s*[-–—(\[]\s*(?:19|20)\d{2}\s*[)\]]?\s*$", "")
    plain = _let(F.regexp_replace(c, GROUP, " "), lambda g: _let(slogan(g), lambda s: _let(F.regexp_replace(s, VIDEO_CRUFT, " "), lambda p: F.struct(tails(p).alias("t"), ((g != c) | (p != s)).alias("gone")))))
    out = _let(plain, lambda x: _stripped(F.trim(year(x)), "\"“”«»‘’"))
    out = _let(out, lambda x: F.when(n(x, ")") > n(x, "("), F.regexp_replace(x, "[) ]+$", "")).otherwise(x))
    out = _let(out, lambda x: F.when(n(x, "]") > n(x, "["), F.regexp_replace(x, r"[\] ]+$", "")).otherwise(x))
    out = _stripped(F.regexp_replace(out, r"\s{2,}", " "), r" \-_|.–—/")
    return F.when(blank(c) == "", c).otherwise(F.coalesce(F.nullif(out, F.lit("")), c))


def names_from(title: Column, channel: Column, description: Column, meta_artist: Column, meta_title: Column) -> Column:
    """struct(artist, title, how) of a video: what its site states; what a distributor provided; its title split, where a quoted left side before a description names the song of the channel; credits of its description; an unspaced dash; else its channel and title, less a leading artist."""
    return _let(F.struct(video_title(blank(title)).alias("c"), _parts(blank(title)).alias("raw")), lambda x: _named(x["c"], x["raw"], channel, description, meta_artist, meta_title))


def _parts(c: Column) -> Column:
    """The parts of a title between its separators; where there is none, between a closing quote's dash."""
    full = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    return _let(full(F.split(c, SPLIT)), lambda p: F.when(F.size(p) > 1, p).otherwise(full(F.split(c, QUOTE_DASH, 2))))


def _named(clean: Column, raw: Column, channel: Column, description: Column, meta_artist: Column, meta_title: Column) -> Column:
    parts = _parts(clean)
    row = lambda a, t, how: F.struct(a.alias("artist"), t.alias("title"), F.lit(how).alias("how"))
    provided = r"\n\n(.+?)\s+·\s+(.+?)\n"
    stated = F.when((blank(meta_artist) != "") & (blank(meta_title) != ""), row(meta_artist, meta_title, "site metadata"))
    given = F.when(F.contains(blank(description), F.lit("Provided to YouTube")) & blank(description).rlike(provided), row(F.trim(F.split(F.regexp_extract(description, provided, 2), "·")[0]), F.trim(F.regexp_extract(description, provided, 1)), "description"))
    chan = F.trim(F.replace(blank(channel), F.lit(" - Topic"), F.lit("")))
    left, right_side = F.get(raw, 0), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " - ")
    quoted = (F.size(parts) > 1) & (F.length(left) > 2) & left.rlike(f"(?s)^[{QUOTES}].*[{QUOTES}]$") & right_side.rlike(DESCRIBES)
    song = F.trim(_stripped(left, QUOTES))
    named = F.when(quoted, F.when(chan != "", row(chan, song, "quoted title, uploader")).otherwise(row(F.lit(None).cast("string"), song, "quoted title, artist unknown")))
    split = F.when(F.size(parts) > 1, row(parts[0], F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " - "), "video title"))
    lines = F.slice(F.filter(F.transform(F.split(blank(description), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 25)
    fields = F.filter(lines, lambda x: x.rlike(FIELD))
    value = lambda x: F.trim(F.regexp_extract(x, FIELD, 2))
    who, what = F.get(F.filter(fields, lambda x: x.rlike(ARTISTY)), 0), F.get(F.filter(fields, lambda x: ~x.rlike(ARTISTY)), 0)
    field = F.when(who.isNotNull(), row(value(who), F.coalesce(value(what), clean), "description field"))
    low = F.lower(clean)
    side = lambda x, i: F.trim(F.regexp_extract(x, PAIR, i))
    pairs = F.filter(lines, lambda x: x.rlike(PAIR) & (low != "") & (F.contains(F.lower(side(x, 2)), low) | F.contains(F.lower(side(x, 1)), low)))
    p = F.get(pairs, 0)
    right = F.contains(F.lower(side(p, 2)), low)
    line = F.when(p.isNotNull(), row(F.when(right, side(p, 1)).otherwise(side(p, 2)), F.when(right, side(p, 2)).otherwise(side(p, 1)), "description line"))
    bare = F.split(clean, r"\s*[-–—]\s*")
    a, b = F.trim(bare[0]), F.trim(F.get(bare, 1))
    dash = F.when((F.size(bare) == 2) & (F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, F.lit(" ")) | F.contains(b, F.lit(" "))), row(a, b, "video title"))
    rest = F.trim(F.regexp_replace(F.substring(clean, F.length(chan) + 1, F.length(clean)), r"^[ \-–—:|.]+", ""))
    own = F.when((chan != "") & (F.length(clean) > F.length(chan)) & F.startswith(low, F.lower(chan)) & (F.length(rest) >= 3), rest).otherwise(clean)
    return F.coalesce(stated, given, named, split, field, line, dash, row(F.nullif(chan, F.lit("")), F.nullif(own, F.lit("")), "channel + title"))
