"""Decisions on measured values as column expressions: tempo and key, quality, silence, lyrics, links, replacements, pages, artwork."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import names as N
from sievelake.functions.measures import octave
from sievelake.runtime import bound

#: Bands of tempo.
BANDS = ((0, 90, "060-090"), (90, 100, "090-100"), (100, 110, "100-110"), (110, 120, "110-120"), (120, 128, "120-128 house"), (128, 135, "128-135"), (135, 150, "135-150"), (150, 999, "150+ fast"))
#: Silence: thresholds in dB; shortest and longest trim, guards, least gain of the end, seconds scanned, tolerance at the end.
BASE_DB, MARGIN_DB, MUSIC_DB, MOST_DB = -50.0, 6.0, -40.0, -30.0
MIN_TRIM, MAX_TRIM, GUARD, TAIL_GUARD, TAIL_GAIN, SCAN, EDGE = 0.2, 10.0, 0.04, 0.5, 0.5, 30.0, 0.5
#: Least fit of a name and drift of a lyric sheet in seconds; score below which timings are dropped; timed lines that prove words.
MIN_FIT, MAX_DRIFT, TIMING_BAR, TEXT_BAR, TIMED_LINES = 0.5, 2.0, 0.5, 0.5, 8
#: Least confidence and largest plausible offset of an alignment; drift of a lone search hit; origins of links in order.
MIN_CONFIDENCE, MAX_OFFSET, SEARCH_DRIFT = 0.5, 10.0, 30.0
ORIGINS = ("file comment", "your link", "redownloaded audio")


def band(bpm: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, name in BANDS:
        out = F.when((bpm >= lo) & (bpm < hi), name).otherwise(out)
    return out


def fold_to(b: Column, ref: Column) -> Column:
    """b in the octave that lies within a factor of 1.45 of ref; zero and null stay."""
    up, down = F.ceil(F.log2(ref / 1.45 / b)), F.ceil(F.log2(b / (ref * 1.45)))
    return F.when(~(b > 0), b).when(b < ref / 1.45, b * F.pow(F.lit(2.0), up.cast("double"))).when(b > ref * 1.45, b / F.pow(F.lit(2.0), down.cast("double"))).otherwise(b)


def tempo(rhythm: Column, percival: Column, degara: Column) -> Column:
    """struct(bpm, verdict, votes) of three engines' readings: agree, octave or disagree."""
    reads = F.filter(F.array(rhythm, degara, percival), lambda b: b > 20)
    folded = F.transform(reads, lambda b: fold_to(b, rhythm))
    spread = F.when(F.size(folded) > 0, F.array_max(folded) / F.array_min(folded)).otherwise(1.0)
    votes = F.size(F.filter(folded, lambda f: F.abs(f / folded[0] - 1) < 0.04))
    ratio = F.when(percival > 0, rhythm / percival).otherwise(0.0)
    same = (ratio > 0.97) & (ratio < 1.03)
    twice = ((ratio > 1.94) & (ratio < 2.06)) | ((ratio > 0.485) & (ratio < 0.515))
    mean = F.aggregate(folded, F.lit(0.0), lambda s, x: s + x) / F.size(folded)
    low = F.array_min(F.filter(F.array(rhythm, percival, degara), lambda b: b > 0))
    bpm = F.when(spread < 1.04, octave(F.round(mean, 1))).when(same, F.round((rhythm + percival) / 2, 1)).when(twice, octave(low)).otherwise(F.round(rhythm, 1))
    verdict = F.when(spread < 1.04, F.when(same, "agree").otherwise("octave")).when(same, "agree").when(twice, "octave").otherwise("disagree")
    return F.struct(bpm.alias("bpm"), verdict.alias("verdict"), votes.alias("votes"))


def key_vote(reads: Column) -> Column:
    """struct(key, scale, agreement as n/m, strength) of an array of (key, scale, strength): the most frequent key, of equally many the first read."""
    n = lambda x: F.size(F.filter(reads, lambda y: (y["key"] == x["key"]) & (y["scale"] == x["scale"])))
    best = F.array_max(F.transform(reads, lambda x, i: F.struct(n(x).alias("n"), (-i).alias("i"), x["key"].alias("key"), x["scale"].alias("scale"))))
    mine = F.filter(reads, lambda y: (y["key"] == best["key"]) & (y["scale"] == best["scale"]))
    return F.struct(best["key"].alias("key"), best["scale"].alias("scale"), F.concat(best["n"].cast("string"), F.lit("/"), F.size(reads).cast("string")).alias("agreement"), F.array_max(F.transform(mine, lambda y: y["strength"])).alias("strength"))


def bitrate(header: Column, size: Column, seconds: Column, fallback: Column) -> Column:
    """kbps: of the header, else of size over seconds, else the fallback."""
    return F.coalesce(F.when(header > 0, F.bround(header / 1000, 0)), F.when((seconds > 0) & size.isNotNull(), F.bround(size * 8 / seconds / 1000, 0)), fallback)


def spectral_cutoff(frames: Column, rate: float = 44100.0, drop: float = 50.0) -> Column:
    """Highest frequency within `drop` dB of the peak of the bin-wise maximum over an array of spectra; null without energy."""
    top = F.aggregate(F.slice(frames, 2, F.greatest(F.size(frames) - 1, F.lit(0))), frames[0], lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    peak = F.array_max(top)
    last = F.array_max(F.transform(top, lambda x, i: F.when(20 * F.log10(F.greatest(x, F.lit(1e-12)) / peak) > -drop, i)))
    return F.when((F.size(frames) > 0) & (peak > 0), last * (rate / 2) / (F.size(top) - 1))


def threshold(floor: Column) -> Column:
    """dB under which a file counts as silent: a margin over its noise floor, unless that is music."""
    return F.when(floor <= MUSIC_DB, F.least(F.lit(MOST_DB), F.greatest(F.lit(BASE_DB), floor + MARGIN_DB))).otherwise(F.lit(BASE_DB))


def leading_silence(runs: Column) -> Column:
    """Seconds of silence at the start: the first run (start, end) if it starts at 0; one that never ends is all that was scanned. runs are in order."""
    first = F.get(runs, 0)
    return F.when(F.abs(first["start"]) <= 0.001, F.coalesce(first["end"], F.lit(SCAN))).otherwise(0.0)


def trailing_silence(runs: Column, seconds: Column) -> Column:
    """Seconds of silence at the end: from the start of the first run that reaches the end, or of one that never ends; null for an unknown length."""
    ends = F.filter(runs, lambda r: r["end"].isNull() | (F.abs(r["end"] - seconds) < EDGE))
    return F.when(seconds.isNull() | (seconds == 0), None).when(F.size(ends) > 0, F.greatest(F.lit(0.0), seconds - F.get(ends, 0)["start"])).otherwise(0.0)


def silence(lead: Column, tail: Column, hint: Column) -> Column:
    """struct(decision, cut, tail_decision, tail_cut); hint: true releases, false keeps, null says nothing."""
    no = F.coalesce(~hint, F.lit(False))
    yes = F.coalesce(hint, F.lit(False))
    head = F.when(lead <= 0, "no_leading_silence").when(no, "kept_by_you").when(lead < MIN_TRIM, "skip_short").when((lead > MAX_TRIM) & ~yes, "review_long").otherwise("trim")
    end = F.when(tail.isNull(), "unmeasured").when(tail <= 0, "no_trailing_silence").when(no, "kept_by_you").when(tail - TAIL_GUARD < TAIL_GAIN, "skip_short").otherwise("trim")
    return F.struct(head.alias("decision"), F.when(head == "trim", F.round(F.greatest(F.lit(0.0), lead - GUARD), 3)).otherwise(0.0).alias("cut"), end.alias("tail_decision"), F.when(end == "trim", F.round(F.greatest(F.lit(0.0), tail - TAIL_GUARD), 3)).otherwise(0.0).alias("tail_cut"))


def lyric_text(c: dict[str, Column]) -> Column:
    """struct(score, reason) of a sheet's words, from columns offered, instrumental, timed_lines, confirmed, matched, has_text, artist, title, artist_fit, title_fit."""
    named = F.contains(N.blank(c["matched"]), F.lit(" - "))
    ma, mt = F.substring_index(c["matched"], " - ", 1), F.regexp_replace(N.blank(c["matched"]), r"^.*? - ", "")
    has = lambda x: N.blank(c[x]) != ""
    fits = F.struct(F.when(has("artist"), F.coalesce(c["artist_fit"], N.fit(c["artist"], ma))).alias("a"), F.when(has("title"), F.coalesce(c["title_fit"], N.fit(c["title"], mt))).alias("t"))

    def judged(x):
        af, tf = x["a"], x["t"]
        why = (
            F.when(~c["offered"], None)
            .when(c["instrumental"] & (c["timed_lines"] < TIMED_LINES), "instrumental")
            .when(~named, F.when(c["has_text"] & ~c["confirmed"], "unverifiable_match"))
            .when(af < MIN_FIT, F.when(~c["confirmed"], "wrong_artist"))
            .when(tf < MIN_FIT, F.when(~c["confirmed"], "wrong_title"))
        )
        passed = F.when(~c["offered"] | ~named | (af < MIN_FIT) | (tf < MIN_FIT), 1.0).otherwise(F.coalesce(F.least(af, tf), F.lit(1.0)))
        return F.struct(F.when(why.isNotNull(), 0.0).otherwise(passed).alias("score"), why.alias("reason"))

    return bound(fits, judged)


def lyric_timing(matched: Column, seconds: Column, cut: Column) -> Column:
    """1 to 0.5 for a drift of 0 to 2 seconds, 0 beyond, null where a length is unknown."""
    drift = F.abs(seconds - F.coalesce(cut, F.lit(0.0)) - matched)
    return F.when(matched.isNull() | (matched == 0) | seconds.isNull() | (seconds == 0), None).when(drift > MAX_DRIFT, 0.0).otherwise(1.0 - drift / MAX_DRIFT * (1.0 - TIMING_BAR))


def keep_timings(synced: Column, matched: Column, seconds: Column) -> Column:
    """synced, or null where its sheet's length drifts by more than two seconds."""
    return F.when(F.abs(seconds - matched) > MAX_DRIFT, None).otherwise(synced)


def tail_safe(cut: Column, seconds: Column, last: Column, timing: Column, text: Column) -> Column:
    """struct(safe, reason) of cutting the end: nothing is sung there, or the timings or words are refused already. last: time of the last line, null without timed lines."""
    free = (cut <= 0) | seconds.isNull() | (seconds == 0) | last.isNull() | (last < seconds - cut)
    return _safe(F.coalesce(free, F.lit(True)), timing, text, "sung inside the end")


def head_safe(cut: Column, first: Column, offset: Column, timing: Column, text: Column) -> Column:
    """struct(safe, reason) of cutting the front; an offset that wasn't measured is no conflict."""
    return _safe(F.coalesce((cut <= 0) | first.isNull() | offset.isNull() | (first + offset >= cut), F.lit(True)), timing, text, "sung inside the front")


def _safe(free: Column, timing: Column, text: Column, conflict: str) -> Column:
    why = F.when(free, None).when(timing < TIMING_BAR, "timings already dropped").when(text < TEXT_BAR, "sheet already refused").otherwise(conflict)
    return F.struct(F.coalesce(why != conflict, F.lit(True)).alias("safe"), why.alias("reason"))


def alignment(anchors: Column, words: Column, start: Column, score: Column, anchor_time: Column, same_sheet: Column) -> Column:
    """struct(status, offset) of lyrics laid against a transcript; the offset counts only for the sheet it was measured on."""
    off = start - anchor_time
    status = F.when(anchors == 0, "no_anchor").when(words < 3, "nothing_transcribed").when(start.isNull() | (score < MIN_CONFIDENCE), "low_confidence").when(F.abs(off) > MAX_OFFSET, "implausible").otherwise("measured")
    return F.struct(status.alias("status"), F.when((status == "measured") & same_sheet, F.round(off, 2)).alias("offset"))


def located(words: Column, anchor: Column, slack: int = 2, tolerance: float = 0.05) -> Column:
    """struct(start, score): the earliest place among words (time, token) whose window, as long as the anchor and `slack` more, holds almost as many of its tokens as the best does."""
    return bound(F.struct(words.alias("words"), anchor.alias("anchor")), lambda x: _located(x["words"], x["anchor"], slack, tolerance))


def _located(words: Column, anchor: Column, slack: int, tolerance: float) -> Column:
    n = F.size(anchor)

    def scored(w, i):
        window = F.transform(F.slice(words, i + 1, n + slack), lambda x: x["token"])
        return F.struct((F.size(F.filter(anchor, lambda t: F.array_contains(window, t))) / n).alias("score"), w["time"].alias("time"))

    # Scores and the best of them are bound to names, so each is worked out once.
    def chosen(a):
        best = F.array_max(F.transform(a, lambda x: x["score"]))
        at = lambda m: F.get(F.filter(a, lambda x: x["score"] >= m - tolerance), 0)["time"]
        return F.transform(F.array(best), lambda m: F.when(m > 0, F.struct(at(m).alias("start"), m.alias("score"))))[0]

    return F.when(n > 0, F.transform(F.array(F.transform(words, scored)), chosen)[0])


def from_milliseconds(lines: Column) -> Column:
    """Timed text of an array of (ms, text): minutes, seconds, hundredths; lines without time or text are left out; null without any."""
    some = F.filter(lines, lambda x: x["ms"].isNotNull() & (F.trim(N.blank(x["text"])) != ""))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    cs = lambda x: F.floor(x["ms"] / 10)
    line = lambda x: F.concat(F.lit("["), F.when(F.floor(cs(x) / 6000) > 99, F.floor(cs(x) / 6000).cast("string")).otherwise(two(F.floor(cs(x) / 6000))), F.lit(":"), two(F.floor(cs(x) % 6000 / 100)), F.lit("."), two(cs(x) % 100), F.lit("]"), F.trim(x["text"]))
    return F.nullif(F.array_join(F.transform(some, line), "\n"), F.lit(""))


def replacement(c: dict[str, Column], gain: float = 1200.0, drift: float = 8.0) -> Column:
    """struct(status, reason): whether a new copy replaces the old, from columns new_cutoff, new_seconds, old_cutoff, old_seconds, opening (seconds cut from the old), requested, yours (a link somebody gave), missing (the old is gone), occupied. A request or link waives length and gain."""
    waived = c["requested"] | c["yours"]
    d = F.least(F.abs(c["new_seconds"] - c["old_seconds"]), F.when(c["opening"] > 0, F.abs(c["new_seconds"] - (c["old_seconds"] - c["opening"]))))
    why = F.when(F.coalesce(c["new_cutoff"], F.lit(0.0)) == 0, "did not decode").when(~waived & (c["old_seconds"] > 0) & (c["new_seconds"] > 0) & (d > drift), "different length").when(c["missing"] & c["occupied"], "a file is back already").when(~c["missing"] & ~waived & (c["new_cutoff"] < F.coalesce(c["old_cutoff"], F.lit(0.0)) + gain), "no gain")
    status = F.when(why.isNull(), F.when(c["missing"], "restored").otherwise("kept")).when(why == "no gain", "not better").otherwise("rejected")
    return F.struct(status.alias("status"), why.alias("reason"))


def art_problems(width: Column, height: Column, spread: Column) -> Column:
    """What is wrong with an image: an edge under 250, not square within 12 %, hardly any colour."""
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(")"))
    return F.array_compact(F.array(F.when(F.least(width, height) < 250, F.concat(F.lit("small ("), size)), F.when((height > 0) & (F.abs(width / height - 1.0) > 0.12), F.concat(F.lit("not square ("), size)), F.when(spread < 24, "near-flat colour (likely placeholder)")))


_META = r'(?i)<meta[^>]+(?:property|name)="([^"]+)"[^>]+content="([^"]*)"'


def page_metadata(html: Column) -> Column:
    """struct(title, artist, description, seconds, album) that a page states of a song: an Open Graph title `X by Y` wins, else its first schema.org music node; null unless both title and artist are known."""
    keys, values = F.transform(F.regexp_extract_all(html, F.lit(_META), 1), F.lower), F.regexp_extract_all(html, F.lit(_META), 2)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    meta = lambda name: F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]
    blobs = F.regexp_extract_all(html, F.lit(r'(?is)<script type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    one = "struct<`@type`:string,name:string,byArtist:struct<name:string>>"
    nodes = F.flatten(F.transform(blobs, lambda b: F.when(F.ltrim(b).startswith("["), F.from_json(b, f"array<{one}>")).otherwise(F.array(F.from_json(b, one)))))
    music = F.filter(F.coalesce(nodes, F.array().cast(f"array<{one}>")), lambda x: F.contains(x["@type"], F.lit("Music")))
    first = lambda f: F.get(F.filter(F.transform(music, f), lambda v: N.blank(v) != ""), 0)
    og = N.blank(meta("og:title"))
    by = r"(?i)^(.*?)\s+by\s+(.+?)(?:\s*[:|].*)?$"
    said = og.rlike(by)
    title = F.when(said, F.coalesce(F.nullif(F.trim(F.regexp_extract(og, by, 1)), F.lit("")), first(lambda x: x["name"]))).otherwise(first(lambda x: x["name"]))
    artist = F.when(said, F.trim(F.regexp_extract(og, by, 2))).otherwise(first(lambda x: x["byArtist"]["name"]))
    secs = meta("music:duration")
    return F.when((N.blank(title) != "") & (N.blank(artist) != ""), F.struct(title.alias("title"), artist.alias("artist"), N.blank(meta("og:description")).alias("description"), F.when(secs.rlike("^[0-9]+$"), secs.cast("double")).alias("seconds"), meta("music:album").alias("album")))


def comparable(c: Column, length: int = 120) -> Column:
    """A text as it can be compared and read: a long one as a digest and its length."""
    return F.when(F.length(c) > length, F.concat(F.lit("sha256:"), F.substring(F.sha2(c.cast("binary"), 256), 1, 16), F.lit(" chars="), F.length(c).cast("string"))).otherwise(c)


def flattened(prefix: str, record: Column, length: int = 120) -> Column:
    """A map<string,string> with dotted names and comparable values."""
    return F.map_from_entries(F.transform(F.map_entries(record), lambda e: F.struct(F.concat(F.lit(f"{prefix}."), e["key"]), comparable(e["value"], length))))


def cleaned_tags(tags: Column, container: tuple[str, ...]) -> Column:
    """A remuxed file's tags without the container's own; a `txxx:comment` becomes the comment if there is none."""
    kept = F.map_filter(tags, lambda k, v: ~F.lower(F.element_at(F.split(k, ":"), -1)).isin(*container))
    promoted = F.map_filter(kept, lambda k, v: F.lower(k) == "txxx:comment")
    rest = F.map_filter(kept, lambda k, v: F.lower(k) != "txxx:comment")
    text = F.get(F.map_values(promoted), 0)
    return F.when(~F.map_contains_key(rest, "comment") & (N.blank(text) != ""), F.map_concat(rest, F.create_map(F.lit("comment"), text))).otherwise(rest)


def recorded_trim(tags: Column, name: str, missing: float | None) -> Column:
    """Seconds that an output's tags say were cut; `missing` where they don't say or say no number (a tag that says no number is null at the front)."""
    raw = F.try_element_at(tags, F.lit(name))
    return F.coalesce(raw.try_cast("double"), F.lit(missing).cast("double"))


#: Marks, brackets and words that an artist's name seldom holds; punctuation that it may.
QUOTES, BRACKETS = "\"'‘’“”„‟«»‹›`´", "()[]{}<>（）【】"
NAME_RULES = {
    "caps": "[A-ZČĆŽŠĐ]{3,}",
    "feat": r"(?i)(?<![a-z])(feat\.?|ft\.?|featuring|prati|gost(uje)?)(?![a-z])",
    "remix": r"(?i)(?<![a-z])(remix|rmx|bootleg|mashup|re-?edit|flip|vip mix)(?![a-z])",
}


def name_flags(c: Column) -> Column:
    """Rules that an artist's name breaks: quotes, brackets, runs of capitals (or all of it), features, remixes, two letters or fewer, odd symbols."""
    esc = lambda chars: "[" + "".join("\\" + x for x in chars) + "]"
    letters = F.regexp_replace(c, r"\P{L}", "")
    caps = c.rlike(NAME_RULES["caps"])
    odd = "[^\\p{L}\\p{N} .\\-'&,!$" + "".join("\\" + x for x in QUOTES + BRACKETS) + "]"
    rules = [("quotes", c.rlike(esc(QUOTES))), ("brackets", c.rlike(esc(BRACKETS))), ("caps_allcaps", caps & (letters == F.upper(letters))), ("caps_run", caps & (letters != F.upper(letters))), ("feat", c.rlike(NAME_RULES["feat"])), ("remix", c.rlike(NAME_RULES["remix"])), ("short", F.length(letters) <= 2), ("symbols", c.rlike(odd))]
    return F.array_compact(F.array(*[F.when(ok, name) for name, ok in rules]))


#: Spellings of one sound, in this order.
SOUNDS = (("x", "ks"), ("y", "j"), ("w", "v"), ("qu", "kv"), ("ck", "k"), ("ph", "f"), ("th", "t"), ("sh", "s"), ("tch", "c"), ("ch", "c"), ("dj", "d"), ("dz", "z"), ("ee", "i"), ("oo", "u"), ("c", "k"))


def plain_key(c: Column) -> Column:
    """A name without diacritics and digraphs, lower case."""
    c = F.replace(F.replace(F.lower(F.trim(N.blank(c))), F.lit("đ"), F.lit("dj")), F.lit("dž"), F.lit("dz"))
    return F.regexp_replace(N.unmarked(c), r"\s+", " ")


def sound_key(c: Column) -> Column:
    """plain_key() in which spellings of one sound are the same, repeated letters once."""
    return F.regexp_replace(reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), SOUNDS, plain_key(c)), r"(.)\1+", "$1")


def language(detected: Column, sure: Column, text: Column, heard: Column, heard_sure: Column, transcript: Column, confirmed: Column, words: int = 20) -> Column:
    """struct(language, confidence): detected on at least 60 characters of text without stamps and 0.9 sure, else heard in a confirmed transcript of at least `words` different words, else nulls."""
    plain = F.trim(F.regexp_replace(N.blank(text), r"\[[0-9:.]+\]|<[0-9:.]+>", ""))
    good = (F.length(plain) >= 60) & (sure >= 0.90)
    n = F.size(F.array_distinct(F.regexp_extract_all(F.lower(N.blank(transcript)), F.lit(r"[\p{L}\p{N}_]+"), 0)))
    ok = confirmed & (n >= words)
    return F.struct(F.when(good, detected).when(ok, heard).alias("language"), F.when(good, F.round(sure, 2)).when(ok, heard_sure).alias("confidence"))


#: The confidence from which an identity is written, and the verdict of lyrics that stands in for it.
TRUSTED, CONFIRMED = 0.90, "confirmed"


def identity_trusted(artist: Column, confidence: Column, verdict: Column, least: float = TRUSTED) -> Column:
    """struct(trusted, promoted): whether a proposed identity may be written, as somebody is named and the confidence suffices or its lyrics were confirmed, and whether only the lyrics let it through."""
    ok = F.coalesce(confidence >= least, F.lit(False))
    sung = F.coalesce(verdict == CONFIRMED, F.lit(False))
    named = F.coalesce(artist != "", F.lit(False))
    return F.struct((named & (ok | sung)).alias("trusted"), (named & ~ok & sung).alias("promoted"))
