"""Queries on decisions: orders, line items and events stand in for measures, pages are pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import decisions as D
from sievelake.functions import names as N
from sievelake.plans.q_answers import _fit, _lowered
from sievelake.plans.registry import query
from sievelake.plans.standin import chosen, chosen_sql

_TEMPO = "t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, 50 + l_quantity * 2.3 AS r, CASE l_suppkey % 5 WHEN 0 THEN (50 + l_quantity * 2.3) / 2 WHEN 1 THEN (50 + l_quantity * 2.3) * 1.01 WHEN 2 THEN 0 WHEN 3 THEN (50 + l_quantity * 2.3) * 1.4 ELSE (50 + l_quantity * 2.3) * 4 END AS p, CASE WHEN l_linenumber % 3 = 0 THEN 15 ELSE (50 + l_quantity * 2.3) * (1 + l_discount / 2) END AS d FROM lineitem)"
_TO = "CASE WHEN NOT {b} > 0 THEN {b} WHEN {b} < r / 1.45 THEN {b} * pow(2, ceil(log2(r / 1.45 / {b}))) WHEN {b} > r * 1.45 THEN {b} / pow(2, ceil(log2({b} / (r * 1.45)))) ELSE {b} END"
_OCT = "round({0} * pow(2, greatest(0, ceil(log2(65.0 / ({0}))))), 1)"


@query("lineitem", sql=f"""WITH {_TEMPO}, f AS (SELECT *, list_transform(list_filter([r, d, p], lambda b: b > 20), lambda b: {_TO.format(b='b')}) AS fold FROM t), s AS (SELECT *, list_max(fold) / list_min(fold) AS spread, len(list_filter(fold, lambda x: abs(x / fold[1] - 1) < 0.04)) AS votes, CASE WHEN p > 0 THEN r / p ELSE 0 END AS ratio, list_min(list_filter([r, p, d], lambda b: b > 0)) AS low FROM f)
SELECT id, l_partkey, CAST(CASE WHEN spread < 1.04 THEN {_OCT.format('round(list_sum(fold) / len(fold), 1)')} WHEN ratio > 0.97 AND ratio < 1.03 THEN round((r + p) / 2, 1) WHEN (ratio > 1.94 AND ratio < 2.06) OR (ratio > 0.485 AND ratio < 0.515) THEN {_OCT.format('low')} ELSE round(r, 1) END AS DOUBLE) AS bpm,
CASE WHEN spread < 1.04 THEN CASE WHEN ratio > 0.97 AND ratio < 1.03 THEN 'agree' ELSE 'octave' END WHEN ratio > 0.97 AND ratio < 1.03 THEN 'agree' WHEN (ratio > 1.94 AND ratio < 2.06) OR (ratio > 0.485 AND ratio < 0.515) THEN 'octave' ELSE 'disagree' END AS verdict, CAST(votes AS INT) AS votes FROM s""")
def tempo_verdict(lineitem):
    """One tempo from three engines, folded into one octave, with verdict and votes."""
    r = 50 + F.col("l_quantity") * 2.3
    k = F.col("l_suppkey") % 5
    p = F.when(k == 0, r / 2).when(k == 1, r * 1.01).when(k == 2, 0.0).when(k == 3, r * 1.4).otherwise(r * 4)
    d = F.when(F.col("l_linenumber") % 3 == 0, 15.0).otherwise(r * (1 + F.col("l_discount") / 2))
    return lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", D.tempo(r, p, d).alias("t")).select("id", "l_partkey", "t.*")


_KEYS = ["C", "G", "Am"]


@query("orders", sql=f"""WITH k AS (SELECT o_orderkey AS id, [{{'key': {chosen_sql('o_orderkey', _KEYS)}, 'scale': 'major', 's': (o_custkey % 10) / 10.0}}, {{'key': {chosen_sql('o_custkey', _KEYS)}, 'scale': 'major', 's': (o_custkey % 7) / 10.0}}, {{'key': {chosen_sql('o_custkey // 3', _KEYS)}, 'scale': CASE WHEN o_orderkey % 2 = 0 THEN 'major' ELSE 'minor' END, 's': 0.55}}] AS reads FROM orders),
u AS (SELECT id, i, reads[i].key AS key, reads[i].scale AS scale, reads[i].s AS s FROM k, (VALUES (1), (2), (3)) AS x(i)), g AS (SELECT id, key, scale, count(*) AS n, min(i) AS i, max(s) AS s FROM u GROUP BY 1, 2, 3)
SELECT id, key, scale, n || '/3' AS agreement, CAST(s AS DOUBLE) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS r FROM g) WHERE r = 1""")
def key_votes(orders):
    """The key that most profiles name, how many do, and the strongest reading."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    third = F.element_at(F.array(*map(F.lit, _KEYS)), (F.floor(c / 3) % 3 + 1).cast("int"))
    row = lambda key, scale, s: F.struct(key.alias("key"), scale.alias("scale"), s.cast("double").alias("strength"))
    reads = F.array(row(chosen("o_orderkey", _KEYS), F.lit("major"), (c % 10) / 10.0), row(chosen("o_custkey", _KEYS), F.lit("major"), (c % 7) / 10.0), row(third, F.when(k % 2 == 0, "major").otherwise("minor"), F.lit(0.55)))
    return orders.select(k.alias("id"), D.key_vote(reads).alias("v")).select("id", "v.*")


_BAND = "CASE " + " ".join(f"WHEN b >= {lo} AND b < {hi} THEN '{n}'" for lo, hi, n in D.BANDS) + " END"


@query("orders", sql=f"""WITH x AS (SELECT o_orderkey AS id, o_totalprice / 100 AS b, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 1000 + 500 ELSE 0 END AS h, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS size, CASE WHEN o_orderkey % 7 <> 0 THEN 3.0 + o_custkey % 4 END AS secs FROM orders)
SELECT id, {_BAND} AS band, CAST(CASE WHEN h > 0 THEN round_even(h / 1000.0, 0) WHEN secs > 0 AND size IS NOT NULL THEN round_even(size * 8 / secs / 1000, 0) ELSE 1 END AS DOUBLE) AS kbps FROM x""")
def bands_and_bitrates(orders):
    """All eight tempo bands, and a bitrate from header, size or fallback."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rate = D.bitrate(F.when(k % 3 == 0, c * 1000.0 + 500.0).otherwise(0.0), F.when(k % 5 != 0, F.col("o_totalprice")), F.when(k % 7 != 0, 3.0 + c % 4), F.lit(1.0))
    return orders.select(k.alias("id"), D.band(F.col("o_totalprice") / 100).alias("band"), rate.alias("kbps"))


@query("embeddings", sql="""WITH f AS (SELECT vec_id, list_transform(range(1, 65), lambda i: greatest(abs(CAST(embedding[i] AS DOUBLE)) * pow(10, -(i * (1 + vec_id % 5)) / 16.0), CAST(i % 7 = 0 AS INT) * 0.0001)) AS m FROM embeddings), d AS (SELECT vec_id, m, list_max(m) AS top FROM f)
SELECT vec_id, CAST(round((list_max(list_filter(range(0, 64), lambda i: 20 * log10(greatest(m[i + 1], 1e-12) / top) > -50)) * 22050.0) / 63, 4) AS DOUBLE) AS hz FROM d""")
def spectral_cutoffs(embeddings):
    """The highest frequency with energy, over the maximum of two spectra."""
    v = F.col("vec_id")
    one = F.transform("embedding", lambda x, i: F.abs(x.cast("double")) * F.pow(F.lit(10.0), -((i + 1) * (1 + v % 5)) / 16.0))
    two = F.transform("embedding", lambda x, i: F.when((i + 1) % 7 == 0, 0.0001).otherwise(0.0))
    return embeddings.select("vec_id", F.round(D.spectral_cutoff(F.array(one, two)), 4).alias("hz"))


_RUNS = """e AS (SELECT l_orderkey AS track, l_linenumber - 1 AS n, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 3 = 0 THEN 5.0 ELSE 0.0 END ELSE l_linenumber * 40.0 END AS s, CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 4 THEN NULL ELSE CASE WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 3 = 0 THEN 6.0 ELSE (l_orderkey % 50) * 0.3 END ELSE l_linenumber * 40.0 + (l_orderkey % 30) * 0.2 END END AS e FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 5)),
r AS (SELECT track, list(struct_pack(s := s, e := e) ORDER BY n) AS runs, min(CASE WHEN n = 0 AND abs(s) <= 0.001 THEN coalesce(e, 30) END) AS lead FROM e GROUP BY 1), x AS (SELECT *, CASE WHEN track % 11 <> 0 THEN runs[-1].s + (track % 30) * 0.2 + (track % 2) * 3 END AS secs, CASE track % 5 WHEN 0 THEN true WHEN 1 THEN false END AS hint, CASE WHEN track % 4 <> 0 THEN -70.0 + track % 45 END AS floor_ FROM r),
y AS (SELECT *, list_filter(runs, lambda q: q.e IS NULL OR abs(q.e - secs) < 0.5) AS ends FROM x), z AS (SELECT track, coalesce(lead, 0) AS lead, CASE WHEN secs IS NULL OR secs = 0 THEN NULL WHEN len(ends) > 0 THEN greatest(0, secs - ends[1].s) ELSE 0 END AS tail, hint, floor_ FROM y)"""


@query("lineitem", sql=f"""WITH {_RUNS}, d AS (SELECT *, CASE WHEN lead <= 0 THEN 'no_leading_silence' WHEN hint = false THEN 'kept_by_you' WHEN lead < 0.2 THEN 'skip_short' WHEN lead > 10 AND hint IS NOT TRUE THEN 'review_long' ELSE 'trim' END AS decision,
CASE WHEN tail IS NULL THEN 'unmeasured' WHEN tail <= 0 THEN 'no_trailing_silence' WHEN hint = false THEN 'kept_by_you' WHEN tail - 0.5 < 0.5 THEN 'skip_short' ELSE 'trim' END AS tail_decision FROM z)
SELECT track, CAST(round(lead, 6) AS DOUBLE) AS lead, CAST(round(tail, 6) AS DOUBLE) AS tail, CAST(CASE WHEN floor_ <= -40 THEN least(-30, greatest(-50, floor_ + 6)) ELSE -50 END AS DOUBLE) AS threshold, decision, CAST(CASE WHEN decision = 'trim' THEN round(greatest(0, lead - 0.04), 3) ELSE 0 END AS DOUBLE) AS cut, tail_decision, CAST(CASE WHEN tail_decision = 'trim' THEN round(greatest(0, tail - 0.5), 3) ELSE 0 END AS DOUBLE) AS tail_cut FROM d""")
def silence_decisions(lineitem):
    """Silence at both ends from intervals, the threshold, and what is decided and cut."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    e = lineitem.where("l_linenumber < 5").select("l_orderkey", "l_linenumber").distinct()
    start = F.when(n == 1, F.when(k % 3 == 0, 5.0).otherwise(0.0)).otherwise(n * 40.0)
    end = F.when((k % 7 == 0) & (n == 4), None).when(n == 1, F.when(k % 3 == 0, 6.0).otherwise((k % 50) * 0.3)).otherwise(n * 40.0 + (k % 30) * 0.2)
    r = e.groupBy(k.alias("track")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), start.alias("start"), end.alias("end")))).alias("runs"))
    t = F.col("track")
    first = F.filter("runs", lambda x: x["n"] == 1)
    d = r.withColumns({"secs": F.when(t % 11 != 0, F.element_at("runs", -1)["start"] + (t % 30) * 0.2 + (t % 2) * 3), "hint": F.when(t % 5 == 0, True).when(t % 5 == 1, False), "floor": F.when(t % 4 != 0, -70.0 + t % 45)})
    lead = F.when(F.size(first) > 0, D.leading_silence(first)).otherwise(0.0)
    d = d.select("track", F.round(lead, 6).alias("lead"), F.round(D.trailing_silence(F.col("runs"), F.col("secs")), 6).alias("tail"), D.threshold(F.col("floor")).alias("threshold"), "hint")
    return d.withColumn("s", D.silence(F.col("lead"), F.col("tail"), F.col("hint"))).select("track", "lead", "tail", "threshold", "s.*")


_MATCH = ["Ana - Zora", "Zed - Noć", "nothing", None, "Ana Popović - Zora (Live) - take"]
_WA, _WT = ["Ana", "Balkanik", ""], ["Zora", "Noć", None]
_LY = f"""x AS (SELECT o_orderkey AS id, o_orderkey % 13 <> 0 AS offered, o_orderkey % 7 = 0 AS instrumental, o_custkey % 12 AS timed, o_custkey % 5 = 0 AS confirmed, {chosen_sql('o_orderkey', _MATCH)} AS matched, o_orderkey % 4 <> 0 AS has_text, {chosen_sql('o_custkey', _WA)} AS a, {chosen_sql('o_custkey // 3', _WT)} AS t, CASE WHEN o_orderkey % 6 = 0 THEN 0.3 WHEN o_orderkey % 6 = 1 THEN 0.7 END AS af FROM orders),
y AS (SELECT *, contains(coalesce(matched, ''), ' - ') AS named, {_lowered('a')} AS na, {_lowered('t')} AS nt, {_lowered("string_split(matched, ' - ')[1]")} AS ma, {_lowered("substr(matched, strpos(matched, ' - ') + 3)")} AS mt FROM x), z AS (SELECT *, CASE WHEN coalesce(a, '') <> '' THEN coalesce(CAST(af AS DOUBLE), {_fit('na', 'ma')}) END AS fa, CASE WHEN coalesce(t, '') <> '' THEN {_fit('nt', 'mt')} END AS ft FROM y),
w AS (SELECT *, CASE WHEN NOT offered THEN NULL WHEN instrumental AND timed < 8 THEN 'instrumental' WHEN NOT named THEN CASE WHEN has_text AND NOT confirmed THEN 'unverifiable_match' END WHEN fa < 0.5 THEN CASE WHEN NOT confirmed THEN 'wrong_artist' END WHEN ft < 0.5 THEN CASE WHEN NOT confirmed THEN 'wrong_title' END END AS why FROM z),
txt AS (SELECT *, CASE WHEN why IS NOT NULL THEN 0 WHEN NOT offered OR NOT named OR fa < 0.5 OR ft < 0.5 THEN 1 ELSE coalesce(least(fa, ft), 1) END AS score, CASE WHEN id % 9 <> 0 THEN 200.0 + id % 5 END AS md, 201.3 + (id % 3) * 0.4 AS secs, (id % 4) * 0.25 AS cutt FROM w), tm AS (SELECT *, CASE WHEN md IS NULL THEN NULL WHEN abs(secs - cutt - md) > 2 THEN 0 ELSE 1 - abs(secs - cutt - md) / 2 * 0.5 END AS timing FROM txt)"""


def _lyric(orders):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    third = F.element_at(F.array(*map(F.lit, _WT)), (F.floor(c / 3) % 3 + 1).cast("int"))
    text = D.lyric_text({"offered": k % 13 != 0, "instrumental": k % 7 == 0, "timed_lines": c % 12, "confirmed": c % 5 == 0, "matched": chosen("o_orderkey", _MATCH), "has_text": k % 4 != 0, "artist": chosen("o_custkey", _WA), "title": third, "artist_fit": F.when(k % 6 == 0, 0.3).when(k % 6 == 1, 0.7), "title_fit": F.lit(None).cast("double")})
    md, secs, cut = F.when(k % 9 != 0, 200.0 + k % 5), 201.3 + (k % 3) * 0.4, (k % 4) * 0.25
    return orders.select(k.alias("id"), text.alias("text"), D.lyric_timing(md, secs, cut).alias("timing"), md.alias("md"), secs.alias("secs"))


@query("orders", sql=f"WITH {_LY} SELECT id, CAST(round(score, 6) AS DOUBLE) AS score, why AS reason, CAST(round(timing, 6) AS DOUBLE) AS timing, CASE WHEN abs(secs - md) > 2 THEN NULL ELSE 'sheet' END AS kept FROM tm")
def lyric_scores(orders):
    """How far a sheet's words are this song's, how far its timings fit, and whether they are kept."""
    return _lyric(orders).select("id", F.round("text.score", 6).alias("score"), "text.reason", F.round("timing", 6).alias("timing"), D.keep_timings(F.lit("sheet"), F.col("md"), F.col("secs")).alias("kept"))


@query("orders", sql=f"""WITH {_LY}, q AS (SELECT *, (id % 5) * 2.0 AS tail_cut, CASE WHEN id % 10 <> 0 THEN 190.0 + id % 13 END AS last, (id % 3) * 6.0 AS head_cut, CASE WHEN id % 8 <> 0 THEN (id % 11) * 1.0 END AS first, CASE WHEN id % 4 <> 0 THEN (id % 6) * 0.5 END AS off FROM tm),
f AS (SELECT *, tail_cut <= 0 OR last IS NULL OR last < secs - tail_cut AS tf, head_cut <= 0 OR first IS NULL OR off IS NULL OR first + off >= head_cut AS hf, CASE WHEN timing < 0.5 THEN 'timings already dropped' WHEN score < 0.5 THEN 'sheet already refused' END AS other FROM q)
SELECT id, tf OR other IS NOT NULL AS tail_safe, CASE WHEN NOT tf THEN coalesce(other, 'sung inside the end') END AS tail_reason, hf OR other IS NOT NULL AS head_safe, CASE WHEN NOT hf THEN coalesce(other, 'sung inside the front') END AS head_reason FROM f""")
def cut_conflicts(orders):
    """Whether cutting either end takes something that is sung."""
    i = F.col("id")
    d = _lyric(orders)
    t = D.tail_safe((i % 5) * 2.0, F.col("secs"), F.when(i % 10 != 0, 190.0 + i % 13), F.col("timing"), F.col("text.score"))
    h = D.head_safe((i % 3) * 6.0, F.when(i % 8 != 0, (i % 11) * 1.0), F.when(i % 4 != 0, (i % 6) * 0.5), F.col("timing"), F.col("text.score"))
    return d.select("id", t["safe"].alias("tail_safe"), t["reason"].alias("tail_reason"), h["safe"].alias("head_safe"), h["reason"].alias("head_reason"))


_TOKENS = "string_split(lower(left(text, 40)), ' ')"


@query("documents", sql=f"""WITH d AS (SELECT doc_id, string_split(lower(left(text, 150)), ' ') AS w, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, w, (list_filter(list_filter(t, lambda x, i: list_position(t, x) = i), lambda x: len(x) >= 3))[1:4] AS a FROM d),
s AS (SELECT doc_id, list_transform(range(1, len(w) + 1), lambda i: len(list_filter(a, lambda t: list_contains(w[i:i + len(a) + 1], t))) / CAST(len(a) AS DOUBLE)) AS sc FROM e WHERE len(a) > 0)
SELECT doc_id, (list_min(list_filter(range(1, len(sc) + 1), lambda i: sc[i] >= list_max(sc) - 0.05)) - 1) * CAST(0.5 AS DOUBLE) AS start, round(list_max(sc), 6) AS score FROM s WHERE list_max(sc) > 0""")
def anchor_located(documents):
    """The earliest place among timed words that holds a line's words as well as the best place does."""
    d = documents.where("text IS NOT NULL")
    words = F.transform(F.split(F.lower(F.substring("text", 1, 150)), " "), lambda x, i: F.struct((i * 0.5).alias("time"), x.alias("token")))
    anchor = F.slice(F.filter(F.array_distinct(F.split(F.lower(F.substring("text", 1, 40)), " ")), lambda x: F.length(x) >= 3), 1, 4)
    return d.select("doc_id", D.located(words, anchor).alias("x")).where("x IS NOT NULL").select("doc_id", "x.start", F.round("x.score", 6).alias("score"))


@query("orders", sql="""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 11 AS anchors, o_custkey % 9 AS words, CASE WHEN o_orderkey % 6 <> 0 THEN (o_custkey % 40) * 0.7 END AS start, (o_orderkey % 10) / 10.0 AS score, (o_orderkey % 13) * 1.0 AS t, o_custkey % 4 <> 0 AS same FROM orders),
y AS (SELECT *, CASE WHEN anchors = 0 THEN 'no_anchor' WHEN words < 3 THEN 'nothing_transcribed' WHEN start IS NULL OR score < 0.5 THEN 'low_confidence' WHEN abs(start - t) > 10 THEN 'implausible' ELSE 'measured' END AS status FROM x) SELECT id, status, CAST(CASE WHEN status = 'measured' AND same THEN round(start - t, 2) END AS DOUBLE) AS "offset" FROM y""")
def lyric_alignment(orders):
    """Status of lyrics laid against a transcript, and the offset that counts."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(k.alias("id"), D.alignment(k % 11, c % 9, F.when(k % 6 != 0, (c % 40) * 0.7), (k % 10) / 10.0, (k % 13) * 1.0, c % 4 != 0).alias("x")).select("id", "x.*")


@query("conversations", sql="""WITH c AS (SELECT conv_id, list(struct_pack(ms := CASE WHEN turn % 5 <> 4 THEN turn * 61234 + conv_id END, t := left(coalesce(text, ''), 10)) ORDER BY turn) AS l FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2) GROUP BY 1), f AS (SELECT conv_id, list_filter(l, lambda x: x.ms IS NOT NULL AND trim(x.t) <> '') AS l FROM c)
SELECT conv_id, nullif(array_to_string(list_transform(l, lambda x: '[' || CASE WHEN x.ms // 10 // 6000 > 99 THEN CAST(x.ms // 10 // 6000 AS VARCHAR) ELSE lpad(CAST(x.ms // 10 // 6000 AS VARCHAR), 2, '0') END || ':' || lpad(CAST(x.ms // 10 % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(x.ms // 10 % 100 AS VARCHAR), 2, '0') || ']' || trim(x.t)), chr(10)), '') AS sheet FROM f""")
def sheets_from_milliseconds(conversations):
    """Timed text written from milliseconds."""
    c = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 5 != 4, F.col("turn") * 61234 + F.col("conv_id")).alias("ms"), F.substring(F.coalesce("text", F.lit("")), 1, 10).alias("text")))).alias("l"))
    return c.select("conv_id", D.from_milliseconds(F.col("l")).alias("sheet"))


@query("orders", sql="""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN 14000.0 + o_custkey % 70 * 100 END AS nc, 180.0 + o_orderkey % 30 AS ns, 15500.0 AS oc, CASE WHEN o_custkey % 19 <> 0 THEN 190.0 ELSE 0 END AS os, (o_custkey % 3) * 6.0 AS opening, o_orderkey % 10 = 0 AS requested, o_orderkey % 12 = 0 AS yours, o_orderkey % 7 = 0 AS missing, o_custkey % 5 = 0 AS occupied FROM orders),
y AS (SELECT *, CASE WHEN coalesce(nc, 0) = 0 THEN 'did not decode' WHEN NOT (requested OR yours) AND os > 0 AND ns > 0 AND least(abs(ns - os), CASE WHEN opening > 0 THEN abs(ns - (os - opening)) ELSE 1e9 END) > 8 THEN 'different length' WHEN missing AND occupied THEN 'a file is back already' WHEN NOT missing AND NOT (requested OR yours) AND nc < oc + 1200 THEN 'no gain' END AS reason FROM x)
SELECT id, CASE WHEN reason IS NULL THEN CASE WHEN missing THEN 'restored' ELSE 'kept' END WHEN reason = 'no gain' THEN 'not better' ELSE 'rejected' END AS status, reason FROM y""")
def replacement_modes(orders):
    """Whether a new copy replaces the old, with the modes that waive rules."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = D.replacement({"new_cutoff": F.when(k % 17 != 0, 14000.0 + c % 70 * 100), "new_seconds": 180.0 + k % 30, "old_cutoff": F.lit(15500.0), "old_seconds": F.when(c % 19 != 0, 190.0).otherwise(0.0), "opening": (c % 3) * 6.0, "requested": k % 10 == 0, "yours": k % 12 == 0, "missing": k % 7 == 0, "occupied": c % 5 == 0})
    return orders.select(k.alias("id"), r.alias("r")).select("id", "r.*")


@query("part", sql="""WITH x AS (SELECT p_partkey AS id, CAST(p_size * 20 AS INT) AS w, CAST(p_size * 20 + (p_partkey % 5) * 25 AS INT) AS h, p_partkey % 40 AS s FROM part) SELECT id, array_to_string(list_filter([CASE WHEN least(w, h) < 250 THEN 'small (' || w || 'x' || h || ')' END, CASE WHEN h > 0 AND abs(w / CAST(h AS DOUBLE) - 1) > 0.12 THEN 'not square (' || w || 'x' || h || ')' END, CASE WHEN s < 24 THEN 'near-flat colour (likely placeholder)' END], lambda y: y IS NOT NULL), '; ') AS problems FROM x""")
def artwork_problems(part):
    """What is structurally wrong with artwork."""
    w = (F.col("p_size") * 20).cast("int")
    h = (F.col("p_size") * 20 + (F.col("p_partkey") % 5) * 25).cast("int")
    return part.select(F.col("p_partkey").alias("id"), F.array_join(D.art_problems(w, h, F.col("p_partkey") % 40), "; ").alias("problems"))


_HEADS = ['<meta property="og:title" content="Zora by Ana | Site"><meta name="music:duration" content="200">', '<script type="application/ld+json">{"@type": "MusicRecording", "name": "Noc", "byArtist": {"name": "Iva"}}</script>', '<script type="application/ld+json">[{"@type": "WebSite", "name": "no"}, {"@type": "MusicGroup", "name": "More", "byArtist": {"name": "Zed"}}]</script><meta property="og:title" content="just a title">', '<meta property="og:title" content="nothing here">', '<script type="application/ld+json">not json</script><meta property="OG:TITLE" content="Sve by Svi"><meta property="og:description" content="d"><meta property="music:album" content="Al">', ""]
_PAGE = [("Zora", "Ana", "", 200.0, None), ("Noc", "Iva", "", None, None), ("More", "Zed", "", None, None), None, ("Sve", "Svi", "d", None, "Al"), None]
_SAYS = ", ".join(f"({i}, '{p[0]}', '{p[1]}', '{p[2]}', {p[3] or 'NULL'}, {repr(p[4]) if p[4] else 'NULL'})" for i, p in enumerate(_PAGE) if p)


@query("pages", sql=f"SELECT page_id, title, artist, description, CAST(seconds AS DOUBLE) AS seconds, album FROM pages JOIN (VALUES {_SAYS}) AS x(i, title, artist, description, seconds, album) ON page_id % 6 = i")
def page_metadata(pages):
    """What pages state of a song in Open Graph and schema.org; one of six heads is put before each page."""
    html = F.concat(chosen("page_id", _HEADS), F.regexp_replace(F.coalesce("html", F.lit("")), "(?i)<meta|ld[+]json", "<x"))
    return pages.select("page_id", D.page_metadata(html).alias("m")).where("m IS NOT NULL").select("page_id", "m.*")


@query("documents", sql="""SELECT doc_id, CASE WHEN len(text) > 120 THEN 'sha256:' || left(sha256(text), 16) || ' chars=' || len(text) ELSE text END AS text, CASE WHEN len(lang) > 120 THEN '' ELSE lang END AS lang FROM documents""")
def comparable_values(documents):
    """A record flattened to dotted names with long texts as digests."""
    m = D.flattened("doc", F.create_map(F.lit("text"), F.col("text"), F.lit("lang"), F.col("lang")))
    return documents.select("doc_id", m["doc.text"].alias("text"), m["doc.lang"].alias("lang"))


@query("part", sql="""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 4 = 0 THEN p_type END AS comment, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0 END AS trim_front, CASE WHEN p_size % 5 = 0 THEN p_size / 10.0 ELSE 0 END AS trim_end FROM part""")
def written_tags(part):
    """Tags of remuxed files cleaned, and what they record of earlier cuts."""
    e = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    s = F.col("p_size")
    tags = F.map_from_entries(F.filter(F.array(e("title", F.col("p_name")), e("TXXX:major_brand", F.lit("isom")), e("comment", F.when(s % 3 == 0, F.col("p_brand"))), e("TXXX:comment", F.when(s % 4 == 0, F.col("p_type"))), e("trim", F.when(s % 2 == 0, s / 10.0).cast("string")), e("tail", F.when(s % 5 == 0, s / 10.0).cast("string"))), lambda x: x["v"].isNotNull()))
    d = part.select("p_partkey", D.cleaned_tags(tags, ("major_brand", "encoder")).alias("t"))
    return d.select(F.col("p_partkey").alias("id"), F.try_element_at("t", F.lit("comment")).alias("comment"), F.try_element_at("t", F.lit("title")).alias("title"), D.recorded_trim(F.col("t"), "trim", None).alias("trim_front"), D.recorded_trim(F.col("t"), "tail", 0.0).alias("trim_end"))


_AUDIT = ["Ana", "MC YANKOO", "TTM", "DJ BUKA Lomi", "Ana (HR)", 'Đole "x"', "Iva ft. Ana", "Zed remix", "X", "Ana_Iva", "Anna-Marie & Co."]
_FLAGS = ["", "caps_allcaps", "caps_allcaps", "caps_run", "brackets", "quotes", "feat", "remix", "short", "symbols", ""]


@query("customer", sql=f"SELECT c_custkey AS id, {chosen_sql('c_custkey', _FLAGS)} AS flags FROM customer")
def name_audit(customer):
    """Rules that artists' names break."""
    return customer.select(F.col("c_custkey").alias("id"), F.array_join(D.name_flags(chosen("c_custkey", _AUDIT)), ",").alias("flags"))


_SAME = ["Đorđe", "Djordje", "Dorde", "Kawasaki", "Kavasaki", "Komplexi", "Kompleksi", "Anna", "Ana", "Čola"]
_PLAIN = ["djordje", "djordje", "dorde", "kawasaki", "kavasaki", "komplexi", "kompleksi", "anna", "ana", "cola"]


@query("customer", sql=f"""WITH n AS (SELECT DISTINCT {chosen_sql('c_custkey', _SAME)} AS name, {chosen_sql('c_custkey', _PLAIN)} AS plain FROM customer), g AS (SELECT plain AS key, string_agg(name, ' | ' ORDER BY name) AS members, count(*) AS n FROM n GROUP BY 1) SELECT 'diacritics' AS rule, key, members FROM g WHERE n > 1
UNION ALL SELECT * FROM (VALUES ('translit', 'kavasaki', 'Kavasaki | Kawasaki'), ('translit', 'kompleksi', 'Kompleksi | Komplexi'), ('translit', 'ana', 'Ana | Anna'), ('translit', 'dorde', 'Djordje | Dorde | Đorđe')) AS t WHERE (SELECT count(*) FROM n) = {len(_SAME)}""")
def name_collisions(customer):
    """Names that differ in diacritics or in the spelling of a sound only."""
    n = customer.select(chosen("c_custkey", _SAME).alias("name")).distinct().select("name", D.plain_key(F.col("name")).alias("plain"), D.sound_key(F.col("name")).alias("sound"))
    g = lambda rule, key: n.groupBy(F.lit(rule).alias("rule"), F.col(key).alias("key")).agg(F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("members"), F.count(F.lit(1)).alias("n"), F.countDistinct("plain").alias("p"))
    return g("diacritics", "plain").where("n > 1").unionByName(g("translit", "sound").where("n > 1 AND p > 1")).select("rule", "key", "members")


@query("documents", sql="""WITH x AS (SELECT doc_id, lang, 0.85 + (doc_id % 4) * 0.05 AS sure, text, doc_id % 3 = 0 AS confirmed FROM documents), y AS (SELECT *, len(trim(regexp_replace(coalesce(left(text, 40 + CAST(doc_id % 60 AS INT)), ''), '\\[[0-9:.]+\\]|<[0-9:.]+>', '', 'g'))) >= 60 AND sure >= 0.899 AS good, confirmed AND len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]+'))) >= 20 AS ok FROM x)
SELECT doc_id, CASE WHEN good THEN lang WHEN ok THEN 'xx' END AS language, CAST(CASE WHEN good THEN round(sure, 2) WHEN ok THEN 0.5 END AS DOUBLE) AS confidence FROM y""")
def language_resolved(documents):
    """The language of lyrics: detected on enough text, else heard in a confirmed transcript."""
    sure = F.lit(0.85) + (F.col("doc_id") % 4) * 0.05
    d = D.language(F.col("lang"), sure + 0.001, F.expr("substring(text, 1, cast(40 + doc_id % 60 as int))"), F.lit("xx"), F.lit(0.5), F.col("text"), F.col("doc_id") % 3 == 0)
    return documents.select("doc_id", d.alias("x")).select("doc_id", "x.language", F.round("x.confidence", 2).alias("confidence"))
