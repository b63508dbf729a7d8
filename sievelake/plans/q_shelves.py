"""Queries on shelves and reports: orders stand in for tracks, line items for tags and candidates, customers for artists."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import names as N
from sievelake.operators import shelves as S
from sievelake.plans.q_decide import _BAND
from sievelake.plans.q_names import FOLDED, _LATIN, _replaced
from sievelake.plans.registry import query
from sievelake.plans.standin import chosen, chosen_sql

_LANGS, _SCENES = ["hr", "en", "de", "ja", "", None, "sr", "th"], ["Ex-YU Rock", "Trap"]
_GEN = ["Ex-YU Rock", " Trap ", "Pop", None]
REGION = ("hr", "sr", "bs", "sl", "mk", "bg")
TR = f"""tr AS (SELECT o_orderkey AS path, o_totalprice / 1500 AS b, {chosen_sql('o_orderkey', _LANGS)} AS lang, CASE WHEN o_custkey % 29 = 0 THEN 'Croatia' WHEN o_custkey % 97 = 0 THEN 'Serbia' END AS origin, o_orderkey % 41 = 0 AS other, list_filter([{chosen_sql('o_custkey', _GEN)}, {chosen_sql('o_orderkey // 4', _GEN)}], lambda g: g IS NOT NULL) AS genres, (o_custkey % 12 + 1) || 'A' AS cam, CASE WHEN o_orderkey % 50 = 0 THEN 'low' END AS q, o_orderkey % 700 = 0 AS ao, CASE WHEN o_orderkey % 3 = 0 THEN 'v' END AS vid, (o_custkey % 20) / 10.0 AS dance, CAST(year(o_orderdate) AS VARCHAR) || '-01' AS y FROM orders)"""


@query("orders", sql=f"""WITH {TR}, c AS (SELECT path, unnest(list_filter(list_concat([CASE WHEN b IS NOT NULL THEN 'BPM/' || {_BAND} END, CASE WHEN reg THEN 'Language/Balkan' END, CASE WHEN reg THEN 'Language/' || origin WHEN lang <> '' THEN 'Language/' || lang END, 'Camelot/' || cam, CASE WHEN q = 'low' THEN 'Check quality' END, CASE WHEN ao THEN 'Needs identification' END, CASE WHEN vid <> '' THEN 'Has YouTube link' END, CASE WHEN dance >= 1.2 THEN 'Mood/danceable' END, 'Decade/' || (CAST(left(y, 4) AS INT) // 10 * 10) || 's'],
  list_transform(list_filter(genres, lambda g: trim(g) IN ('Ex-YU Rock', 'Trap')), lambda g: 'Genre/' || trim(g))), lambda z: z IS NOT NULL)) AS crate FROM (SELECT *, coalesce(origin IS NOT NULL OR lang IN ('hr', 'sr', 'bs', 'sl', 'mk', 'bg') OR other, false) AS reg FROM tr)),
n AS (SELECT crate, count(*) AS n FROM c GROUP BY 1), f AS (SELECT path, CASE WHEN crate LIKE 'Language/%' AND NOT ends_with(crate, 'Balkan') AND n < 5 THEN 'Language/Other' WHEN crate LIKE 'Language/%' OR n >= 15 THEN crate END AS crate FROM c JOIN n USING (crate)) SELECT crate, count(*) AS n, CAST(sum(path) AS BIGINT) AS paths FROM f WHERE crate IS NOT NULL GROUP BY 1""")
def crates_full(orders):
    """All crates, with origins over languages, small languages folded and tiny crates dropped."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    quarter = F.element_at(F.array(*[F.lit(x) for x in _GEN]), (F.floor(k / 4) % 4 + 1).cast("int"))
    t = orders.select(k.alias("path"), (F.col("o_totalprice") / 1500).alias("bpm"), chosen("o_orderkey", _LANGS).alias("language"), F.when(c % 29 == 0, "Croatia").when(c % 97 == 0, "Serbia").alias("origin"), (k % 41 == 0).alias("other_folder"), F.array_compact(F.array(chosen("o_custkey", _GEN), quarter)).alias("genres"), F.concat((c % 12 + 1).cast("string"), F.lit("A")).alias("camelot"), F.when(k % 50 == 0, "low").alias("quality"), (k % 700 == 0).alias("audio_only"), F.when(k % 3 == 0, "v").alias("video"), ((c % 20) / 10.0).alias("danceability"), F.concat(F.year("o_orderdate").cast("string"), F.lit("-01")).alias("year"))
    return S.crates(t, _SCENES, REGION).groupBy("crate").agg(F.count(F.lit(1)).alias("n"), F.sum("path").alias("paths"))


@query("orders", sql="""SELECT o_orderstatus AS sheet, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rank FROM orders""")
def sheet_numbers(orders):
    """Each sheet numbered from 1, worst first, without one task that holds a sheet."""
    d = orders.select(F.col("o_orderstatus").alias("sheet"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    return S.numbered(d, ["sheet"], [F.col("p"), F.col("id")]).select("sheet", "id", "rank")


@query("orders", sql="""SELECT o_orderkey AS path, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS BIGINT) AS batch FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 10 <> 0 AND o_orderkey % 3 <> 0""")
def submission_ledger(orders):
    """What is to be sent, in batches of fifty, less what was sent."""
    k = F.col("o_orderkey")
    rows = orders.select(k.alias("path"), F.when(F.col("o_orderstatus") != "P", "auto").otherwise("review").alias("tier"), F.when(F.col("o_custkey") % 10 != 0, "id").alias("id"))
    return S.unsent(rows, orders.where(k % 3 == 0).select(k.alias("path")))


_TIERS, _REASON = ["auto", "review", "suspect", "hinted"], ["clean match", "artist mismatch vs filename (similarity 0.20)", "no album", "title differs from filename"]


@query("orders", sql=f"""SELECT o_orderkey AS id, CASE WHEN {chosen_sql('o_orderkey', _TIERS)} = 'auto' THEN NULL WHEN o_custkey % 9 = 0 OR o_custkey % 7 = 0 THEN 'unknown' WHEN o_custkey % 4 IN (1, 3) OR o_orderkey % 5 = 0 THEN 'confirm' ELSE 'verify' END AS sheet FROM orders""")
def sheet_routing(orders):
    """The sheet that each row goes to by what its reasons say."""
    c = F.col("o_custkey")
    why = F.array(chosen("o_custkey", _REASON), F.when(F.col("o_orderkey") % 5 == 0, _REASON[1]).otherwise("x"))
    return orders.select(F.col("o_orderkey").alias("id"), S.sheet_of(chosen("o_orderkey", _TIERS), F.when(c % 9 != 0, "A"), F.when(c % 7 != 0, "T").otherwise(""), why).alias("sheet"))


_MEM = [("Ex-YU Rock", 0, "Prljavo Kazalište", None, None), ("Trash", 1, "PRLJAVO KAZALISTE", 1995, 2000), ("Trap", 2, "A$AP+", None, None), ("Eighties", 3, "Zed", 1980, 1996)]
_ART = ["prljavo kazaliste", "A$AP+", "Zed", "Nobody", None]
_MEMV = ", ".join(f"('{s}', {p}, '{k}', {a or 'NULL'}, {b or 'NULL'})" for (s, p, _, a, b), k in zip(_MEM, ["prljavo kazaliste", "prljavo kazaliste", "a$ap+", "zed"], strict=True))
SC = f"""sc AS (SELECT track, list(scene ORDER BY pos) AS scenes FROM (SELECT o_orderkey AS track, {chosen_sql('o_orderkey', ['prljavo kazaliste', 'a$ap+', 'zed', 'nobody', ''])} AS key, CASE WHEN o_custkey % 6 <> 0 THEN year(o_orderdate) END AS y FROM orders) t JOIN (VALUES {_MEMV}) AS m(scene, pos, key, a, b) USING (key) WHERE a IS NULL OR y IS NULL OR y BETWEEN a AND b GROUP BY 1)"""


def _scenes(orders):
    m = orders.sparkSession.createDataFrame(_MEM, "scene string, pos int, artist string, year_from int, year_to int")
    return S.scenes_of(orders.select(F.col("o_orderkey").alias("track"), chosen("o_orderkey", _ART).alias("artist"), F.when(F.col("o_custkey") % 6 != 0, F.year("o_orderdate")).alias("year")), m)


@query("orders", sql=f"WITH {SC} SELECT track, array_to_string(scenes, '|') AS scenes FROM sc")
def scene_membership(orders):
    """Every scene of a track's artist, with years where a scene has them."""
    return _scenes(orders).select("track", F.array_join("scenes", "|").alias("scenes"))


GENRES, MERGE, DROP, RULES = ("Pop", "Rock", "Hip-Hop", "Jazz", "Electronic"), {"rap hip hop": "Hip-Hop", "dzez": "Jazz"}, ("seen live", "balkan"), {r"\btrap\b|\brap\b": "Hip-Hop", r"house|techno": "Electronic"}
TABLE, JUNK = {r"(?i)^pop.*": "Pop", r"(?i)^(ex-?yu )?rock$": "Rock", r"(?i)^serbian rap$": "Hip-Hop"}, r"(?i)^(seen live|all|favorites?)$"
_NAMES = ["Pop Folk", "rock", "Seen Live", "Džez", "deep house", "serbian rap", "Balkan", "unknown thing", "Rap/Hip Hop", None]
_ALLOWED = [None, "Rock", None, "Jazz", "Electronic", "Hip-Hop", None, None, "Hip-Hop", None]
_FROM = ["Pop", "Rock", None, None, None, "Hip-Hop", None, None, None, None]
GL = f"""tg AS (SELECT l_orderkey AS track, l_linenumber % 2 AS lv, l_linenumber AS pos, CAST(l_partkey % 10 AS INT) AS n, CAST(l_quantity AS INT) * 2 AS w FROM lineitem), mx AS (SELECT track, lv, max(w) AS top FROM tg GROUP BY 1, 2),
fm AS (SELECT tg.track, tg.lv, arg_min({chosen_sql('n', _FROM)}, (pos * 100 + n) * 1000 + w) AS g FROM tg JOIN mx ON mx.track = tg.track AND mx.lv = tg.lv WHERE w >= greatest(10, 0.25 * top) AND {chosen_sql('n', _FROM)} IS NOT NULL AND n NOT IN (2, 9) GROUP BY 1, 2),
br AS (SELECT track, arg_min({chosen_sql('n', _ALLOWED)}, ((1 - lv) * 10 + pos) * 100000 + n * 1000 + w) AS g FROM tg WHERE w >= 50 AND n IN (1, 4) GROUP BY 1)"""


@query("orders", "lineitem", sql=f"""WITH {SC}, {GL}, o AS (SELECT o_orderkey AS track, o_custkey % 11 = 0 AS code, {chosen_sql('o_custkey', _ALLOWED)} AS shop, {chosen_sql('o_custkey // 10', _ALLOWED)} AS style FROM orders), j AS (SELECT o.*, sc.scenes[1] AS scene, a.g AS tt, b.g AS at_, br.g AS broad FROM o LEFT JOIN sc USING (track) LEFT JOIN fm a ON a.track = o.track AND a.lv = 0 LEFT JOIN fm b ON b.track = o.track AND b.lv = 1 LEFT JOIN br ON br.track = o.track)
SELECT track, CASE WHEN scene IS NOT NULL THEN scene WHEN code THEN shop ELSE coalesce(tt, at_, style, shop, broad) END AS genre, CASE WHEN scene IS NOT NULL THEN 'scene list' WHEN code THEN CASE WHEN shop IS NOT NULL THEN 'deezer' END WHEN tt IS NOT NULL THEN 'lastfm track' WHEN at_ IS NOT NULL THEN 'lastfm artist' WHEN style IS NOT NULL THEN 'discogs style' WHEN shop IS NOT NULL THEN 'deezer' WHEN broad IS NOT NULL THEN 'lastfm broad' END AS why FROM j""")
def genre_ladder_full(orders, lineitem):
    """A genre by the whole ladder, through the list of allowed genres."""
    c = F.col
    name = chosen("l_partkey", _NAMES)
    row = F.struct(c("l_linenumber").alias("pos"), (c("l_partkey") % 10).alias("n"), (c("l_quantity").cast("int") * 2).alias("weight"), name.alias("name"))
    t = lineitem.groupBy(c("l_orderkey").alias("track")).agg(F.array_sort(F.collect_list(F.when(c("l_linenumber") % 2 == 0, row))).alias("tt"), F.array_sort(F.collect_list(F.when(c("l_linenumber") % 2 == 1, row))).alias("at"))
    d = orders.select(c("o_orderkey").alias("track"), (c("o_custkey") % 11 == 0).alias("code"), chosen("o_custkey", _NAMES).alias("shop"), F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.floor(c("o_custkey") / 10) % 10 + 1).cast("int")).alias("style")).join(t, "track", "left").join(_scenes(orders), "track", "left")
    none = F.array().cast("array<struct<pos:int,n:bigint,weight:int,name:string>>")
    tt, at = F.coalesce("tt", none), F.coalesce("at", none)
    broad = F.get(F.filter(F.concat(at, tt), lambda x: (x["weight"] >= 50) & x["name"].isin("rock", "deep house")), 0)["name"]
    allow = lambda x: S.allowed(x, GENRES, MERGE, DROP, RULES)
    g = S.genre_of({"scene": F.get("scenes", 0), "code_only": c("code"), "track_tags": tt, "artist_tags": at, "styles": c("style"), "shop": c("shop"), "broad": broad}, allow, lambda x: S.from_tags(x, TABLE, JUNK), N.titlecase)
    return d.select("track", g.alias("g")).select("track", "g.genre", "g.why")


_CC, _LABEL = ["HR", "RS", "BA"], {"HR": "Croatia", "RS": "Serbia", "BA": "Bosnia"}


@query("lineitem", sql=f"""WITH t AS (SELECT l_suppkey AS artist, {chosen_sql('l_partkey', _CC)} AS c, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_quantity > 45), i AS (SELECT l_suppkey AS artist, {chosen_sql('l_orderkey', _CC)} AS c, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_suppkey % 4 <> 0 AND l_quantity < 5),
a AS (SELECT artist, arg_min(c, -n * 1e9 + o) AS c FROM (SELECT artist, c, count(*) AS n, min(o) AS o FROM t GROUP BY 1, 2) GROUP BY 1), b AS (SELECT artist, arg_min(c, -n * 1e9 + o) AS c FROM (SELECT artist, c, count(*) AS n, min(o) AS o FROM i GROUP BY 1, 2) GROUP BY 1)
SELECT coalesce(a.artist, b.artist) AS artist, coalesce(a.c, b.c) AS country, CASE coalesce(a.c, b.c) WHEN 'HR' THEN 'Croatia' WHEN 'RS' THEN 'Serbia' ELSE 'Bosnia' END AS label, CASE WHEN a.c IS NULL THEN 'isrc' WHEN b.c <> a.c THEN 'lastfm (isrc disagrees)' ELSE 'lastfm' END AS why FROM a FULL JOIN b ON a.artist = b.artist""")
def artist_origins(lineitem):
    """Where artists are from: by tags, else by recording codes, and whether these disagree."""
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    t = lineitem.where("l_suppkey % 3 <> 0 AND l_quantity > 45").select(F.col("l_suppkey").alias("artist"), chosen("l_partkey", _CC).alias("country"), seq.alias("pos"))
    i = lineitem.where("l_suppkey % 4 <> 0 AND l_quantity < 5").select(F.col("l_suppkey").alias("artist"), chosen("l_orderkey", _CC).alias("country"), seq.alias("seq"))
    return S.origins(t, i, _LABEL)


_SPELL = ["JOLE", "Jole", "jole", "Đole", "Ђоле", "Beyoncé", "Beyonce", "BEYONCE", "TTM", "Jole Official"]
CRED = f"raw AS (SELECT c_custkey AS id, {chosen_sql('c_custkey', _SPELL)} AS a, '' AS t FROM customer WHERE c_custkey % 13 <> 0 OR c_custkey % 10 <> 2)"


@query("customer", sql=f"""WITH {CRED}, {FOLDED}, k AS (SELECT a, CASE WHEN trim(regexp_replace(fa, '\\s*\\b({N.CHANNEL})\\b\\s*$', '', 'i')) = '' THEN fa ELSE trim(regexp_replace(fa, '\\s*\\b({N.CHANNEL})\\b\\s*$', '', 'i')) END AS key FROM raw2), n AS (SELECT key, a, count(*) AS n FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY regexp_matches(a, '[\\x{{0400}}-\\x{{04FF}}]'), len(regexp_replace(a, '\\PL', '', 'g')) >= 4 AND len(regexp_replace(a, '\\P{{Lu}}', '', 'g')) >= 0.8 * len(regexp_replace(a, '\\PL', '', 'g')), len(list_filter(string_split(a, ''), lambda x: strip_accents(x) <> x)) DESC, n DESC, len(a), a DESC) AS r, count(*) OVER (PARTITION BY key) AS m FROM n)
SELECT key, a AS spelling FROM r WHERE r = 1 AND m > 1""")
def preferred_spellings_full(customer):
    """The spelling of an artist to be kept, by all five criteria."""
    return S.preferred_spellings(customer.where("c_custkey % 13 <> 0 OR c_custkey % 10 <> 2").select(chosen("c_custkey", _SPELL).alias("artist")))


_IDS = ["m1", "m1", "m2", "m3", "m3", None]
_WHO = ["mgk; Camila Cabello", "Machine Gun Kelly", "Jole", "Thirty Zona", "30zona", "Zed"]
_MAP = [("mgk", "Machine Gun Kelly", "pinned"), ("30zona", "Thirty Zona", "musicbrainz"), ("jole", "Jole", "casing")]


@query("customer", sql="SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _MAP) + ") AS t(key, canonical, why) WHERE (SELECT count(*) FROM customer) > 100")
def alias_mapping(customer):
    """Aliases from shared ids, pinned rules and casing, followed to their end."""
    s = customer.sparkSession
    facts = customer.select(chosen("c_custkey", _IDS).alias("artist_id"), chosen("c_custkey", _WHO).alias("artist"), F.when(F.col("c_custkey") % 6 == 0, "mgk").when(F.col("c_custkey") % 6 == 3, "Thirty Zona").alias("canonical"))
    return S.alias_mapping(facts, s.createDataFrame([("mgk", "Machine Gun Kelly")], "key string, canonical string"), s.createDataFrame([("jole", "Jole"), ("mgk", "MGK")], "key string, spelling string"))


_SRC, _VT = ["file comment", "your link", "redownloaded audio", "deezer", "ytmusic"], ["Zora", "Zora (Live)", "Zora"]
LK = f"""t AS (SELECT o_orderkey AS track, {chosen_sql('o_orderkey', _VT)} AS title, CASE WHEN o_orderkey % 7 <> 0 THEN 200.0 + o_custkey % 50 END AS secs, o_orderkey % 31 = 0 AS refused, CASE WHEN o_orderkey % 37 = 0 THEN 'vc' END AS confirmed FROM orders),
c AS (SELECT l_orderkey AS track, 'v' || (l_partkey % 4) AS video, {chosen_sql('l_suppkey', _SRC)} AS source, CASE WHEN l_suppkey % 5 < 3 AND l_orderkey % 3 = 0 THEN 'origin' WHEN l_linenumber % 4 = 0 THEN 'exact' ELSE 'search' END AS tier, {chosen_sql('l_partkey', _VT)} AS ct, 200.0 + l_partkey % 60 AS dur, l_linenumber % 2 = 0 AS inh FROM lineitem),
o AS (SELECT track, arg_min(video, CAST(inh AS INT) * 1000 + list_position(['file comment', 'your link', 'redownloaded audio'], source) * 10 + CAST(video[2] AS INT)) AS origin FROM c WHERE tier = 'origin' GROUP BY 1),
v AS (SELECT track, video, count(DISTINCT source) AS n, list(struct_pack(s := source, tier := tier, ct := ct, dur := dur) ORDER BY source, tier, ct, dur)[1] AS f FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS n2 FROM v WINDOW w AS (PARTITION BY track ORDER BY n DESC, video)),
d AS (SELECT t.*, o.origin, r.video AS top, r.n, r.n2, r.f, CASE WHEN refused OR confirmed IS NOT NULL OR origin IS NOT NULL OR r.n IS NULL THEN NULL WHEN r.n <= r.n2 THEN 'sources disagree' WHEN r.n >= 2 OR r.f.tier = 'exact' THEN NULL WHEN contains(title, 'Live') <> contains(r.f.ct, 'Live') THEN 'version markers differ' WHEN secs IS NULL THEN 'lone search hit, nothing to check it against' WHEN abs(r.f.dur - secs) > 30 THEN 'search hit is too long or short' END AS reason FROM t LEFT JOIN o USING (track) LEFT JOIN r ON r.track = t.track AND r.k = 1)"""


@query("orders", "lineitem", sql=f"""WITH {LK}, x AS (SELECT *, CASE WHEN refused THEN NULL ELSE coalesce(confirmed, origin, CASE WHEN reason IS NULL THEN top END) END AS v FROM d) SELECT track, v AS video, CASE WHEN v IS NULL THEN NULL WHEN confirmed IS NOT NULL OR origin IS NOT NULL THEN 'origin' ELSE 'reference' END AS trust, reason FROM x""")
def link_decision_full(orders, lineitem):
    """Which video a track is linked to, how far it is trusted, or why it goes to review."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = orders.select(k.alias("track"), chosen("o_orderkey", _VT).alias("title"), F.when(k % 7 != 0, 200.0 + c % 50).alias("seconds"), (k % 31 == 0).alias("refused"), F.when(k % 37 == 0, "vc").alias("confirmed"))
    n = F.col("l_linenumber")
    tier = F.when((F.col("l_suppkey") % 5 < 3) & (F.col("l_orderkey") % 3 == 0), "origin").when(n % 4 == 0, "exact").otherwise("search")
    d = lineitem.select(F.col("l_orderkey").alias("track"), F.concat(F.lit("v"), F.col("l_partkey") % 4).alias("video"), chosen("l_suppkey", _SRC).alias("source"), tier.alias("tier"), chosen("l_partkey", _VT).alias("title"), (200.0 + F.col("l_partkey") % 60).alias("duration"), (n % 2 == 0).alias("inherited"))
    return S.link_decisions(t, d)


_PS = ["FOUND", "TEMPORARY_FAILURE", "RATE_LIMITED", "FOUND"]


@query("events", sql=f"""WITH p AS (SELECT 's' || (user_id % 12) AS source, {chosen_sql('event_id', _PS)} AS state, event_id, ts FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, state DESC) AS r FROM p), m AS (SELECT max(ts) AS now FROM events)
SELECT source, st AS state, coalesce(st = 'FOUND', false) AS usable, CASE WHEN st <> 'FOUND' THEN st || ': probe' END AS blocked FROM (SELECT source, CASE WHEN epoch_us(now) - epoch_us(ts) < 36000000000 THEN state END AS st FROM l, m WHERE r = 1)""")
def source_health(events):
    """Which sources may be asked now, and why not."""
    now = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    p = events.select(F.concat(F.lit("s"), F.col("user_id") % 12).alias("source"), chosen("event_id", _PS).alias("state"), F.lit("probe").alias("detail"), F.col("ts").cast("timestamp").alias("at"))
    return S.health(p, F.lit(now), 36000.0)


@query("documents", "labels", sql="""WITH d AS (SELECT d.*, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)) SELECT 'tracks' AS what, count(*) AS n FROM d UNION ALL SELECT 'identified', count(*) FILTER (lang IS NOT NULL) FROM d UNION ALL SELECT 'checked', count(*) FILTER (quality IS NOT NULL) FROM d UNION ALL SELECT 'long', count(*) FILTER (n_chars > 1000) FROM d""")
def sample_coverage(documents, labels):
    """What a sample covers."""
    q = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return S.coverage(documents.join(q, "doc_id", "left"), {"identified": F.col("lang").isNotNull(), "checked": F.col("quality").isNotNull(), "long": F.col("n_chars") > 1000})


@query("orders", sql="""WITH o AS (SELECT o_orderkey AS path, o_custkey AS song FROM orders), i AS (SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0) SELECT path, song FROM o WHERE path NOT IN (SELECT path FROM i) AND song IN (SELECT song FROM o WHERE path IN (SELECT path FROM i))""")
def outputs_pruned(orders):
    """Outputs that go, never the only copy of a song."""
    k = F.col("o_orderkey").alias("path")
    return S.pruned(orders.select(k, F.col("o_custkey").alias("song")), orders.where("o_orderkey % 3 = 0").select(k))


@query("orders", sql="""SELECT o_orderkey AS id, o_orderpriority AS why, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE '' END, ''), 'new') AS dossier, year(o_orderdate) AS year, o_orderstatus AS rest FROM orders""")
def sheet_upgrade(orders):
    """A sheet with columns put in after `why`; filled ones stay."""
    d = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("why"), F.col("o_orderstatus").alias("rest"), F.when(F.col("o_orderkey") % 2 == 0, "old").otherwise("").alias("dossier"), F.year("o_orderdate").alias("y"))
    return S.inserted_after(d, "why", {"dossier": F.lit("new"), "year": F.col("y")}).drop("y")


@query("part", sql="""WITH r AS (SELECT p_partkey AS path, p_name || p_size AS base, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS loud FROM part), s AS (SELECT p_name || p_size AS base, min(p_retailprice) / 2 AS loud, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT path, r.base, coalesce(r.loud, CASE WHEN s.n = 1 AND (SELECT count(*) FROM r q WHERE q.base = r.base) = 1 THEN s.loud END) AS loud FROM r LEFT JOIN s ON s.base = r.base""")
def loudness_seeded(part):
    """Missing measures seeded from an audit, unless the name is ambiguous."""
    r = part.select(F.col("p_partkey").alias("path"), F.concat("p_name", "p_size").alias("base"), F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).alias("loud"))
    return S.refreshed(r, part.where("p_size % 2 = 0").select(F.concat("p_name", "p_size").alias("base"), (F.col("p_retailprice") / 2).alias("loud")), "loud")


_TAGS = ["pop rock", "Seen Live", "love", "trap", "  ", "folk"]


@query("lineitem", sql=f"""WITH t AS (SELECT l_orderkey AS track, l_linenumber % 2 AS lv, l_linenumber AS pos, {chosen_sql('l_partkey', _TAGS)} AS name, CAST(l_quantity AS INT) AS w FROM lineitem), o AS (SELECT track, lv, (list(CASE name WHEN 'pop rock' THEN 'Pop Rock' WHEN 'trap' THEN 'Trap' ELSE 'Folk' END ORDER BY pos, name))[1:3] AS g FROM t WHERE w >= 10 AND name IN ('pop rock', 'trap', 'folk') GROUP BY 1, 2)
SELECT track, array_to_string(arg_min(g, lv), '|') AS genres FROM o GROUP BY 1""")
def community_genres(lineitem):
    """The first three tags that count, of the track or else of its artist."""
    t = lineitem.select(F.col("l_orderkey").alias("track"), (F.col("l_linenumber") % 2).alias("level"), F.col("l_linenumber").alias("pos"), chosen("l_partkey", _TAGS).alias("name"), F.col("l_quantity").cast("int").alias("weight"))
    return S.top_tags(t, ("seen live", "love")).select("track", F.array_join("genres", "|").alias("genres"))
