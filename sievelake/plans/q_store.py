"""Queries on the evidence store beyond upsert and quorum: lookups, backfill, facts and their attempts, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import fields
from sievelake.functions import names as N
from sievelake.operators import evidence as E
from sievelake.operators import explain as X
from sievelake.operators import facts as K
from sievelake.operators import quorum as Q
from sievelake.plans.q_answers import _fit, _lowered
from sievelake.plans.q_evidence import AGREED, NOW, OBS, observations, with_family
from sievelake.plans.registry import query
from sievelake.plans.standin import chosen, chosen_sql, sql_text

STATES = list(E.STATES)
#: From the definition: 30 days, 7 days, 6 hours, 6 hours, 1 hour, 1 hour, else never.
TTL = {"NO_MATCH": 30 * 86400, "AMBIGUOUS": 7 * 86400, "SOURCE_CHANGED": 6 * 3600, "TEMPORARY_FAILURE": 6 * 3600, "AUTH_FAILURE": 3600, "RATE_LIMITED": 3600}
AGES = [0, 3599, 3600, 3601, 21599, 21600, 604799, 604800, 2591999, 2592000, 5000000]
_TTL = "CASE state " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TTL.items()) + " END"
AGED = f"aged AS (SELECT event_id, user_id AS entity, event_type AS field, 's' || (event_id % 6) AS source, CAST(event_id % 4 AS VARCHAR) AS query_key, {chosen_sql('event_id', STATES)} AS state, {chosen_sql('event_id // 8', AGES)} AS age FROM events)"


def _aged(events):
    secs = F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.element_at(F.array(*map(F.lit, AGES)), (F.floor(F.col("event_id") / 8) % len(AGES) + 1).cast("int"))
    return events.select("event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("field"), F.concat(F.lit("s"), F.col("event_id") % 6).alias("source"), (F.col("event_id") % 4).cast("string").alias("query_key"), chosen("event_id", STATES).alias("state"), F.timestamp_seconds(secs).alias("seen_at"))


@query("events", sql=f"WITH {AGED} SELECT event_id, state, {_TTL} IS NULL OR age < {_TTL} AS fresh FROM aged")
def ttl_all_states(events):
    """Freshness over all eight states, at and around every time to live."""
    return _aged(events).select("event_id", "state", E.fresh(F.lit(NOW).cast("timestamp")).alias("fresh"))


@query("events", sql=f"WITH {OBS} SELECT event_id, entity, field, family, source, state, value FROM obs WHERE entity = 7 AND state = 'FOUND' ORDER BY field, family, source, seen_at")
def observations_of(events):
    """The observations of one entity that were found, in their fixed order."""
    return E.observations(with_family(observations(events)).withColumn("first_seen", F.col("seen_at")), entity=7, state="FOUND").select("event_id", "entity", "field", "family", "source", "state", "value")


@query("events", "customer", sql=f"WITH {AGED} SELECT event_id, entity, field, source, query_key, state FROM aged WHERE ({_TTL} IS NULL OR age < {_TTL}) AND EXISTS (SELECT 1 FROM customer c WHERE c_custkey = entity AND c_nationkey % 2 = 0 AND field IN ('click', 'view') AND source = 's' || (c_custkey % 6) AND query_key = CAST(c_custkey % 4 AS VARCHAR))")
def asked_before(events, customer):
    """Answers to exactly these questions that may still be used."""
    q = customer.where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("entity"), F.explode(F.array(F.lit("click"), F.lit("view"))).alias("field"), F.concat(F.lit("s"), F.col("c_custkey") % 6).alias("source"), (F.col("c_custkey") % 4).cast("string").alias("query_key"))
    return E.asked(_aged(events), q, F.lit(NOW).cast("timestamp")).select("event_id", "entity", "field", "source", "query_key", "state")


LABELS = ["web:deezer+itunes", "confirmed", "acoustid", None, "pasted-link"]
_C = f"""o AS (SELECT o_orderkey AS entity, 'f' || o_orderkey AS file, 'A' || (o_custkey % 40) AS artist, CASE WHEN o_orderkey % 9 <> 0 THEN 'T' || (o_orderkey % 60) END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'Al' END AS album, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS year, {chosen_sql('o_orderkey', LABELS)} AS label FROM orders)"""


@query("orders", sql=f"""WITH {_C}, f AS (SELECT entity, unnest(['album', 'year']) AS field, unnest([album, year]) AS value, unnest([NULL, 'deezer']) AS source, artist, title FROM o WHERE entity % 2 = 0),
l AS (SELECT lower(artist || '|' || coalesce(title, '')) AS key, max(CASE WHEN entity % 3 <> 0 THEN '[00:01] x' END) AS synced, 'words' AS plain, CASE WHEN min(entity) % 4 = 0 THEN 'absent' ELSE 'ok' END AS status, CASE WHEN min(entity) % 5 = 0 THEN 'genius' END AS source FROM o GROUP BY 1),
j AS (SELECT entity, l.* FROM l JOIN o ON lower(artist || '|' || coalesce(title, '')) = key), q AS (SELECT *, 'webmatch:' || artist || '|' || coalesce(title, 'None') AS qk FROM o WHERE entity % 3 = 1),
s AS (SELECT *, unnest(CASE WHEN label IN ('confirmed', 'pasted-link') THEN ['human'] ELSE string_split(replace(label, 'web:', ''), '+') END) AS one FROM o WHERE label IS NOT NULL),
a AS (SELECT entity, field, coalesce(source, 'seed') AS source, 'backfill:cascade:' || artist || '|' || coalesce(title, 'None') AS query_key, 'FOUND' AS state, value FROM f WHERE value <> ''
UNION ALL SELECT entity, x.field, 'deezer', qk, 'FOUND', CASE x.field WHEN 'artist' THEN artist WHEN 'title' THEN title WHEN 'album' THEN album ELSE year END FROM q, (VALUES ('artist'), ('title'), ('album'), ('year')) AS x(field)
UNION ALL SELECT entity, 'artist', 'itunes', qk, 'TEMPORARY_FAILURE', NULL FROM q WHERE entity % 2 = 1
UNION ALL SELECT entity, x.field, coalesce(source, 'lrclib'), 'lyrics:' || key, CASE WHEN status = 'absent' THEN 'NO_MATCH' ELSE 'FOUND' END, CASE WHEN status <> 'absent' THEN CASE x.field WHEN 'lyrics_synced' THEN synced ELSE plain END END FROM j, (VALUES ('lyrics_synced'), ('lyrics_plain')) AS x(field)
UNION ALL SELECT entity, x.field, one, 'review:' || file, 'FOUND', CASE x.field WHEN 'artist' THEN artist WHEN 'title' THEN title WHEN 'album' THEN album ELSE year END FROM s, (VALUES ('artist'), ('title'), ('album'), ('year')) AS x(field))
SELECT * FROM a WHERE state <> 'FOUND' OR value IS NOT NULL""")
def store_backfill(orders):
    """Four caches turned into observations."""
    c = F.col
    o = orders.select(c("o_orderkey").alias("entity"), F.concat(F.lit("f"), c("o_orderkey")).alias("file"), F.concat(F.lit("A"), c("o_custkey") % 40).alias("artist"), F.when(c("o_orderkey") % 9 != 0, F.concat(F.lit("T"), c("o_orderkey") % 60)).alias("title"), F.when(c("o_orderkey") % 4 == 0, "Al").alias("album"), F.when(c("o_orderkey") % 5 != 0, F.year("o_orderdate").cast("string")).alias("year"), chosen("o_orderkey", LABELS).alias("source"))
    facts = o.where("entity % 2 = 0").select("entity", F.inline(F.array(F.struct(F.lit("album").alias("field"), c("album").alias("value"), F.lit(None).cast("string").alias("source")), F.struct(F.lit("year").alias("field"), c("year").alias("value"), F.lit("deezer").alias("source")))), "artist", "title")
    hits = o.where("entity % 3 = 1").withColumn("source", F.lit("deezer")).withColumn("q_artist", c("artist")).withColumn("q_title", c("title"))
    down = hits.where("entity % 2 = 1").withColumn("source", F.lit("itunes"))
    lyrics = o.groupBy(F.lower(F.concat("artist", F.lit("|"), F.coalesce("title", F.lit("")))).alias("key")).agg(F.max(F.when(c("entity") % 3 != 0, "[00:01] x")).alias("synced"), F.min("entity").alias("m")).select("key", "synced", F.lit("words").alias("plain"), F.when(c("m") % 4 == 0, "absent").otherwise("ok").alias("status"), F.when(c("m") % 5 == 0, "genius").alias("source"))
    return E.backfill(facts, hits, down, lyrics, o, fields.sources_of)


@query("part", sql="""WITH p AS (SELECT p_partkey AS entity, p_name AS stem, p_brand AS folder, CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ')[1] END AS fa, string_split(p_name, ' ')[2] AS ft, CASE WHEN p_size % 3 = 0 THEN p_type END AS ta, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS tt, CASE WHEN p_size % 7 = 0 THEN 'B' || p_size END AS band FROM part)
SELECT * FROM (SELECT entity, 'artist' AS field, 'filename' AS source, 'filename:' || stem AS query_key, 'FOUND' AS state, fa AS value FROM p UNION ALL SELECT entity, 'title', 'filename', 'filename:' || stem, 'FOUND', ft FROM p UNION ALL SELECT entity, 'artist', 'tags', 'tags:' || coalesce(ta, 'None') || '|' || coalesce(tt, 'None'), 'FOUND', ta FROM p
UNION ALL SELECT entity, 'title', 'tags', 'tags:' || coalesce(ta, 'None') || '|' || coalesce(tt, 'None'), 'FOUND', tt FROM p UNION ALL SELECT entity, 'artist', 'band', 'band:' || band, 'FOUND', band FROM p UNION ALL SELECT entity, 'collection', 'folder', 'folder:' || folder, 'FOUND', folder FROM p) WHERE value IS NOT NULL AND value <> ''""")
def local_observations(part):
    """What files say of themselves, as separate observations."""
    w = F.split("p_name", " ")
    return E.local_rows(part.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("stem"), F.col("p_brand").alias("folder"), F.when(F.col("p_size") % 2 == 0, F.get(w, 0)).alias("file_artist"), F.get(w, 1).alias("file_title"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("tag_artist"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("tag_title"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("B"), "p_size")).alias("band")))


OFFERERS = ["deezer", "musicbrainz", "seed", "lastfm", "coverartarchive"]
RESOLVERS = ["r_isrc", "r_search", None]
OFFERS = f"""offers AS (SELECT entity, field, row_number() OVER (PARTITION BY entity, field ORDER BY event_id) AS n, event_id AS seq, value, {chosen_sql('event_id', OFFERERS)} AS source, {chosen_sql('event_id', RESOLVERS)} AS resolver FROM obs WHERE value IS NOT NULL AND value <> ''),
tr AS (SELECT *, CASE source WHEN 'musicbrainz' THEN 3 WHEN 'coverartarchive' THEN 3 WHEN 'lastfm' THEN 0 ELSE 2 END AS t FROM offers),
att(entity, field, n, seq, value, source, resolver, ok, why, cv, cs, ct) AS (SELECT entity, field, n, seq, value, source, resolver, true, 'accepted', value, source, t FROM tr WHERE n = 1
 UNION ALL SELECT x.entity, x.field, x.n, x.seq, x.value, x.source, x.resolver, x.t > ct AND x.value <> cv, CASE WHEN x.value = cv THEN 'agrees' WHEN x.t <= ct THEN 'outranked by ' || cs ELSE 'accepted' END,
 CASE WHEN x.t > ct AND x.value <> cv THEN x.value ELSE cv END, CASE WHEN x.t > ct AND x.value <> cv THEN x.source ELSE cs END, CASE WHEN x.t > ct AND x.value <> cv THEN x.t ELSE ct END FROM att JOIN tr x ON x.entity = att.entity AND x.field = att.field AND x.n = att.n + 1)"""


def _tried(events):
    o = observations(events).select("entity", "field", F.col("event_id").alias("seq"), "value", chosen("event_id", OFFERERS).alias("source"), chosen("event_id", RESOLVERS).alias("resolver"))
    return K.attempts(o)


@query("events", sql=f"WITH RECURSIVE {OBS}, {OFFERS} SELECT entity, field, seq, value, source, resolver, ok AS accepted, why FROM att")
def fact_attempts(events):
    """Every offer of a fact, accepted or refused, and why."""
    return _tried(events)


@query("events", sql=f"WITH RECURSIVE {OBS}, {OFFERS}, h AS (SELECT * FROM att WHERE ok) SELECT entity, field, arg_max(value, seq) AS value, arg_max(source, seq) AS source FROM h GROUP BY 1, 2")
def facts_held(events):
    """The value each field ends up with."""
    return K.held(_tried(events))


@query("events", "customer", sql=f"""WITH RECURSIVE {OBS}, {OFFERS} SELECT entity, field, source, 'cascade:' || coalesce(resolver, '?') || ':' || coalesce(c_name, 'None') || '|' || coalesce(c_mktsegment, 'None') AS query_key, arg_max(value, seq) AS value, 'FOUND' AS state FROM att LEFT JOIN customer ON c_custkey = entity GROUP BY 1, 2, 3, 4""")
def attempts_recorded(events, customer):
    """Attempts as observations, keyed by resolver and identity."""
    return K.recorded(_tried(events), customer.select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("artist"), F.col("c_mktsegment").alias("title")))


@query("events", sql=f"""WITH {OBS}, b AS (SELECT field, count(DISTINCT entity) AS b FROM obs WHERE state = 'FOUND' AND event_id % 3 = 0 GROUP BY 1), a AS (SELECT field, count(DISTINCT entity) AS a FROM obs WHERE state = 'FOUND' GROUP BY 1)
SELECT coalesce(b.field, a.field) AS field, coalesce(b, 0) AS before, coalesce(a, 0) AS after, coalesce(a, 0) - coalesce(b, 0) AS gained FROM b FULL JOIN a ON a.field = b.field""")
def facts_gained(events):
    """How many entities gained each field between two states of the facts."""
    obs = observations(events).where("state = 'FOUND'")
    return K.gained(obs.where("event_id % 3 = 0"), obs)


_ALBUMS = ["Blue", "Blue Train", "", None, "Greatest Hits", "Plavi voz"]
_ACTS = ["Ana", "Ana Popović", "Balkanik", "Various", ""]


def _n(x):
    return _lowered(x)


@query("lineitem", sql=f"""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, {_n(chosen_sql('l_orderkey', _ACTS))} AS a, {chosen_sql('l_orderkey', _ALBUMS)} AS ours, {_n(chosen_sql('l_partkey', _ACTS))} AS ca, {_n(chosen_sql('l_partkey', _ALBUMS))} AS cb, {_n(chosen_sql('l_suppkey', _ALBUMS))} AS t, {_n(chosen_sql('l_linenumber', _ALBUMS))} AS ct FROM lineitem), e AS (SELECT *, {_n('ours')} AS b FROM d)
SELECT id, l_partkey, coalesce(ours, '') = '' OR {_fit('b', 'cb')} >= 0.6 AS cover, {_fit('a', 'ca')} >= 0.6 AND CASE WHEN coalesce(ours, '') = '' THEN {_fit('t', 'cb')} >= 0.6 OR {_fit('t', 'ct')} >= 0.6 ELSE {_fit('b', 'cb')} >= 0.6 END AS art FROM e""")
def artwork_gates(lineitem):
    """Which covers and artwork may be taken."""
    d = lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", chosen("l_orderkey", _ACTS).alias("a"), chosen("l_orderkey", _ALBUMS).alias("b"), chosen("l_partkey", _ACTS).alias("ca"), chosen("l_partkey", _ALBUMS).alias("cb"), chosen("l_suppkey", _ALBUMS).alias("t"), chosen("l_linenumber", _ALBUMS).alias("ct"))
    c = F.col
    return d.select("id", "l_partkey", K.cover_allowed(c("b"), c("cb")).alias("cover"), K.art_fits(c("a"), c("b"), c("t"), c("ca"), c("cb"), c("ct")).alias("art"))


@query("orders", "lineitem", sql=f"""WITH w AS (SELECT o_orderkey AS track, {_n(chosen_sql('o_orderkey', _ALBUMS))} AS b FROM orders), c AS (SELECT l_orderkey AS track, l_linenumber % 3 AS s, year(l_shipdate) AS year, {_n(chosen_sql('l_partkey', _ALBUMS))} AS cb FROM lineitem), ok AS (SELECT track, s, min(year) AS year FROM c JOIN w USING (track) WHERE {_fit('b', 'cb')} >= 0.6 GROUP BY 1, 2)
SELECT track, arg_min(year, s) AS year, ['mb', 'deezer', 'itunes'][CAST(min(s) AS INT) + 1] AS source FROM ok GROUP BY 1""")
def year_backfill(orders, lineitem):
    """A missing year from the first source whose album fits."""
    w = orders.select(F.col("o_orderkey").alias("track"), chosen("o_orderkey", _ALBUMS).alias("b"))
    c = lineitem.select(F.col("l_orderkey").alias("track"), (F.col("l_linenumber") % 3).alias("s"), F.year("l_shipdate").alias("year"), chosen("l_partkey", _ALBUMS).alias("cb")).join(w, "track").withColumn("ok", N.fit(F.col("b"), F.col("cb")) >= K.ALBUM_FIT)
    return K.first_of_sources([(n, c.where(F.col("s") == i).select("track", "year", "ok")) for i, n in enumerate(("mb", "deezer", "itunes"))], "track", "year")


@query("orders", sql="""WITH r AS (SELECT o_orderkey AS entity, o_orderstatus AS artist, CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS title FROM orders), c AS (SELECT entity, entity % 7 <> 0 AS stamped, CASE WHEN entity % 4 = 0 THEN 'X' ELSE artist END AS artist, CASE WHEN entity % 5 = 0 THEN NULL ELSE title END AS title FROM r WHERE entity % 6 <> 0)
SELECT r.* FROM r LEFT JOIN c USING (entity) WHERE c.stamped IS NULL OR (c.stamped AND (c.artist IS DISTINCT FROM r.artist OR c.title IS DISTINCT FROM r.title))""")
def stale_seeds(orders):
    """Work that is new, or whose cached result grew from another identity."""
    r = orders.select(F.col("o_orderkey").alias("entity"), F.col("o_orderstatus").alias("artist"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("title"))
    c = r.where("entity % 6 <> 0").select("entity", (F.col("entity") % 7 != 0).alias("stamped"), F.when(F.col("entity") % 4 == 0, "X").otherwise(F.col("artist")).alias("artist"), F.when(F.col("entity") % 5 != 0, F.col("title")).alias("title"))
    return K.stale(c, r, ["artist", "title"])


# ------------------------------------------------------------------ explanations


def _votes(events):
    from pyspark.sql import Window

    by = with_family(observations(events)).where("value IS NOT NULL AND value <> ''").groupBy("entity", "field", "value").agg(F.sort_array(F.collect_set("family")).alias("families"))
    human = F.array_contains("families", "human")
    w = Window.partitionBy("entity", "field").orderBy(human.desc(), F.size("families").desc(), F.desc("value"))
    return by.withColumns({"human": human, "rank": F.row_number().over(w)})


_FREE = "list_filter({0}, lambda x: x <> 'local')"
BEAT = f"""sec2 AS (SELECT entity, field, arg_min(value, r) AS value, arg_min({_FREE.format('fams')}, r) AS ff FROM rk WHERE r > 1 AND free > 0 GROUP BY 1, 2),
bt AS (SELECT w.entity, w.field, CASE WHEN s.value IS NULL THEN '' WHEN w.human THEN 'you settled it, over "' || s.value || '" from ' || array_to_string(s.ff, ', ') ELSE w.free || CASE WHEN w.free = 1 THEN ' family' ELSE ' families' END || CASE WHEN w.free > len(s.ff) THEN ' beat ' ELSE ' tied with, and sorted above ' END || len(s.ff) || ' for "' || s.value || '"' END AS beat FROM win w LEFT JOIN sec2 s USING (entity, field))"""


@query("events", sql=f"WITH {AGREED}, {BEAT} SELECT * FROM bt")
def what_it_beat(events):
    """What each winner beat, and how."""
    return X.beat(_votes(events))


@query("events", sql=f"""WITH {AGREED}, {BEAT}, q AS (SELECT entity, field, list_sort(list(DISTINCT source)) AS asked, list_sort(coalesce(list(DISTINCT source) FILTER (state = 'FOUND' AND value IS NOT NULL AND value <> ''), [])) AS found FROM obs WHERE field IN ('click', 'view') GROUP BY 1, 2),
p AS (SELECT entity, field, array_to_string(list_filter([CASE WHEN agree <> '' THEN replace(agree, ',', ', ') || ' agree' END, CASE WHEN dissent <> '' THEN replace(dissent, ',', ', ') || ' disagree' END, CASE WHEN len(list_filter(asked, lambda x: NOT list_contains(found, x))) > 0 THEN 'no answer from ' || array_to_string(list_filter(asked, lambda x: NOT list_contains(found, x)), ', ') END, nullif(beat, '')], lambda y: y IS NOT NULL), '; ') AS p
 FROM q LEFT JOIN agreed USING (entity, field) LEFT JOIN bt USING (entity, field)) SELECT entity, string_agg(field || ': ' || p, ' | ' ORDER BY field) AS why FROM p WHERE p <> '' GROUP BY 1""")
def why_review(events):
    """A sentence for each entity saying what was asked and answered."""
    obs = observations(events)
    a = Q.agreement(with_family(obs)).select("entity", "field", "agree", "dissent")
    s = Q.silent(obs).select("entity", "field", "silent")
    return X.why_review(s.join(a, ["entity", "field"], "left"), X.beat(_votes(events)), ("click", "view"))


_SRC, _FLD = ["tags", "band", "filename", "folder", "deezer"], ["artist", "title", "collection"]
SELF = f"""self AS (SELECT user_id AS entity, {chosen_sql('event_id', _SRC)} AS source, CASE WHEN {chosen_sql('event_id', _SRC)} = 'folder' THEN 'collection' ELSE {chosen_sql('event_id // 5', _FLD[:2])} END AS field, CASE WHEN event_id % 11 = 0 THEN 'NO_MATCH' ELSE 'FOUND' END AS state, 'Ž' || CAST(floor(value / 200) AS INT) || '!' AS value FROM events)"""


def _self(events):
    src = chosen("event_id", _SRC)
    two = F.element_at(F.array(*map(F.lit, _FLD[:2])), (F.floor(F.col("event_id") / 5) % 2 + 1).cast("int"))
    return events.select(F.col("user_id").alias("entity"), src.alias("source"), F.when(src == "folder", "collection").otherwise(two).alias("field"), F.when(F.col("event_id") % 11 == 0, "NO_MATCH").otherwise("FOUND").alias("state"), F.concat(F.lit("Ž"), F.floor(F.col("value") / 200).cast("string"), F.lit("!")).alias("value"))


@query("events", sql=f"""WITH {SELF}, g AS (SELECT entity, source, max(value) FILTER (field = 'artist') AS a, max(value) FILTER (field = 'title') AS t, max(value) FILTER (field = 'collection') AS c FROM self WHERE state = 'FOUND' AND source <> 'deezer' GROUP BY 1, 2)
SELECT entity, string_agg(source || ': ' || coalesce(c, coalesce(a, '(no artist)') || ' - ' || coalesce(t, '(no title)')), ' | ' ORDER BY list_position(['tags', 'band', 'filename', 'folder'], source)) AS claims FROM g GROUP BY 1""")
def local_claims(events):
    """What each file says of itself, source by source."""
    return X.local_claims(_self(events))


@query("events", sql=f"""WITH {SELF}, k AS (SELECT *, lower(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) AS s FROM self WHERE state = 'FOUND'), n AS (SELECT entity, field, arg_max(s, value) AS named FROM k WHERE source = 'filename' GROUP BY 1, 2), i AS (SELECT entity, field, list(DISTINCT s) AS inside FROM k WHERE source IN ('tags', 'band') GROUP BY 1, 2)
SELECT entity, field FROM n JOIN i USING (entity, field) WHERE NOT list_contains(inside, named)""")
def local_disagreement(events):
    """Where a file's name and its tags differ."""
    return X.local_disagreement(_self(events))


@query("events", sql=f"""WITH {OBS}, st AS (SELECT entity, field, string_agg(DISTINCT state, ', ' ORDER BY state) AS states FROM obs GROUP BY 1, 2), v AS (SELECT entity, field, value, list_sort(list(DISTINCT family)) AS f FROM obs WHERE state = 'FOUND' GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY len(f) DESC, value) AS n, count(*) OVER (PARTITION BY entity, field) AS c, bool_or(list_contains(f, 'human')) OVER (PARTITION BY entity, field) AS human, lead(value) OVER (PARTITION BY entity, field ORDER BY len(f) DESC, value) AS v2, len(lead(f) OVER (PARTITION BY entity, field ORDER BY len(f) DESC, value)) AS n2 FROM v),
l AS (SELECT entity, field, CASE WHEN n2 = len(f) THEN 'TIE, ' ELSE '' END || len(f) || CASE WHEN len(f) = 1 THEN ' family' ELSE ' families' END || ' on ''' || value || ''': ' || array_to_string(f, ', ') || CASE WHEN n2 = len(f) THEN '  vs ''' || v2 || '''' WHEN c > 1 THEN '  (' || (c - 1) || ' other value(s) disagree)' ELSE '' END || CASE WHEN human THEN '  [you answered this]' ELSE '' END AS line FROM r WHERE n = 1)
SELECT entity, field, coalesce(line, 'nothing answered (' || states || ')') AS verdict FROM st LEFT JOIN l USING (entity, field)""")
def verdicts(events):
    """One line for each entity and field: who is for what."""
    return X.verdict(with_family(observations(events)))


_WANTED = ["http://", "1", "en/2", "index", "nowhere at all"]


@query("pages", sql=f"""WITH p AS (SELECT DISTINCT url AS path, string_split(url, '/')[-1] AS base FROM pages WHERE url IS NOT NULL), w AS (SELECT unnest([{', '.join(map(sql_text, _WANTED))}]) AS wanted UNION SELECT min(path) FROM p UNION SELECT min(base) FROM p WHERE base <> ''), h AS (SELECT wanted, path, CASE WHEN path = wanted THEN 0 WHEN base = wanted THEN 1 ELSE 2 END AS how FROM p, w WHERE path = wanted OR base = wanted OR contains(lower(base), lower(wanted)))
SELECT wanted, path FROM (SELECT *, min(how) OVER (PARTITION BY wanted) AS least FROM h) WHERE how = least""")
def resolve_tracks(pages):
    """Texts somebody typed, each as the tracks it can mean."""
    p = pages.where("url IS NOT NULL").select(F.col("url").alias("path"))
    base = p.select(F.substring_index("path", "/", -1).alias("b")).where("b <> ''").agg(F.min("b").alias("wanted"))
    w = pages.sparkSession.createDataFrame([(x,) for x in _WANTED], "wanted string").unionByName(p.agg(F.min("path").alias("wanted"))).unionByName(base)
    return X.resolve(p, w.distinct())
