"""Queries on observations: events stand in for what sources answered."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import evidence as E
from sievelake.operators import quorum as Q
from sievelake.plans.registry import query

FAMILY = {"s0": "catalogue", "s1": "catalogue", "s2": "shop", "s3": "local", "s4": "human"}
NOW = "2024-02-01 00:00:00"

OBS = """obs AS (SELECT event_id, user_id AS entity, event_type AS field, 's' || (event_id % 6) AS source, CAST(event_id % 4 AS VARCHAR) AS query_key,
  CASE event_id % 8 WHEN 5 THEN 'NO_MATCH' WHEN 6 THEN 'RATE_LIMITED' WHEN 7 THEN 'TEMPORARY_FAILURE' ELSE 'FOUND' END AS state,
  CASE WHEN event_id % 8 < 5 THEN CAST(CAST(floor(value / 50) AS INT) AS VARCHAR) END AS value, ts AS seen_at,
  CASE 's' || (event_id % 6) WHEN 's0' THEN 'catalogue' WHEN 's1' THEN 'catalogue' WHEN 's2' THEN 'shop' WHEN 's3' THEN 'local' WHEN 's4' THEN 'human' ELSE 's' || (event_id % 6) END AS family FROM events)"""


def observations(events):
    r = F.col("event_id") % 8
    state = F.when(r == 5, "NO_MATCH").when(r == 6, "RATE_LIMITED").when(r == 7, "TEMPORARY_FAILURE").otherwise("FOUND")
    return events.select("event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("field"), F.concat(F.lit("s"), F.col("event_id") % 6).alias("source"), (F.col("event_id") % 4).cast("string").alias("query_key"), state.alias("state"), F.when(r < 5, F.floor(F.col("value") / 50).cast("int").cast("string")).alias("value"), F.col("ts").alias("seen_at"))


def with_family(obs):
    dim = obs.sparkSession.createDataFrame(list(FAMILY.items()), "source string, family string")
    return Q.families(obs, dim)


AGREED = f"""{OBS}, bv AS (SELECT entity, field, value, list_sort(list(DISTINCT family)) AS fams FROM obs WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2, 3),
rk AS (SELECT *, list_contains(fams, 'human') AS human, len(fams) AS n, len(list_filter(fams, lambda x: x <> 'local')) AS free,
  row_number() OVER (PARTITION BY entity, field ORDER BY list_contains(fams, 'human') DESC, len(fams) DESC, value DESC) AS r FROM bv),
win AS (SELECT * FROM rk WHERE r = 1),
oth AS (SELECT w.entity, w.field, string_agg(DISTINCT f.f, ',' ORDER BY f.f) AS dissent FROM win w JOIN (SELECT entity, field, r, unnest(fams) AS f FROM rk WHERE r > 1) f USING (entity, field) WHERE f.f <> 'local' AND NOT list_contains(w.fams, f.f) GROUP BY 1, 2),
sec AS (SELECT entity, field, arg_min(value, r) AS value, arg_min(free, r) AS free FROM rk WHERE r > 1 AND free > 0 GROUP BY 1, 2),
agreed AS (SELECT w.entity, w.field, w.value, CAST(w.n AS BIGINT) AS n_families, array_to_string(w.fams, ',') AS agree, coalesce(o.dissent, '') AS dissent, s.value AS runner_up, CAST(w.free - coalesce(s.free, 0) AS BIGINT) AS margin, w.human
  FROM win w LEFT JOIN oth o USING (entity, field) LEFT JOIN sec s ON s.entity = w.entity AND s.field = w.field)"""


@query("events", sql=f"WITH {AGREED} SELECT * FROM agreed")
def quorum_agreement(events):
    return Q.agreement(with_family(observations(events)))


@query("events", sql=f"""WITH {AGREED}, prop AS (SELECT entity, field, max(value) AS value, 0.9 AS confidence FROM obs WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT p.entity, p.field, p.value, coalesce(a.dissent <> '' AND NOT a.human AND p.field IN ('click', 'view') AND p.value = a.value, false) AS contested,
  CAST(round(p.confidence * CASE WHEN a.dissent <> '' AND NOT a.human AND p.field IN ('click', 'view') AND p.value = a.value THEN 0.8 ELSE 1.0 END, 6) AS DOUBLE) AS confidence FROM prop p LEFT JOIN agreed a USING (entity, field)""")
def contested_penalty(events):
    obs = observations(events)
    prop = obs.where("value IS NOT NULL").groupBy("entity", "field").agg(F.max("value").alias("value")).withColumn("confidence", F.lit(0.9))
    return Q.penalty(Q.agreement(with_family(obs)), prop, ["click", "view"])


@query("events", sql=f"""WITH {OBS}, a AS (SELECT entity, field, list_sort(list(DISTINCT source)) AS asked, list_sort(coalesce(list(DISTINCT source) FILTER (state = 'FOUND' AND value IS NOT NULL AND value <> ''), [])) AS found FROM obs GROUP BY 1, 2)
SELECT entity, field, array_to_string(asked, ',') AS asked, array_to_string(found, ',') AS found, array_to_string(list_filter(asked, lambda x: NOT list_contains(found, x)), ',') AS silent FROM a""")
def silent_sources(events):
    return Q.silent(observations(events))


@query("events", sql=f"""WITH {OBS}, m AS (SELECT max(event_id) // 2 AS h FROM events),
o AS (SELECT obs.*, event_id <= h AS old FROM obs, m WHERE state <> 'FOUND' OR (value IS NOT NULL AND value <> '')),
l AS (SELECT *, row_number() OVER (PARTITION BY entity, field, source, query_key, old ORDER BY seen_at DESC, event_id DESC) AS r FROM o),
s AS (SELECT * FROM l WHERE old AND r = 1), b AS (SELECT * FROM l WHERE NOT old AND r = 1)
SELECT coalesce(b.entity, s.entity) AS entity, coalesce(b.field, s.field) AS field, coalesce(b.source, s.source) AS source, coalesce(b.query_key, s.query_key) AS query_key,
  CASE WHEN b.entity IS NOT NULL THEN b.state ELSE s.state END AS state, CASE WHEN b.entity IS NOT NULL THEN b.value ELSE s.value END AS value,
  CASE WHEN b.entity IS NULL THEN s.seen_at WHEN s.entity IS NOT NULL AND s.value IS NOT DISTINCT FROM b.value THEN s.seen_at ELSE b.seen_at END AS first_seen, coalesce(b.seen_at, s.seen_at) AS seen_at
FROM s FULL OUTER JOIN b ON s.entity = b.entity AND s.field = b.field AND s.source = b.source AND s.query_key = b.query_key""")
def evidence_upsert_latest(events):
    """The older half of the events is the store, the newer half the batch."""
    half = events.agg(F.expr("max(event_id) div 2").alias("h"))
    obs = E.valid(observations(events)).crossJoin(F.broadcast(half))
    order = [F.col("seen_at"), F.col("event_id")]
    old = E.latest(obs.where("event_id <= h"), order).withColumn("first_seen", F.col("seen_at"))
    return E.upsert(old, E.latest(obs.where("event_id > h"), order))


@query("events", sql=f"""WITH {OBS} SELECT event_id, state, (state IN ('FOUND') OR epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', seen_at)) < CASE state WHEN 'NO_MATCH' THEN 2592000 WHEN 'TEMPORARY_FAILURE' THEN 21600 ELSE 3600 END) AS fresh FROM obs""")
def evidence_ttl_fresh(events):
    return observations(events).select("event_id", "state", E.fresh(F.lit(NOW).cast("timestamp")).alias("fresh"))


@query("events", sql=f"""WITH {OBS} SELECT field, state, count(*) AS n, count(DISTINCT entity) AS entities, count(DISTINCT source) AS sources, min(seen_at) AS first_at, max(seen_at) AS last_at FROM obs GROUP BY 1, 2""")
def evidence_stats(events):
    return observations(events).groupBy("field", "state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.countDistinct("source").alias("sources"), F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"))


@query("events", sql=f"""WITH {OBS}, t AS (SELECT *, CASE source WHEN 's0' THEN 3 WHEN 's1' THEN 2 WHEN 's2' THEN 1 WHEN 's4' THEN 4 ELSE 2 END AS trust FROM obs WHERE value IS NOT NULL)
SELECT entity, field, value, source, CAST(trust AS BIGINT) AS trust FROM (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY trust DESC, seen_at, event_id) AS r FROM t) WHERE r = 1""")
def trust_lattice(events):
    """A fact is held by the source of highest trust, among equals by the first to arrive."""
    trust = F.when(F.col("source") == "s0", 3).when(F.col("source") == "s2", 1).when(F.col("source") == "s4", 4).otherwise(2)
    obs = observations(events).where("value IS NOT NULL").withColumn("trust", trust)
    best = obs.groupBy("entity", "field").agg(F.min_by(F.struct("value", "source", "trust"), F.struct(-F.col("trust"), "seen_at", "event_id")).alias("x"))
    return best.select("entity", "field", "x.value", "x.source", F.col("x.trust").cast("long").alias("trust"))


@query("conversations", sql="""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN left(text, 12) END AS hint FROM conversations),
k AS (SELECT conv_id, arg_min(hint, turn) AS known FROM c WHERE hint IS NOT NULL AND hint <> '' GROUP BY 1)
SELECT c.conv_id, c.turn, coalesce(nullif(c.hint, ''), k.known) AS hint FROM c LEFT JOIN k USING (conv_id)""")
def hint_backfill(conversations):
    c = conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.substring("text", 1, 12)).alias("hint"))
    return E.first_known(c, "conv_id", "turn", "hint").select("conv_id", "turn", "hint")


@query("documents", sql="SELECT md5(text) AS filekey, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY 1")
def collapse_copies(documents):
    d = documents.select(F.md5(F.col("text").cast("binary")).alias("filekey"), "doc_id", "source")
    return E.collapse(d, "filekey", [F.col("doc_id")])


@query("pages", sql="""WITH p AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages WHERE url IS NOT NULL), x(old, new) AS (VALUES ('http://tiontion.example.net', '/a'), ('http://tiontion.example.net/en', '/b'), ('https://tiontion.example.net', '/a')),
h AS (SELECT path, arg_max(old, length(old)) AS old, arg_max(new, length(old)) AS new FROM p LEFT JOIN x ON path = old OR starts_with(path, old || '/') GROUP BY 1),
m AS (SELECT path, CASE WHEN old IS NULL THEN path ELSE new || substring(path, length(old) + 1) END AS new_path FROM h)
SELECT path, new_path, count(*) OVER (PARTITION BY new_path) > 1 AS clash FROM m""")
def relocation_plan(pages):
    moves = pages.sparkSession.createDataFrame([("http://tiontion.example.net", "/a"), ("http://tiontion.example.net/en", "/b"), ("https://tiontion.example.net", "/a")], "old string, new string")
    return E.relocation(pages.where("url IS NOT NULL").select(F.regexp_replace("url", "[?#].*$", "").alias("path")).distinct(), moves)


@query("orders", "lineitem", sql="""SELECT o_orderkey AS path, o_orderstatus AS status FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') OR o_orderstatus = 'P'""")
def worklist_antijoin(orders, lineitem):
    """What isn't cached yet, and what is due again."""
    o = orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("status"))
    done = lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path")).distinct()
    return o.where("status <> 'P' OR status IS NULL").join(done, "path", "left_anti").unionByName(o.where("status = 'P'"))


@query("part", "lineitem", sql="""WITH w AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN CAST(l_partkey AS VARCHAR) WHEN l_linenumber = 2 THEN 'x' || l_partkey END AS entry FROM lineitem WHERE l_quantity > 49),
k AS (SELECT CAST(p_partkey AS VARCHAR) AS entry FROM part) SELECT entry, entry IN (SELECT entry FROM k) AS resolved FROM w WHERE entry IS NOT NULL""")
def restrict_list_semi(part, lineitem):
    """A list of wanted keys against the keys known: which resolve."""
    n = F.col("l_linenumber")
    entry = F.when(n == 1, F.col("l_partkey").cast("string")).when(n == 2, F.concat(F.lit("x"), "l_partkey"))
    wanted = lineitem.where("l_quantity > 49").select(entry.alias("entry")).where("entry IS NOT NULL").distinct()
    known = part.select(F.col("p_partkey").cast("string").alias("entry")).distinct()
    return wanted.join(known, "entry", "left_semi").withColumn("resolved", F.lit(True)).unionByName(wanted.join(known, "entry", "left_anti").withColumn("resolved", F.lit(False)))
