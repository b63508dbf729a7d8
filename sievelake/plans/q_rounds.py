"""Queries on enrichment in rounds, on the bucketed store, and on what may be written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievelake.functions import decisions as D
from sievelake.operators import desired as W
from sievelake.operators import evidence as E
from sievelake.operators import resolve as R
from sievelake.operators.bucketed import Store
from sievelake.plans.q_evidence import observations
from sievelake.plans.registry import ORACLE_SQL, query
from sievelake.plans.standin import chosen, chosen_sql
from sievelake.runtime import cut, shared_dir

_TRIED = """one AS (SELECT o_orderkey AS entity, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment, n_name AS country, CAST(n_regionkey AS VARCHAR) AS region, r_name AS continent FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
tried AS (SELECT entity, 0 AS seq, 1 AS round, 'by-customer' AS resolver, 'nation' AS field, nation AS value, 'deezer' AS source, true AS accepted, 'accepted' AS why FROM one
UNION ALL SELECT entity, 1, 1, 'by-customer', 'segment', segment, 'deezer', true, 'accepted' FROM one
UNION ALL SELECT entity, 2, 2, 'by-nation', 'country', country, 'musicbrainz', true, 'accepted' FROM one
UNION ALL SELECT entity, 3, 2, 'by-nation', 'region', region, 'musicbrainz', true, 'accepted' FROM one
UNION ALL SELECT entity, 4, 3, 'by-region', 'continent', continent, 'itunes', true, 'accepted' FROM one
UNION ALL SELECT entity, 5, 3, 'by-region', 'country', continent, 'itunes', false, 'outranked by musicbrainz' FROM one
UNION ALL SELECT entity, 6, 4, 'by-pair', 'market', segment || '/' || continent, 'other', true, 'accepted' FROM one
UNION ALL SELECT entity, 7, 4, 'by-pair', 'segment', segment, 'other', false, 'agrees' FROM one)"""


def _resolved(orders, customer, nation, region):
    """Orders enriched by four resolvers, listed so that each round reaches one further."""
    text = lambda c: F.col(c).cast("string")
    first = lambda f: lambda get, records: F.coalesce(F.flatten(F.transform(F.slice(records, 1, 1), lambda x: F.array(*f(x)))), F.array().cast(R.OFFER))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "r_name").distinct()
    m, d, i, o = "musicbrainz", "deezer", "itunes", "other"
    resolvers = [
        R.Resolver("by-pair", ("segment", "continent"), ("market",), R.looked_up(pairs, {"segment": "c_mktsegment", "continent": "r_name"}), first(lambda x: [R.offer("market", F.concat(x["c_mktsegment"], F.lit("/"), x["r_name"]), o), R.offer("segment", x["c_mktsegment"], o)])),
        R.Resolver("by-region", ("region",), ("continent",), R.looked_up(region, {"region": "r_regionkey"}), first(lambda x: [R.offer("continent", x["r_name"], i), R.offer("country", x["r_name"], i)])),
        R.Resolver("by-nation", ("nation",), ("country", "region"), R.looked_up(nation.select("n_nationkey", "n_name", "n_regionkey"), {"nation": "n_nationkey"}), first(lambda x: [R.offer("country", x["n_name"], m), R.offer("region", x["n_regionkey"], m)])),
        R.Resolver("by-customer", ("customer",), ("nation", "segment"), R.looked_up(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), {"customer": "c_custkey"}), first(lambda x: [R.offer("nation", x["c_nationkey"], d), R.offer("segment", x["c_mktsegment"], d)])),
    ]
    return R.resolve(orders.select(F.col("o_orderkey").alias("entity"), F.lit("customer").alias("field"), text("o_custkey").alias("value")), resolvers)


@query("orders", "customer", "nation", "region", sql=f"WITH {_TRIED} SELECT * FROM tried")
def resolver_attempts(orders, customer, nation, region):
    """Every offer of four resolvers, some with several needs, some refused, over rounds until nothing is new."""
    return _resolved(orders, customer, nation, region).attempts()


@query("orders", "customer", "nation", "region", sql=f"WITH {_TRIED} SELECT entity, field, value, source FROM tried WHERE accepted UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS VARCHAR), 'seed' FROM orders")
def resolver_facts(orders, customer, nation, region):
    """What is held after the rounds, of orders whose rounds settled."""
    got = _resolved(orders, customer, nation, region)
    return got.facts().join(got.unsettled(), "entity", "left_anti")


@query("orders", "customer", "nation", "region", sql="""SELECT 'by-customer' AS resolver, count(DISTINCT o_custkey) AS questions, count(DISTINCT CASE WHEN c_custkey IS NOT NULL THEN o_custkey END) AS answered FROM orders LEFT JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'by-nation', count(DISTINCT c_nationkey), count(DISTINCT c_nationkey) FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'by-region', count(DISTINCT n_regionkey), count(DISTINCT n_regionkey) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'by-pair', count(DISTINCT (c_mktsegment, n_regionkey)), count(DISTINCT (c_mktsegment, n_regionkey)) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def resolver_questions(orders, customer, nation, region):
    """How many questions each resolver was asked over all orders and rounds, and how many it answered."""
    return _resolved(orders, customer, nation, region).memo.groupBy("resolver").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("records") > 0).alias("answered"))


@query("events", sql=ORACLE_SQL["evidence_upsert_latest"])
def store_upserts(events):
    """The older half of the events put into a bucketed store, the newer half merged into the buckets it touches."""
    spark = events.sparkSession
    st = Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    half = events.agg(F.expr("max(event_id) div 2").alias("h")).first()[0] or 0
    obs = E.valid(observations(events))
    order = [F.col("seen_at"), F.col("event_id")]
    for batch in (obs.where(F.col("event_id") <= half), obs.where(F.col("event_id") > half)):
        st.upsert(E.latest(batch, order).select(*E.KEY, "state", "value", "seen_at"))
    out = cut(st.current().select(*E.KEY, "state", "value", "first_seen", "seen_at"))
    st.files.remove(st.path)
    return out


_WHO, _SUNG = ["A", "", None, "B", "C"], ["confirmed", "refuted", None, "unsure"]


@query("orders", sql=f"""WITH o AS (SELECT o_orderkey AS id, {chosen_sql('o_orderkey', _WHO)} AS artist, CASE WHEN o_custkey % 6 <> 0 THEN (o_custkey % 21 + 80) / 100.0 END AS c, {chosen_sql('o_custkey', _SUNG)} AS v FROM orders)
SELECT id, coalesce(artist <> '', false) AND (coalesce(c >= 0.9, false) OR coalesce(v = 'confirmed', false)) AS trusted, coalesce(artist <> '', false) AND NOT coalesce(c >= 0.9, false) AND coalesce(v = 'confirmed', false) AS promoted FROM o""")
def identity_gate(orders):
    """Which identities may be written, and which of them for their lyrics alone."""
    c = F.when(F.col("o_custkey") % 6 != 0, (F.col("o_custkey") % 21 + 80) / 100.0)
    t = D.identity_trusted(chosen("o_orderkey", _WHO), c, chosen("o_custkey", _SUNG))
    return orders.select(F.col("o_orderkey").alias("id"), t.alias("t")).select("id", "t.*")


@query("orders", sql="""WITH o AS (SELECT o_orderkey AS e, o_orderstatus AS s, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS p, o_custkey % 10 AS y FROM orders),
a AS (SELECT 'e' || e AS entity, 'status' AS field, s AS value FROM o UNION ALL SELECT 'e' || e, 'priority', p FROM o),
b AS (SELECT 'e' || e AS entity, 'status' AS field, CASE WHEN y = 0 AND e % 5 = 0 THEN NULL ELSE s END AS value FROM o WHERE NOT (y = 0 AND e % 5 = 1) UNION ALL SELECT 'e' || e, 'priority', CASE WHEN y = 0 AND e % 5 = 2 THEN 'none' ELSE p END FROM o)
SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.field, b.field) AS field, CASE WHEN b.entity IS NULL THEN 'released' WHEN b.value IS NULL THEN 'deleted' WHEN a.value IS NULL THEN 'set' ELSE 'changed' END AS action, a.value AS old, b.value AS new
FROM a FULL OUTER JOIN b ON a.entity = b.entity AND a.field = b.field WHERE (b.entity IS NULL OR a.entity IS NULL OR a.value IS DISTINCT FROM b.value)""")
def outputs_changed(orders):
    """What a run has to write when the wanted outputs of some orders have moved; buckets that haven't are not read."""
    spark = orders.sparkSession
    e, y = F.col("o_orderkey"), F.col("o_custkey") % 10 == 0
    out = W.Outputs(spark, f"{shared_dir(spark).rstrip('/')}/outputs-{uuid.uuid4().hex}")
    rows = lambda field, value: F.struct(F.concat(F.lit("e"), e).alias("entity"), F.lit(field).alias("field"), value.alias("value"))
    priority = F.when(e % 7 != 0, F.col("o_orderpriority"))
    all_ = lambda status, pr: orders.select(F.inline(F.array_compact(F.array(status, pr))))
    out.apply(all_(rows("status", F.col("o_orderstatus")), rows("priority", priority)))
    changed = cut(out.apply(all_(F.when(~(y & (e % 5 == 1)), rows("status", F.when(~(y & (e % 5 == 0)), F.col("o_orderstatus")))), rows("priority", F.when(y & (e % 5 == 2), "none").otherwise(priority)))))
    out.store.files.remove(out.path)
    return changed


@query("part", sql="""WITH p AS (SELECT p_partkey AS path, p_partkey % 3 AS d, p_brand AS a, p_name AS t, CAST(p_size AS VARCHAR) AS s FROM part)
SELECT path, 'artist' AS field, a AS value FROM p UNION ALL SELECT path, 'title', t FROM p UNION ALL SELECT path, CASE d WHEN 1 THEN 'x:STAMP' ELSE 'x:stamp' END, s FROM p
UNION ALL SELECT path, 'x:ARTIST', a FROM p WHERE d = 1 UNION ALL SELECT path, 'x:TITLE', t FROM p WHERE d = 1 UNION ALL SELECT path, 'x:©ART', a FROM p WHERE d = 2 UNION ALL SELECT path, 'x:©NAM', t FROM p WHERE d = 2""")
def tags_of_dialects(part):
    """Tags of three dialects under common names."""
    d = F.col("p_partkey") % 3
    of = lambda a, b, c: F.when(d == 0, a).when(d == 1, b).otherwise(c)
    tag = lambda seq, key, value: F.struct(F.lit(seq).alias("seq"), key.alias("key"), F.when(key == "TXXX", "stamp").alias("name"), value.cast("string").alias("value"))
    raw = part.select(F.col("p_partkey").alias("path"), of("id3", "vorbis", "mp4").alias("dialect"), F.inline(F.array(tag(0, of("TPE1", "ARTIST", "©ART"), F.col("p_brand")), tag(1, of("TIT2", "Title", "©nam"), F.col("p_name")), tag(2, of("TXXX", "stamp", W.OWN + "stamp"), F.col("p_size")))))
    return W.tags_of(raw)
