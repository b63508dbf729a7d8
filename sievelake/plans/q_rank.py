"""Queries on ranking, joining, grouping and measuring; star-schema tables stand in for candidates and tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.functions import measures as M
from sievelake.functions import text as T
from sievelake.operators import graph as G
from sievelake.operators import rank as R
from sievelake.operators import shelves as S
from sievelake.plans.q_text import sql_norm
from sievelake.plans.registry import query
from sievelake.runtime import broadcast_if_small, cut



@query("lineitem", "part", sql="""WITH c AS (SELECT l_orderkey AS track, l_partkey AS id, round(l_discount * 10, 1) AS score, p_size AS album_rank, year(l_shipdate) AS y, l_linenumber AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, id ORDER BY score DESC, album_rank, y, n) AS q FROM c) WHERE q = 1)
SELECT track, id, score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, album_rank, y, id) AS r FROM d) WHERE r <= 5""")
def candidate_argmax_alternatives(lineitem, part):
    """A track's best candidate and its next four of other ids."""
    c = lineitem.join(part, lineitem.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("track"), F.col("l_partkey").alias("id"), F.round(F.col("l_discount") * 10, 1).alias("score"), F.col("p_size").alias("album_rank"), F.year("l_shipdate").alias("y"), F.col("l_linenumber").alias("n"))
    one = R.best(c, ["track", "id"], [-F.col("score"), F.col("album_rank"), F.col("y"), F.col("n")])
    return R.top(one, ["track"], [F.desc("score"), F.col("album_rank"), F.col("y"), F.col("id")], 5).select("track", "id", "score", "rank")


@query("lineitem", "part", sql="""WITH c AS (SELECT l_orderkey AS track, l_partkey AS grp, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END + CASE WHEN p_size > 40 THEN 4 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 3 ELSE 0 END AS rnk, year(l_shipdate) AS y FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT track, grp, CAST(rnk AS BIGINT) AS type_rank, CAST(y AS BIGINT) AS y FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY rnk, y, grp) AS r FROM c) WHERE r = 1""")
def release_rank(lineitem, part):
    """Of a track's releases the one of the best type after penalties, then the earliest."""
    t = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "STANDARD", 1).when(F.col("p_type") == "SMALL", 2).otherwise(3)
    rnk = t + F.when(F.col("p_size") > 40, 4).otherwise(0) + F.when(F.contains("p_name", F.lit("ring")), 3).otherwise(0)
    c = lineitem.join(part, lineitem.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("track"), F.col("l_partkey").alias("grp"), rnk.cast("long").alias("type_rank"), F.year("l_shipdate").cast("long").alias("y"))
    return R.best(c, ["track"], [F.col("type_rank"), F.col("y"), F.col("grp")])


@query("orders", "customer", "labels", sql="""WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN c_name END AS fp, CASE WHEN o_orderpriority LIKE '1%' THEN c_mktsegment END AS txt, CASE WHEN o_orderstatus <> 'F' THEN c_mktsegment || '?' END AS guess, quality, round(least(1.0, o_totalprice / 400000), 4) AS c0, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN labels ON doc_id = o_orderkey),
s AS (SELECT id, coalesce(fp, txt, guess) AS proposal, CASE WHEN fp IS NOT NULL THEN 'fingerprint' WHEN txt IS NOT NULL THEN 'text' WHEN guess IS NOT NULL THEN 'filename' END AS source, quality, round(c0 * CASE WHEN c_acctbal < 0 THEN 0.85 ELSE 1.0 END * CASE WHEN fp IS NULL AND txt IS NULL THEN 0.9 ELSE 1.0 END, 8) AS confidence FROM b)
SELECT id, proposal, source, confidence, CASE WHEN quality = 0 THEN 'hinted' WHEN proposal IS NULL THEN 'unmatched' WHEN confidence >= 0.90 THEN 'auto' WHEN confidence >= 0.55 THEN 'review' ELSE 'suspect' END AS tier FROM s""")
def precedence_merge_tier(orders, customer, labels):
    """The first proposal by precedence, its confidence after multipliers, and its tier."""
    j = orders.join(customer, orders.o_custkey == customer.c_custkey).join(labels, labels.doc_id == orders.o_orderkey, "left")
    fp, txt = F.when(F.col("o_orderstatus") == "F", F.col("c_name")), F.when(F.col("o_orderpriority").like("1%"), F.col("c_mktsegment"))
    guess = F.when(F.col("o_orderstatus") != "F", F.concat("c_mktsegment", F.lit("?")))
    source = F.when(fp.isNotNull(), "fingerprint").when(txt.isNotNull(), "text").when(guess.isNotNull(), "filename")
    conf = M.rounded(M.rounded(F.least(F.lit(1.0), F.col("o_totalprice") / 400000), 4) * F.when(F.col("c_acctbal") < 0, 0.85).otherwise(1.0) * F.when(fp.isNull() & txt.isNull(), 0.9).otherwise(1.0), 8)
    s = j.select(F.col("o_orderkey").alias("id"), F.coalesce(fp, txt, guess).alias("proposal"), source.alias("source"), "quality", conf.alias("confidence"))
    tier = F.when(F.col("quality") == 0, "hinted").when(F.col("proposal").isNull(), "unmatched").when(F.col("confidence") >= 0.90, "auto").when(F.col("confidence") >= 0.55, "review").otherwise("suspect")
    return s.select("id", "proposal", "source", "confidence", tier.alias("tier"))


@query("lineitem", sql="""WITH g AS (SELECT l_orderkey AS grp, max(l_quantity) - min(l_quantity) > 15 AS spread FROM lineitem GROUP BY 1),
k AS (SELECT l_orderkey AS grp, l_linenumber AS member, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN spread THEN l_quantity ELSE 0 END, l_extendedprice DESC, l_linenumber) AS r FROM lineitem JOIN g ON l_orderkey = grp),
i AS (SELECT grp, l_partkey AS inherited FROM (SELECT l_orderkey AS grp, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber DESC, l_partkey DESC) AS q FROM lineitem) WHERE q = 1)
SELECT k.grp, CAST(k.member AS BIGINT) AS keeper, i.inherited FROM k JOIN i USING (grp) WHERE r = 1""")
def keeper_inheritance(lineitem):
    """Of each group the member to keep, the shortest where lengths spread, and what it takes over from the best known member."""
    g = lineitem.groupBy(F.col("l_orderkey").alias("grp")).agg((F.max("l_quantity") - F.min("l_quantity") > 15).alias("spread"), F.max_by("l_partkey", F.struct("l_discount", "l_linenumber", "l_partkey")).alias("inherited"))
    m = lineitem.select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("long").alias("keeper"), "l_quantity", "l_extendedprice").join(g, "grp")
    return R.best(m, ["grp"], [F.when(F.col("spread"), F.col("l_quantity")).otherwise(0.0), -F.col("l_extendedprice"), F.col("keeper")]).select("grp", "keeper", "inherited")


@query("lineitem", sql="""WITH a AS (SELECT l_orderkey AS grp, l_orderkey * 8 + l_linenumber AS path, l_quantity AS cutoff, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) > 1 AS lose FROM lineitem),
n AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS path FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05),
l AS (SELECT path FROM a WHERE lose UNION SELECT path FROM n),
r AS (SELECT grp, max(path) AS path FROM a GROUP BY grp HAVING bool_and(path IN (SELECT path FROM l)))
SELECT path FROM l EXCEPT SELECT path FROM r""")
def loser_rescue(lineitem):
    """Losers of two methods, less the best member of groups that would lose all."""
    a = lineitem.select(F.col("l_orderkey").alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("path"), F.col("l_quantity").alias("cutoff"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")).alias("r"))
    lost = a.where("r > 1").select("path").unionByName(lineitem.where("l_returnflag = 'R' AND l_discount >= 0.05").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("path"))).distinct()
    marked = a.join(lost.withColumn("gone", F.lit(True)), "path", "left")
    saved = marked.groupBy("grp").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("all"), F.max("path").alias("path")).where("all").select("path").distinct()
    return lost.join(saved, "path", "left_anti")


@query("documents", sql="SELECT a.lang, a.source, a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id AND abs(a.n_chars - b.n_chars) <= 2.5")
def duration_band_selfjoin(documents):
    return R.band_pairs(documents.select("doc_id", "lang", "source", "n_chars"), "doc_id", "n_chars", 2.5, ["lang", "source"])


@query("embeddings", sql="""WITH w AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS lo, list_sum(list_transform(range(33, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 33) ELSE 0 END))::BIGINT AS hi FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS BIGINT) AS distance FROM w a JOIN w b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 14""")
def fingerprint_ber_pairs(embeddings):
    """Pairs whose sign bits (63 of them) differ in at most 14 places, a bit-error rate under 0.23."""
    bits = F.expr("aggregate(sequence(1, 63), 0L, (s, i) -> s | IF(embedding[i - 1] > 0, shiftleft(1L, i - 1), 0L))")
    return R.hamming_pairs(embeddings.select("vec_id", bits.alias("w")), "vec_id", "w", 14, 63)


@query("documents", sql=f"""WITH RECURSIVE n AS (SELECT doc_id, md5({sql_norm('text')}) AS k1, source || ':' || n_chars AS k2 FROM documents),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY k1) AS b FROM n UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY k2) FROM n),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(id, to_) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, u.b FROM r JOIN u ON r.to_ = u.a)
SELECT id AS doc_id, min(to_) AS component FROM r GROUP BY 1""")
def duplicate_components(documents):
    """Documents that share a normal form, or source and length, directly or over others."""
    n = cut(documents.select("doc_id", F.md5(T.norm(F.col("text")).cast("binary")).alias("k1"), F.concat_ws(":", "source", "n_chars").alias("k2")))
    edges = None
    for k in ("k1", "k2"):
        e = n.join(n.groupBy(k).agg(F.min("doc_id").alias("dst"), F.count(F.lit(1)).alias("m")).where("m > 1"), k).select(F.col("doc_id").alias("src"), "dst")
        edges = e if edges is None else edges.unionByName(e)
    comp = G.connected_components(cut(edges))
    return n.select("doc_id").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


@query("documents", sql="""WITH o AS (SELECT doc_id, md5(string_split(text, chr(10))[1]) AS opening, md5(text) AS song FROM documents)
SELECT opening, min(doc_id) AS representative, count(*) AS members, count(DISTINCT song) AS distinct_songs FROM o GROUP BY 1 HAVING count(DISTINCT song) >= 3""")
def shared_opening_clusters(documents):
    """Openings that at least three different texts share."""
    o = documents.select("doc_id", F.md5(F.split("text", "\n", -1)[0].cast("binary")).alias("opening"), F.md5(F.col("text").cast("binary")).alias("song"))
    return o.groupBy("opening").agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("members"), F.countDistinct("song").alias("distinct_songs")).where("distinct_songs >= 3")


@query("documents", sql="""WITH g AS (SELECT doc_id, lang, source, n_chars, CASE WHEN n_chars - lag(n_chars) OVER w > greatest(12, 0.08 * greatest(n_chars, lag(n_chars) OVER w)) THEN 1 ELSE 0 END AS gap FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY n_chars, doc_id))
SELECT doc_id, lang, source, CAST(sum(gap) OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g""")
def length_islands(documents):
    return R.islands(documents.select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], "n_chars", "doc_id", 12.0, 0.08).select("doc_id", "lang", "source", "island")


@query("nation", sql="""WITH RECURSIVE e AS (SELECT n_nationkey AS name, (n_nationkey * 7) % 25 AS alias FROM nation WHERE (n_nationkey * 7) % 25 < n_nationkey), r(name, to_) AS (SELECT name, alias FROM e UNION SELECT r.name, e.alias FROM r JOIN e ON r.to_ = e.name)
SELECT CAST(name AS BIGINT) AS name, CAST(min(to_) AS BIGINT) AS canonical FROM r GROUP BY 1""")
def alias_resolve(nation):
    e = nation.select(F.col("n_nationkey").cast("long").alias("name"), ((F.col("n_nationkey") * 7) % 25).cast("long").alias("alias")).where("alias < name")
    return G.resolve_aliases(e)


@query("customer", "nation", "region", sql="""SELECT c_custkey AS entity, 'nation' AS field, CAST(c_nationkey AS VARCHAR) AS value, CAST(0 AS BIGINT) AS round FROM customer
UNION ALL SELECT c_custkey, 'country', n_name, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 'region', CAST(n_regionkey AS VARCHAR), 1 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_custkey, 'continent', r_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def fixpoint_enrichment(customer, nation, region):
    """Resolvers that need one fact and give another, run until nothing is new."""
    text = lambda c: F.col(c).cast("string")
    facts = customer.select(F.col("c_custkey").alias("entity"), F.lit("nation").alias("field"), text("c_nationkey").alias("value"))
    look = [("nation", "country", nation.select(text("n_nationkey").alias("key"), F.col("n_name").alias("result"))), ("nation", "region", nation.select(text("n_nationkey").alias("key"), text("n_regionkey").alias("result"))), ("region", "continent", region.select(text("r_regionkey").alias("key"), F.col("r_name").alias("result")))]
    return G.fixpoint(facts, look).select("entity", "field", "value", F.col("round").cast("long").alias("round"))


@query("supplier", "nation", sql="""WITH v AS (SELECT s_suppkey % 7 AS artist, n_name AS country, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT CAST(artist AS BIGINT) AS artist, country, n, round(n::DOUBLE / total, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY artist) AS total, row_number() OVER (PARTITION BY artist ORDER BY n DESC, country) AS r FROM v) WHERE r = 1""")
def origin_vote(supplier, nation):
    v = supplier.join(broadcast_if_small(nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy((F.col("s_suppkey") % 7).cast("long").alias("artist"), F.col("n_name").alias("country")).agg(F.count(F.lit(1)).alias("n"))
    t = v.groupBy("artist").agg(F.min_by(F.struct("country", "n"), F.struct(-F.col("n"), "country")).alias("x"), F.sum("n").alias("total"))
    return t.select("artist", "x.country", "x.n", F.round(F.col("x.n") / F.col("total"), 6).alias("share"))


@query("lineitem", sql="""WITH g AS (SELECT l_orderkey AS album, 10 * log10(sum(pow(10, (-l_quantity / 2) / 10) * l_extendedprice) / sum(l_extendedprice)) AS level, max(CASE WHEN l_tax > 0 THEN l_tax * 10 END) AS peak FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(CASE WHEN l_tax > 0 THEN 1 END) = count(*))
SELECT album, round(level, 4) AS level, round(peak, 4) AS peak, round(least(-14.0 - level, -1.0 - 20 * log10(peak)), 4) AS gain FROM g""")
def energy_mean_gain(lineitem):
    """Albums of two members or more that all have a peak: mean loudness in the energy domain and the gain."""
    peak = F.when(F.col("l_tax") > 0, F.col("l_tax") * 10)
    g = lineitem.groupBy(F.col("l_orderkey").alias("album")).agg(M.energy_mean(-F.col("l_quantity") / 2, F.col("l_extendedprice")).alias("level"), F.max(peak).alias("peak"), F.count(F.lit(1)).alias("n"), F.count(peak).alias("m")).where("n >= 2 AND m = n")
    return g.select("album", F.round("level", 4).alias("level"), F.round("peak", 4).alias("peak"), F.round(M.gain(F.col("level"), F.col("peak")), 4).alias("gain"))


@query("lineitem", sql="""WITH t AS (SELECT l_orderkey, l_linenumber, round(l_quantity * pow(2, greatest(0, ceil(log2(65.0 / l_quantity)))), 1) AS bpm FROM lineitem WHERE l_quantity > 0)
SELECT l_orderkey AS track, bpm, n AS votes, CASE WHEN n = total THEN 'agree' WHEN 2 * n > total THEN 'majority' ELSE 'disagree' END AS verdict FROM (SELECT l_orderkey, bpm, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, bpm) AS r FROM t GROUP BY 1, 2) WHERE r = 1""")
def octave_fold_vote(lineitem):
    t = lineitem.where("l_quantity > 0").select(F.col("l_orderkey").alias("track"), M.octave(F.col("l_quantity")).alias("bpm"))
    v = t.groupBy("track", "bpm").agg(F.count(F.lit(1)).alias("n"))
    b = v.groupBy("track").agg(F.min_by(F.struct("bpm", "n"), F.struct(-F.col("n"), "bpm")).alias("x"), F.sum("n").alias("total"))
    return b.select("track", "x.bpm", F.col("x.n").alias("votes"), F.when(F.col("x.n") == F.col("total"), "agree").when(2 * F.col("x.n") > F.col("total"), "majority").otherwise("disagree").alias("verdict"))


@query("part", sql="""SELECT p_partkey, CASE WHEN k >= 19.5 THEN 'high' WHEN k >= 17.5 THEN 'good' WHEN k >= 15.5 THEN 'fair' ELSE 'low' END AS grade, p_retailprice >= 256 AND k < 17.5 AS suspect FROM (SELECT *, p_size / 2.0 AS k FROM part)""")
def quality_grade(part):
    k = F.col("p_size") / 2.0
    return part.select("p_partkey", M.grade(k).alias("grade"), ((F.col("p_retailprice") >= 256) & (k < 17.5)).alias("suspect"))


@query("lineitem", sql="SELECT l_partkey AS video, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS song, count(*) AS claims FROM lineitem GROUP BY 1")
def claim_once(lineitem):
    """A video belongs to the first song that claims it."""
    return lineitem.groupBy(F.col("l_partkey").alias("video")).agg(F.min_by("l_orderkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("song"), F.count(F.lit(1)).alias("claims"))


@query("orders", sql="SELECT o_orderkey, o_orderpriority AS tier, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 50 AS BIGINT) AS batch FROM orders WHERE o_orderstatus <> 'P'")
def submit_batches(orders):
    """Batches of fifty within each tier."""
    d = orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderpriority").alias("tier"))
    return S.numbered(d, ["tier"], [F.col("o_orderkey")], "n").select("o_orderkey", "tier", F.floor((F.col("n") - 1) / 50).alias("batch"))
