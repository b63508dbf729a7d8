"""Queries on exports, audits, timed text and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.functions import measures, timed
from sievelake.operators import shelves as S
from sievelake.plans.registry import query
from sievelake.runtime import broadcast_if_small


@query("orders", "lineitem", sql="""WITH y AS (SELECT o_orderkey AS id, CAST(floor(year(o_orderdate) / 10) * 10 AS INT) || 's' AS decade, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band, o_orderpriority AS lang FROM orders),
r AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT id, 'Decade/' || decade AS crate FROM y UNION ALL SELECT id, 'Band/' || band FROM y UNION ALL SELECT id, 'Language/' || lang FROM y UNION ALL SELECT id, 'Returned' FROM y JOIN r USING (id)),
n AS (SELECT crate, count(*) AS n FROM c GROUP BY 1),
f AS (SELECT CASE WHEN c.crate LIKE 'Language/%' AND n.n < 2950 THEN 'Language/Other' ELSE c.crate END AS crate, id FROM c JOIN n USING (crate))
SELECT crate, count(*) AS members, min(id) AS first_id, max(id) AS last_id FROM f GROUP BY 1 HAVING count(*) >= 15 OR crate = 'Returned'""")
def crate_export(orders, lineitem):
    """A track goes to many crates; small language crates fold into Other, crates under 15 are dropped."""
    decade = F.concat((F.floor(F.year("o_orderdate") / 10) * 10).cast("int"), F.lit("s"))
    band = F.when(F.col("o_totalprice") < 50000, "low").when(F.col("o_totalprice") < 200000, "mid").otherwise("high")
    back = lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("back", F.lit(True))
    j = orders.join(back, "o_orderkey", "left")
    crates = F.array_compact(F.array(F.concat(F.lit("Decade/"), decade), F.concat(F.lit("Band/"), band), F.concat(F.lit("Language/"), "o_orderpriority"), F.when(F.col("back"), F.lit("Returned"))))
    n = j.select(F.col("o_orderkey").alias("id"), F.explode(crates).alias("crate")).groupBy("crate").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    name = F.when(F.col("crate").startswith("Language/") & (F.col("members") < 2950), "Language/Other").otherwise(F.col("crate"))
    return n.groupBy(name.alias("crate")).agg(F.sum("members").alias("members"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")).where("members >= 15 OR crate = 'Returned'")


@query("orders", "labels", sql="""WITH t AS (SELECT o_orderkey AS id, round(least(1.0, o_totalprice / 400000), 4) AS confidence, CASE WHEN quality = 0 THEN 'confirm' WHEN o_orderstatus = 'P' THEN 'unknown' WHEN o_totalprice / 400000 >= 0.9 THEN NULL ELSE 'verify' END AS sheet FROM orders LEFT JOIN labels ON doc_id = o_orderkey)
SELECT sheet, id, confidence, row_number() OVER (PARTITION BY sheet ORDER BY confidence, id) AS rank FROM t WHERE sheet IS NOT NULL""")
def review_sheets(orders, labels):
    """Rows for review by sheet, numbered from 1, worst first."""
    sheet = F.when(F.col("quality") == 0, "confirm").when(F.col("o_orderstatus") == "P", "unknown").when(F.col("o_totalprice") / 400000 >= 0.9, None).otherwise("verify")
    t = orders.join(labels, orders.o_orderkey == labels.doc_id, "left").select(F.col("o_orderkey").alias("id"), measures.rounded(F.least(F.lit(1.0), F.col("o_totalprice") / 400000), 4).alias("confidence"), sheet.alias("sheet")).where("sheet IS NOT NULL")
    return S.numbered(t, ["sheet"], [F.col("confidence"), F.col("id")]).select("sheet", "id", "confidence", "rank")


@query("events", "lineitem", sql="""WITH c AS (SELECT DISTINCT user_id AS path, 'v' || (event_id % 5) AS video, CASE event_id % 3 WHEN 0 THEN 'origin' WHEN 1 THEN 'exact' ELSE 'search' END AS tier, event_type AS source FROM events),
g AS (SELECT path, video, count(DISTINCT source) AS votes, bool_or(tier = 'origin') AS origin, bool_or(tier = 'exact') AS exact FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY origin DESC, votes DESC, video) AS r, count(*) FILTER (origin) OVER (PARTITION BY path) AS origins, max(votes) OVER (PARTITION BY path) AS best FROM g),
t AS (SELECT path, count(*) AS tied FROM r WHERE votes = best GROUP BY 1)
SELECT r.path, r.video, r.votes, CASE WHEN origin THEN 'origin' WHEN tied > 1 THEN 'review' WHEN votes >= 2 THEN 'vote' WHEN exact THEN 'exact' ELSE 'search' END AS verdict FROM r JOIN t USING (path) WHERE r.r = 1""")
def link_decision(events, lineitem):
    """One video a track: an origin beats all, else distinct sources vote, and a tie goes to review."""
    tier = F.when(F.col("event_id") % 3 == 0, "origin").when(F.col("event_id") % 3 == 1, "exact").otherwise("search")
    c = events.select(F.col("user_id").alias("path"), F.concat(F.lit("v"), F.col("event_id") % 5).alias("video"), tier.alias("tier"), F.col("event_type").alias("source")).distinct()
    g = c.groupBy("path", "video").agg(F.countDistinct("source").alias("votes"), F.bool_or(F.col("tier") == "origin").alias("origin"), F.bool_or(F.col("tier") == "exact").alias("exact"))
    p = g.groupBy("path").agg(F.min_by(F.struct("video", "votes", "origin", "exact"), F.struct(~F.col("origin"), -F.col("votes"), "video")).alias("x"), F.collect_list("votes").alias("all"))
    tied = F.size(F.filter("all", lambda v: v == F.array_max("all"))) > 1
    return p.select("path", "x.video", "x.votes", F.when(F.col("x.origin"), "origin").when(tied, "review").when(F.col("x.votes") >= 2, "vote").when(F.col("x.exact"), "exact").otherwise("search").alias("verdict"))


@query("events", sql="""WITH g AS (SELECT event_id, user_id, ts, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events)
SELECT event_id, user_id, gap, CASE WHEN gap IS NULL THEN 'end' WHEN gap < 600000000 THEN 'none' WHEN gap < 3600000000 THEN 'trim' WHEN gap < 86400000000 THEN 'skip_short' ELSE 'review_long' END AS decision FROM g""")
def silence_intervals(events):
    """The silence after each event, in microseconds, and what to do about it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = events.select("event_id", "user_id", (F.unix_micros(F.lead(F.col("ts").cast("timestamp")).over(w)) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("gap"))
    d = F.when(F.col("gap").isNull(), "end").when(F.col("gap") < 600000000, "none").when(F.col("gap") < 3600000000, "trim").when(F.col("gap") < 86400000000, "skip_short").otherwise("review_long")
    return g.withColumn("decision", d)


@query("documents", "labels", sql="""SELECT d.doc_id, CASE WHEN length(trim(text)) = 0 THEN 0.0::DOUBLE WHEN quality = 0 THEN 0.2::DOUBLE WHEN quality IS NULL THEN 0.5::DOUBLE WHEN toxic = 1 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS score, CASE WHEN length(trim(text)) = 0 THEN 'no words' WHEN quality = 0 THEN 'refuted' WHEN quality IS NULL THEN 'unchecked' WHEN toxic = 1 THEN 'flagged' ELSE 'confirmed' END AS reason,
CASE WHEN quality IS NOT NULL THEN round(greatest(0.5, 1 - (n_chars % 20) / 40.0), 4)::DOUBLE END AS timing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def lyric_gates(documents, labels):
    j = documents.join(labels, "doc_id", "left")
    empty, q = F.length(F.trim("text")) == 0, F.col("quality")
    score = F.when(empty, 0.0).when(q == 0, 0.2).when(q.isNull(), 0.5).when(F.col("toxic") == 1, 0.8).otherwise(1.0)
    why = F.when(empty, "no words").when(q == 0, "refuted").when(q.isNull(), "unchecked").when(F.col("toxic") == 1, "flagged").otherwise("confirmed")
    return j.select("doc_id", score.alias("score"), why.alias("reason"), F.when(q.isNotNull(), F.round(F.greatest(F.lit(0.5), 1 - (F.col("n_chars") % 20) / 40.0), 4)).alias("timing"))


@query("orders", sql="SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':slug'), 1, 8) AS BIGINT) % 1000 AS draw FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':slug'), 1, 8) AS BIGINT) % 1000 < 50 OR o_orderkey % 997 = 0")
def sample_draw(orders):
    """A sample by hash of the key, the same in every run, and some keys by name."""
    draw = F.conv(F.substring(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":slug")).cast("binary")), 1, 8), 16, 10).cast("long") % 1000
    return orders.select("o_orderkey", draw.alias("draw")).where("draw < 50 OR o_orderkey % 997 = 0")


@query("orders", sql="""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 <> 0), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0), t AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 14 = 0)
SELECT coalesce(b.k, a.k) AS path, CASE WHEN a.k IS NULL THEN 'vanished' WHEN b.k IS NULL THEN 'appeared' WHEN a.v IS NOT DISTINCT FROM b.v AND t.k IS NOT NULL THEN 'missed' WHEN t.k IS NOT NULL THEN 'fixed' ELSE 'collateral' END AS outcome FROM b FULL OUTER JOIN a ON a.k = b.k LEFT JOIN t ON t.k = coalesce(b.k, a.k) WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v OR t.k IS NOT NULL""")
def snapshot_diff(orders):
    """Two snapshots by path against the paths meant to change."""
    k = F.col("o_orderkey")
    b = orders.where(k % 10 != 0).select(k.alias("path"), F.col("o_orderstatus").alias("b"), F.lit(True).alias("inb"))
    a = orders.where(k % 11 != 0).select(k.alias("path"), F.when(k % 7 == 0, "F").otherwise(F.col("o_orderstatus")).alias("a"), F.lit(True).alias("ina"))
    t = orders.where(k % 14 == 0).select(k.alias("path"), F.lit(True).alias("t"))
    j = b.join(a, "path", "full_outer").join(t, "path", "left")
    same = F.col("a").eqNullSafe(F.col("b"))
    out = F.when(F.col("ina").isNull(), "vanished").when(F.col("inb").isNull(), "appeared").when(same & F.col("t").isNotNull(), "missed").when(F.col("t").isNotNull(), "fixed").when(~same, "collateral")
    return j.select("path", out.alias("outcome")).where("outcome IS NOT NULL")


@query("lineitem", sql="""SELECT l_returnflag AS cohort, count(*) AS n, round(avg(e), 4) AS mean, round(median(e), 4) AS median, round(quantile_disc(e, 0.95), 4) AS p95, round(max(e), 4) AS worst FROM (SELECT l_returnflag, abs(l_quantity - 25) + l_discount AS e FROM lineitem) GROUP BY 1""")
def audit_error_stats(lineitem):
    e = lineitem.select(F.col("l_returnflag").alias("cohort"), (F.abs(F.col("l_quantity") - 25) + F.col("l_discount")).alias("e"))
    return e.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 4).alias("mean"), F.round(F.median("e"), 4).alias("median"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY e)"), 4).alias("p95"), F.round(F.max("e"), 4).alias("worst"))


@query("labels", "documents", sql="SELECT lang, quality, toxic, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3")
def audit_confusion(labels, documents):
    j = labels.join(documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return j.groupBy("lang", F.col("quality"), F.col("toxic")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("documents", "labels", sql="""SELECT lang, CAST(count(CASE WHEN q IS NULL THEN 1 END) AS BIGINT) AS unchecked, CAST(count(CASE WHEN q = 1 THEN 1 END) AS BIGINT) AS good, CAST(count(CASE WHEN q = 0 THEN 1 END) AS BIGINT) AS bad FROM (SELECT lang, quality AS q FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def lyric_audit_checks(documents, labels):
    """Cohort by outcome."""
    j = documents.select("doc_id", "lang").join(labels, "doc_id", "left")
    return j.groupBy("lang").agg(F.count_if(F.col("quality").isNull()).alias("unchecked"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))


@query("part", sql="""WITH t AS (SELECT p_type AS tag FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 3)
SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'scene' WHEN p_size BETWEEN 6 AND 9 AND contains(p_name, 'bolt') THEN 'track:bolt' WHEN p_type IN (SELECT tag FROM t) AND p_retailprice >= 950 THEN 'shared:' || lower(p_type) END AS genre FROM part""")
def genre_ladder(part):
    """The first rung that knows a genre: scene, the track's own tag, a tag that at least three artists share."""
    shared = part.groupBy("p_type").agg(F.countDistinct("p_brand").alias("df")).where("df >= 3").select("p_type", F.lit(True).alias("ok"))
    j = part.join(broadcast_if_small(shared), "p_type", "left")
    g = F.when(F.col("p_size") <= 5, "scene").when(F.col("p_size").between(6, 9) & F.contains("p_name", F.lit("bolt")), "track:bolt").when(F.col("ok") & (F.col("p_retailprice") >= 950), F.concat(F.lit("shared:"), F.lower("p_type")))
    return j.select("p_partkey", g.alias("genre"))


SHEET = "'[00:' || lpad(CAST(p_size % 60 AS STRING), 2, '0') || '.5][01:02.25] ' || p_name || chr(10) || '[02:03] ' || p_brand || chr(10) || '[03:00] ♪'"


@query("part", sql="""SELECT p_partkey, (p_size % 60) + 0.5::DOUBLE AS sec, p_name AS words FROM part UNION ALL SELECT p_partkey, 62.25::DOUBLE, p_name FROM part UNION ALL SELECT p_partkey, 123.0::DOUBLE, p_brand FROM part""")
def lrc_lines(part):
    return timed.lines(part.select("p_partkey", F.expr(SHEET).alias("sheet")), "sheet", "p_partkey")


@query("part")
def lrc_shift(part):
    """Every stamp half a second later; a replacement with a computed value, so without SQL."""
    return part.select("p_partkey", timed.shift(F.expr(SHEET), 0.5).alias("sheet"))


@query("documents", "benchmark", sql=r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) - 1 AS p FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS a FROM benchmark),
s AS (SELECT item_id, a[1] || ' ' || a[2] || ' ' || a[3] || ' ' || a[4] AS k FROM i), g AS (SELECT doc_id, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS k FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY p))
SELECT doc_id, item_id, CAST(min(p) AS BIGINT) AS first_at, count(*) AS places FROM g JOIN s USING (k) GROUP BY 1, 2""")
def passage_locate(documents, benchmark):
    """Where a passage's first four words stand in a text, earliest first."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)
    four = F.transform(F.array(words(F.col("text"))), lambda w: F.zip_with(F.zip_with(w, F.slice(w, 2, F.size(w) + 1), lambda a, b: F.concat(a, F.lit(" "), b)), F.zip_with(F.slice(w, 3, F.size(w) + 1), F.slice(w, 4, F.size(w) + 1), lambda a, b: F.concat(a, F.lit(" "), b)), lambda a, b: F.concat(a, F.lit(" "), b)))[0]
    g = documents.select("doc_id", F.posexplode(four).alias("p", "k"))
    s = benchmark.select("item_id", F.array_join(F.slice(words(F.col("text")), 1, 4), " ").alias("k"))
    return g.where("k IS NOT NULL").join(s, "k").groupBy("doc_id", "item_id").agg(F.min("p").cast("long").alias("first_at"), F.count(F.lit(1)).alias("places"))
