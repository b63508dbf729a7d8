"""Queries on field rules, catalogue joins and judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import fields as X
from sievelake.functions import text as T
from sievelake.operators import rank as R
from sievelake.plans.q_text import sql_norm
from sievelake.functions.fields import LOCALE_WORDS
from sievelake.operators import contain as C
from sievelake.plans.registry import query
from sievelake.plans.standin import chosen, chosen_sql

RAW = "CASE o_orderkey % 4 WHEN 0 THEN 'released ' || CAST(1890 + o_orderkey % 160 AS STRING) || '-01' WHEN 1 THEN '' ELSE CAST(1900 + o_orderkey % 120 AS STRING) END"
CODE = "CASE o_orderkey % 3 WHEN 0 THEN 'GBAAA' || lpad(CAST(o_orderkey AS STRING), 7, '0') WHEN 1 THEN 'gb-' || CAST(o_orderkey AS STRING) END"


@query("orders", sql=rf"""WITH r AS (SELECT o_orderkey, {RAW} AS y, {CODE} AS c, CAST(o_orderkey % 320 AS STRING) || CASE o_orderkey % 2 WHEN 0 THEN ' kbps' ELSE 'k' END AS n FROM orders)
SELECT o_orderkey, CASE WHEN try_cast(regexp_extract(y, '([0-9]{{4}})', 1) AS INT) BETWEEN 1900 AND 2030 THEN CAST(regexp_extract(y, '([0-9]{{4}})', 1) AS INT) END AS y, coalesce(regexp_full_match(c, '[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}'), false) AS isrc, try_cast(string_split(n, ' ')[1] AS DOUBLE) AS kbps FROM r""")
def field_parse(orders):
    r = orders.select("o_orderkey", F.expr(RAW).alias("y"), F.expr(CODE).alias("c"), F.expr("CAST(o_orderkey % 320 AS STRING) || CASE o_orderkey % 2 WHEN 0 THEN ' kbps' ELSE 'k' END").alias("n"))
    return r.select("o_orderkey", X.year(F.col("y")).alias("y"), F.coalesce(X.is_isrc(F.col("c")), F.lit(False)).alias("isrc"), X.number(F.col("n")).alias("kbps"))


@query("part", sql="""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_retailprice / 2 WHEN 1 THEN p_retailprice * 2 WHEN 2 THEN 100.0 ELSE p_retailprice END AS bpm,
CAST((((CASE WHEN p_size % 2 = 1 THEN (p_partkey + 3) % 12 ELSE p_partkey % 12 END) * 7) % 12 + 7) % 12 + 1 AS VARCHAR) || CASE WHEN p_size % 2 = 1 THEN 'A' ELSE 'B' END AS camelot,
array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'low_quality' END, CASE WHEN p_retailprice > 1000 THEN 'bpm_disagree' END, CASE WHEN contains(p_name, 'red') THEN 'key_uncertain' END], lambda x: x IS NOT NULL), ',') AS flags FROM part""")
def override_camelot_flags(part):
    action = F.when(F.col("p_size") % 5 == 0, "halve").when(F.col("p_size") % 5 == 1, "double").when(F.col("p_size") % 5 == 2, "set").when(F.col("p_size") % 5 == 3, "keep")
    named = X.flags(("low_quality", F.col("p_size") < 10), ("bpm_disagree", F.col("p_retailprice") > 1000), ("key_uncertain", F.contains("p_name", F.lit("red"))))
    return part.select("p_partkey", X.override(F.col("p_retailprice"), action, F.lit(100.0)).alias("bpm"), X.camelot(F.col("p_partkey"), F.col("p_size") % 2 == 1).alias("camelot"), F.array_join(named, ",").alias("flags"))


@query("part", sql="""WITH l AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'web:deez+itun' WHEN 2 THEN 'mb' ELSE 'pasted-link' END AS label FROM part)
SELECT p_partkey, unnest(CASE WHEN label IN ('confirmed', 'pasted-link') THEN ['human'] ELSE string_split(regexp_replace(label, '^web:', ''), '+') END) AS source FROM l""")
def source_split(part):
    label = F.when(F.col("p_size") % 4 == 0, "confirmed").when(F.col("p_size") % 4 == 1, "web:deez+itun").when(F.col("p_size") % 4 == 2, "mb").otherwise("pasted-link")
    return part.select("p_partkey", F.explode(X.sources_of(label)).alias("source"))


@query("part", sql="SELECT p_partkey, 'https://s.example/search/' || replace(p_name || ' ' || lower(p_type), ' ', '%20') AS link, upper(left(p_name, 1)) || substring(string_split(p_name, ' ')[1], 2) || ' ' || CASE WHEN string_split(p_name, ' ')[2] IN ('of', 'the') THEN string_split(p_name, ' ')[2] ELSE upper(left(string_split(p_name, ' ')[2], 1)) || substring(string_split(p_name, ' ')[2], 2) END AS title FROM part")
def links_and_titles(part):
    return part.select("p_partkey", X.query_link("https://s.example/search/", F.concat_ws(" ", "p_name", F.lower("p_type"))).alias("link"), X.titlecase(F.col("p_name")).alias("title"))


@query("part", "customer", sql=f"""WITH n AS (SELECT p_partkey, {sql_norm('p_name')} AS n FROM part), k AS (SELECT n AS k FROM n UNION SELECT string_split(n, ' ')[1] FROM n UNION SELECT substring(n, 3) FROM n WHERE p_partkey % 7 = 0),
t AS (SELECT c_custkey, 'the ' || n || CASE WHEN c_custkey % 2 = 0 THEN ' live' ELSE '' END AS name FROM customer JOIN n ON p_partkey = c_custkey)
SELECT c_custkey, name, max_by(k, (length(k), k)) AS answer FROM t JOIN k ON contains(name, k) WHERE k <> '' GROUP BY 1, 2""")
def containment_join(part, customer):
    """The longest known name that a file's name holds, at any place."""
    n = part.select("p_partkey", T.norm(F.col("p_name")).alias("n"))
    k = n.select(F.col("n").alias("p")).unionByName(n.select(F.split("n", " ")[0].alias("p"))).unionByName(n.where("p_partkey % 7 = 0").select(F.expr("substring(n, 3)").alias("p"))).distinct()
    t = customer.join(n, F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("tid"), F.concat(F.lit("the "), "n", F.when(F.col("c_custkey") % 2 == 0, " live").otherwise("")).alias("t"))
    return C.longest_within(t, k).select(F.col("tid").alias("c_custkey"), F.col("t").alias("name"), "answer")


@query("part", "supplier", sql=f"""WITH n AS (SELECT p_partkey AS pid, {sql_norm('p_name')} AS key FROM part WHERE p_partkey % 3 <> 0), o AS (SELECT s_suppkey AS oid, CASE s_suppkey % 3 WHEN 0 THEN 'amazing lyrics ' || {sql_norm('p_name')} WHEN 1 THEN string_split({sql_norm('p_name')}, ' ')[2] ELSE {sql_norm('p_name')} || ' live' END AS key FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT oid, arg_min(pid, (-length(n.key), pid)) AS pid FROM o JOIN n ON n.key <> '' AND o.key <> '' AND (contains(o.key, n.key) OR contains(n.key, o.key)) GROUP BY oid""")
def orphans_adopted(part, supplier):
    """For each answer whose file is gone the surviving file whose name holds its name or lies in it, the longest."""
    norm = T.norm(F.col("p_name"))
    o = supplier.join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("oid"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("amazing lyrics "), norm)).when(F.col("s_suppkey") % 3 == 1, F.get(F.split(norm, " "), 1)).otherwise(F.concat(norm, F.lit(" live"))).alias("key"))
    return C.closest_names(o, part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("pid"), norm.alias("key")))


@query("part")
def similar_names(part):
    """Names that matching blocks find nearly the same."""
    return C.similar_texts(part.select(F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("t")), 0.92).pairs


@query("lineitem", sql="""WITH c AS (SELECT l_orderkey AS grp, l_linenumber AS path, 'v' || (l_partkey % 40) AS id, l_returnflag AS source FROM lineitem WHERE l_quantity > 40), own AS (SELECT DISTINCT grp, path, id, source FROM c)
SELECT m.grp, CAST(m.path AS BIGINT) AS path, o.id, o.source, CAST(min(o.path) AS BIGINT) AS inherited FROM (SELECT DISTINCT grp, path FROM c) m JOIN own o ON o.grp = m.grp AND o.path <> m.path WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.grp = m.grp AND x.path = m.path AND x.id = o.id AND x.source = o.source) GROUP BY 1, 2, 3, 4""")
def group_propagation(lineitem):
    """Members of a group take over the candidates of the others that they don't hold themselves."""
    c = lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("long").alias("path"), F.concat(F.lit("v"), F.col("l_partkey") % 40).alias("id"), F.col("l_returnflag").alias("source")).distinct()
    m = c.select("grp", "path").distinct()
    other = m.join(c.withColumnRenamed("path", "p"), "grp").where("p <> path").groupBy("grp", "path", "id", "source").agg(F.min("p").alias("inherited"))
    return other.join(c, ["grp", "path", "id", "source"], "left_anti")


@query("events", sql="""WITH h AS (SELECT user_id AS path, count(DISTINCT event_type) FILTER (value > 400) AS hits, count(*) FILTER (value > 450) AS wrong FROM events GROUP BY 1)
SELECT path, CASE WHEN hits - (wrong > 2)::INT >= 2 THEN 'A' WHEN hits - (wrong > 2)::INT = 1 THEN 'B' ELSE 'C' END AS grade, CASE WHEN hits - (wrong > 2)::INT >= 2 THEN 0.9::DOUBLE WHEN hits - (wrong > 2)::INT = 1 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM h""")
def corroboration_grade(events):
    h = events.groupBy(F.col("user_id").alias("path")).agg((F.countDistinct(F.when(F.col("value") > 400, F.col("event_type"))) - (F.count_if(F.col("value") > 450) > 2).cast("int")).alias("n"))
    return h.select("path", F.when(F.col("n") >= 2, "A").when(F.col("n") == 1, "B").otherwise("C").alias("grade"), F.when(F.col("n") >= 2, 0.9).when(F.col("n") == 1, 0.8).otherwise(0.7).alias("confidence"))


@query("documents", sql="""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), f AS (SELECT word, count(*) AS df FROM w GROUP BY 1)
SELECT w.doc_id, count(*) FILTER (f.df <= 3) AS rare, count(*) FILTER (f.df >= 100) AS shared, count(*) AS words FROM w JOIN f USING (word) GROUP BY 1""")
def rare_and_shared_words(documents):
    """Of each text's words, those in three texts at most and those in a hundred at least."""
    w = documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word"))
    f = w.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return w.join(f, "word").groupBy("doc_id").agg(F.count_if(F.col("df") <= 3).alias("rare"), F.count_if(F.col("df") >= 100).alias("shared"), F.count(F.lit(1)).alias("words"))


@query("part", sql="SELECT p_type AS tag, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_brand))[1:3], ', ') AS examples FROM part GROUP BY 1")
def tag_report(part):
    return part.groupBy(F.col("p_type").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("p_brand")), 1, 3), ", ").alias("examples"))


@query("lineitem", sql="""SELECT track, CAST(line AS BIGINT) AS line FROM (SELECT l_orderkey AS track, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount < 0.03, l_tax < 0.02, l_linestatus = 'O', abs(l_quantity - 25), l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1""")
def lyric_pick(lineitem):
    """The sheet of the right artist, then the right title, then one with stamps, then the nearest length."""
    c = lineitem.select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("line"), "l_discount", "l_tax", "l_linestatus", "l_quantity", "l_partkey")
    return R.best(c, ["track"], [F.col("l_discount") < 0.03, F.col("l_tax") < 0.02, F.col("l_linestatus") == "O", F.abs(F.col("l_quantity") - 25), F.col("line"), F.col("l_partkey")]).select("track", "line")


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN 'undecodable' WHEN l_returnflag = 'R' THEN 'kept' WHEN least(abs(l_quantity - 25), abs(l_quantity - 40)) > 8 THEN 'length_drift' WHEN l_extendedprice < 12000 THEN 'no_gain' ELSE 'replace' END AS verdict FROM lineitem""")
def replacement_judge(lineitem):
    drift = F.least(F.abs(F.col("l_quantity") - 25), F.abs(F.col("l_quantity") - 40))
    v = F.when(F.col("l_tax") == 0, "undecodable").when(F.col("l_returnflag") == "R", "kept").when(drift > 8, "length_drift").when(F.col("l_extendedprice") < 12000, "no_gain").otherwise("replace")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", v.alias("verdict"))


@query("orders", sql="""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'unreadable' WHEN o_orderstatus = 'P' THEN 'unprocessed' WHEN o_orderkey % 13 = 0 THEN 'stale_version' WHEN o_totalprice < 20000 THEN 'incomplete' ELSE 'ok' END AS status, o_orderpriority LIKE '1%' AS attention FROM orders""")
def verify_status(orders):
    s = F.when(F.col("o_totalprice").isNull(), "unreadable").when(F.col("o_orderstatus") == "P", "unprocessed").when(F.col("o_orderkey") % 13 == 0, "stale_version").when(F.col("o_totalprice") < 20000, "incomplete").otherwise("ok")
    return orders.select("o_orderkey", s.alias("status"), F.col("o_orderpriority").like("1%").alias("attention"))


@query("documents", sql="SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, CASE WHEN length(text) > 120 THEN '#' || left(sha256(text), 16) ELSE text END AS marker FROM documents")
def content_markers(documents):
    """Digests, and the short form that snapshots keep of long values."""
    b = F.col("text").cast("binary")
    return documents.select("doc_id", F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"), F.when(F.length("text") > 120, F.concat(F.lit("#"), F.substring(F.sha2(b, 256), 1, 16))).otherwise(F.col("text")).alias("marker"))


_LOCALE = ["Tiha noć", "ljubav", "Šuma", "Кафана", "hello world", "Ti si moj", "NEMA", "Zenaida", "kaže", ""]


@query("documents", sql=f"""WITH t AS (SELECT doc_id, {chosen_sql('doc_id', _LOCALE)} || ' ' || coalesce(left(text, 30), '') AS name FROM documents)
SELECT doc_id, regexp_matches(name, '[čćšžđČĆŠŽĐ]') OR regexp_matches(name, '[\\x{{0400}}-\\x{{04FF}}]') OR regexp_matches(strip_accents(name), '\\b({LOCALE_WORDS})\\b', 'i') AS cohort FROM t""")
def locale_cohort(documents):
    """Names with a letter of the cohort or in Cyrillic, or with one of its words once accents are off."""
    return documents.select("doc_id", X.in_cohort(F.concat(chosen("doc_id", _LOCALE), F.lit(" "), F.coalesce(F.substring("text", 1, 30), F.lit("")))).alias("cohort"))


@query("orders", sql="SELECT o_orderstatus AS state, year(o_orderdate) AS y, count(*) AS n, CAST(GROUPING(o_orderstatus) + GROUPING(year(o_orderdate)) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, year(o_orderdate))")
def crate_rollup(orders):
    r = orders.select(F.col("o_orderstatus").alias("state"), F.year("o_orderdate").cast("long").alias("y"))
    return r.rollup("state", "y").agg(F.count(F.lit(1)).alias("n"), (F.grouping("state") + F.grouping("y")).cast("long").alias("level"))


@query("orders", "lineitem", sql="""WITH s AS (SELECT l_orderkey AS path, max(l_shipdate) AS stamp FROM lineitem GROUP BY 1) SELECT o_orderkey AS path, s.stamp IS NULL OR s.stamp > o_orderdate + INTERVAL 60 DAY AS due FROM orders LEFT JOIN s ON s.path = o_orderkey""")
def incremental_stamps(orders, lineitem):
    """Rows never built, or built from an older stamp, are due."""
    s = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("stamp"))
    return orders.join(s, "o_orderkey", "left").select(F.col("o_orderkey").alias("path"), (F.col("stamp").isNull() | (F.col("stamp") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))).alias("due"))
