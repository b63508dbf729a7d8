"""Queries on copies: embeddings stand in for fingerprints, orders and line items for files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import names as N
from sievelake.operators import copies as P
from sievelake.plans.q_answers import _lowered
from sievelake.plans.registry import query
from sievelake.plans.standin import chosen, chosen_sql

ITEMS = "list_transform(embedding, lambda e: CAST(floor(abs(CAST(e AS DOUBLE)) * 1000000) AS BIGINT))"


def _items(e):
    return F.transform(e, lambda x: F.floor(F.abs(x.cast("double")) * 1000000).cast("long"))


def _ber(a, b, k, least):
    return f"""coalesce(list_min(list_filter(list_transform(range(-{k}, {k + 1}), lambda o: CASE WHEN least(len({a}) - greatest(o, 0), len({b}) - greatest(-o, 0)) >= {least}
  THEN list_sum(list_transform(range(1, least(len({a}) - greatest(o, 0), len({b}) - greatest(-o, 0)) + 1), lambda i: bit_count(xor({a}[i + greatest(o, 0)], {b}[i + greatest(-o, 0)])))) / (32.0 * least(len({a}) - greatest(o, 0), len({b}) - greatest(-o, 0))) END), lambda x: x IS NOT NULL)), 1.0)"""


@query("embeddings", sql=f"""WITH f AS (SELECT vec_id, {ITEMS} AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, CASE x.vec_id % 4 WHEN 0 THEN x.a[4:] WHEN 1 THEN y.a WHEN 2 THEN x.a[1:10] ELSE list_concat(y.a[1:6], x.a) END AS b FROM f x JOIN f y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, CAST(round({_ber('a', 'b', 8, 20)}, 6) AS DOUBLE) AS narrow, CAST(round({_ber('a', 'b', 12, 30)}, 6) AS DOUBLE) AS wide FROM p""")
def bit_error_offsets(embeddings):
    """Bit error of pairs of fingerprints: shifted, unrelated, too short, with a prefix; over narrow and wide offsets."""
    f = embeddings.select("vec_id", _items(F.col("embedding")).alias("a"))
    nxt = f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("y"))
    r = F.col("vec_id") % 4
    p = f.join(nxt, "vec_id").withColumn("b", F.when(r == 0, F.slice("a", 4, 64)).when(r == 1, F.col("y")).when(r == 2, F.slice("a", 1, 10)).otherwise(F.concat(F.slice("y", 1, 6), "a")))
    return p.select("vec_id", F.round(P.bit_error_rate(F.col("a"), F.col("b"), 8, 20), 6).alias("narrow"), F.round(P.bit_error_rate(F.col("a"), F.col("b"), 12, 30), 6).alias("wide"))


@query("lineitem", sql="""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 3 END AS x, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_quantity * 3 * (1 + l_discount) END AS y FROM lineitem)
SELECT id, l_partkey, NOT coalesce(x > 0, false) OR NOT coalesce(y > 0, false) OR abs(x * 0.5 - y) <= 0.07 * y OR abs(x - y) <= 0.07 * y OR abs(x * 2 - y) <= 0.07 * y AS agrees FROM t""")
def tempo_agreement(lineitem):
    """Tempos that agree, an octave up or down allowed; unknown ones do."""
    x = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 3)
    y = F.when(F.col("l_suppkey") % 9 == 0, 0.0).otherwise(F.col("l_quantity") * 3 * (1 + F.col("l_discount")))
    return lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", P.tempo_agrees(x, y).alias("agrees"))


_A, _T = ["Ana", "Ana Music", "Zed", "Iva"], ["Zora", "Zora (Live)", "ZORA official video", "Noć", "More"]
_FILES = ["Ana - Zora", "Zora", "Zed Zora live", "Iva - More", "Ana - Noć"]
ROWS = f"""rows AS (SELECT o_orderkey AS path, o_orderkey AS seq, {chosen_sql('o_orderkey // 3', _FILES)} AS file, {chosen_sql('o_custkey', _A)} || (o_custkey // 40) AS artist, {chosen_sql('o_orderkey', _T)} || (o_custkey // 160) AS title, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 100.0 + (o_orderkey % 97) * 4 END AS seconds, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 80.0 + (o_custkey % 3) * 45 END AS tempo, o_totalprice AS size, o_orderkey % 4 AS bitrate FROM orders)"""


def _rows(orders):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    third = F.element_at(F.array(*map(F.lit, _FILES)), (F.floor(k / 3) % len(_FILES) + 1).cast("int"))
    return orders.select(k.alias("path"), k.alias("seq"), third.alias("file"), F.concat(chosen("o_custkey", _A), F.floor(c / 40).cast("string")).alias("artist"), F.concat(chosen("o_orderkey", _T), F.floor(c / 160).cast("string")).alias("title"), F.when(k % 17 != 0, 100.0 + (k % 97) * 4).alias("seconds"), F.when(k % 5 != 0, 80.0 + (c % 3) * 45).alias("tempo"), F.lit(None).cast("array<bigint>").alias("items"), F.col("o_totalprice").alias("size"), (k % 4).alias("bitrate"))


def _key(x):
    return _lowered(f"regexp_replace({x}, '\\b({N.DECORATION})\\b', ' ', 'gi')")


_VER = f"list_sort(list_distinct(regexp_extract_all(lower({{0}}), '\\b({N.VERSION})\\b', 1)))"


def _agrees(x, y):
    return f"(coalesce({x}, 0) = 0 OR coalesce({y}, 0) = 0 OR abs({x} * 0.5 - {y}) <= 0.07 * {y} OR abs({x} - {y}) <= 0.07 * {y} OR abs({x} * 2 - {y}) <= 0.07 * {y})"


NAMED = f"""{ROWS}, k AS (SELECT *, {_key('artist')} AS ka, {_key('title')} AS kt, coalesce(seconds, 0) AS sec FROM rows), heads AS (SELECT ka, kt, arg_min(file, seq) AS file, arg_min(sec, seq) AS sec, arg_min(coalesce(tempo, 0), seq) AS tempo, arg_min(title, seq) AS title FROM k GROUP BY 1, 2), hk AS (SELECT *, {_key('file')} AS kf FROM heads),
pr AS (SELECT x.kt, x.ka AS a, y.ka AS b FROM hk x JOIN hk y ON x.kt = y.kt AND x.ka < y.ka WHERE x.kf <> '' AND y.kf <> '' AND (contains(x.kf, y.kf) OR contains(y.kf, x.kf)) AND x.sec > 0 AND y.sec > 0 AND abs(x.sec - y.sec) <= greatest(12, 0.08 * greatest(x.sec, y.sec)) AND ({_agrees('x.tempo', 'y.tempo')} OR {_agrees('y.tempo', 'x.tempo')})),
lk AS (SELECT DISTINCT kt, unnest([a, b]) AS ka FROM pr), tg AS (SELECT kt, min(ka) AS to_ FROM lk GROUP BY 1), mk AS (SELECT k.* EXCLUDE (ka), coalesce(tg.to_, k.ka) AS ka FROM k LEFT JOIN lk ON lk.ka = k.ka AND lk.kt = k.kt LEFT JOIN tg ON tg.kt = lk.kt),
vr AS (SELECT mk.*, array_to_string(list_sort(list_concat(list_filter({_VER.format('mk.title')}, lambda v: NOT list_contains({_VER.format('heads.title')}, v)), list_filter({_VER.format('heads.title')}, lambda v: NOT list_contains({_VER.format('mk.title')}, v)))), '|') AS version FROM mk JOIN heads ON heads.ka = mk.ka AND heads.kt = mk.kt),
lg AS (SELECT *, lag(sec) OVER w AS ps, lag(coalesce(tempo, 0)) OVER w AS pt FROM vr WINDOW w AS (PARTITION BY ka, kt, version ORDER BY sec, seq)),
nw AS (SELECT *, CASE WHEN ps IS NOT NULL AND (NOT {_agrees('pt', 'tempo')} OR (ps > 0 AND sec > 0 AND abs(sec - ps) > greatest(12, 0.08 * greatest(ps, sec), 90))) THEN 1 ELSE 0 END AS nw FROM lg),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY ka, kt, version ORDER BY sec, seq ROWS UNBOUNDED PRECEDING) AS run FROM nw), sg AS (SELECT path, seconds, size, bitrate, first_value(path) OVER (PARTITION BY ka, kt, version, run ORDER BY sec, seq) AS song, count(*) OVER (PARTITION BY ka, kt, version, run) AS n FROM rn)"""


@query("orders", sql=f"WITH {NAMED} SELECT path, song FROM sg WHERE n > 1")
def name_duplicates(orders):
    """Files that are one song by name, tempo and length."""
    return P.groups_by_name(_rows(orders))


@query("orders", sql=f"""WITH {NAMED}, m AS (SELECT *, max(CASE WHEN seconds > 0 THEN seconds END) OVER (PARTITION BY song) - min(CASE WHEN seconds > 0 THEN seconds END) OVER (PARTITION BY song) AS spread FROM sg WHERE n > 1)
SELECT song, path, row_number() OVER (PARTITION BY song ORDER BY CASE WHEN spread > 15 THEN coalesce(seconds, 1e9) ELSE 0 END, bitrate DESC, size DESC, path) = 1 AS keep FROM m""")
def duplicate_keepers(orders):
    """Which copy of each song is kept."""
    r = _rows(orders)
    return P.keepers(P.groups_by_name(r).join(r.select("path", "seconds", F.lit(0).alias("cutoff"), "bitrate", "size"), "path"))


SOUND = f"""fp AS (SELECT vec_id AS path, 100 + (vec_id // 3) * 7 % 400 + (vec_id % 3) * 0.5 AS seconds, list_transform(range(1, 41), lambda k: xor(CAST((vec_id // 3 * 7919 + k * 104729) * 2654435761 % 4294967296 AS BIGINT), CASE WHEN vec_id % 3 = 1 THEN 1 WHEN (vec_id // 3) % 2 = 0 AND vec_id % 3 = 2 THEN 4294967295 - k * 65537 ELSE 0 END)) AS items FROM embeddings)"""


def _fp(embeddings):
    v, third = F.col("vec_id"), F.floor(F.col("vec_id") / 3).cast("long")
    noise = lambda k: F.when(v % 3 == 1, F.lit(1).cast("long")).when((third % 2 == 0) & (v % 3 == 2), F.lit(4294967295) - k * 65537).otherwise(F.lit(0).cast("long"))
    items = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long")), lambda k: (((third * 7919 + k * 104729) * 2654435761) % 4294967296).bitwiseXOR(noise(k)))
    return embeddings.select(v.alias("path"), (F.lit(100) + third * 7 % 400 + (v % 3) * 0.5).alias("seconds"), items.alias("items"))


@query("embeddings", sql=f"""WITH RECURSIVE {SOUND}, e AS (SELECT x.path AS a, y.path AS b FROM fp x JOIN fp y ON x.path < y.path AND abs(x.seconds - y.seconds) <= 2.5 AND x.path // 3 = y.path // 3 WHERE {_ber('x.items', 'y.items', 8, 20)} <= 0.12),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(id, to_) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.to_ = u.a) SELECT id AS path, min(to_) AS song FROM r GROUP BY 1""")
def sound_duplicates(embeddings):
    """Files linked by length and bit error, directly or over others."""
    return P.groups_by_sound(_fp(embeddings))


OPEN = """op AS (SELECT vec_id AS path, CASE WHEN vec_id % 7 = 0 THEN 's' || (vec_id // 50) END AS song, list_transform(range(1, 25), lambda k: xor(CAST((label * 7919 + vec_id // 40 * 31 + k * 104729) * 2654435761 % 4294967296 AS BIGINT), CASE WHEN k > 12 + vec_id % 9 THEN 4042322160 + vec_id * k % 1000 WHEN (vec_id + k) % 5 = 0 THEN 5 ELSE 0 END)) AS items FROM embeddings)"""


@query("embeddings", sql=f"""WITH RECURSIVE {OPEN}, pr AS (SELECT x.path AS a, y.path AS b, list_position(list_append(list_transform(range(1, 25), lambda k: bit_count(xor(x.items[k], y.items[k])) > 6), true), true) - 1 AS run FROM op x JOIN op y ON x.path < y.path AND bit_count(xor(x.items[1], y.items[1])) <= 6), e AS (SELECT * FROM pr WHERE run >= 14),
u AS (SELECT a, b, run FROM e UNION ALL SELECT b, a, run FROM e), r(id, to_) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.to_ = u.a), cc AS (SELECT id, min(to_) AS c FROM r GROUP BY 1), ok AS (SELECT cc.*, count(*) OVER (PARTITION BY c) AS n FROM cc),
md AS (SELECT x.id, x.c, x.n, median(coalesce(u.run, 0)) AS m FROM ok x JOIN ok y ON x.c = y.c AND x.id <> y.id LEFT JOIN u ON u.a = x.id AND u.b = y.id WHERE x.n >= 3 GROUP BY 1, 2, 3), rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY m DESC, id) AS k FROM md) WHERE k = 1),
kept AS (SELECT rep.id AS representative, u.b AS path, u.run FROM rep JOIN u ON u.a = rep.id UNION ALL SELECT id, id, CAST(floor(m) AS BIGINT) FROM rep), s AS (SELECT kept.*, coalesce(op.song, 'p:' || kept.path) AS song FROM kept JOIN op ON op.path = kept.path), g AS (SELECT representative, count(DISTINCT song) AS songs FROM s GROUP BY 1)
SELECT representative, path, CAST(run AS INT) AS run, songs FROM s JOIN g USING (representative) WHERE songs >= 3""")
def opening_clusters(embeddings):
    """Openings that several songs share, by runs of items, with the representative's members only."""
    v = F.col("vec_id")
    noise = lambda k: F.when(k > 12 + v % 9, F.lit(4042322160) + v * k % 1000).when((v + k) % 5 == 0, F.lit(5).cast("long")).otherwise(F.lit(0).cast("long"))
    items = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long")), lambda k: (((F.col("label") * 7919 + F.floor(v / 40) * 31 + k * 104729) * 2654435761) % 4294967296).bitwiseXOR(noise(k)))
    return P.shared_openings(embeddings.select(v.alias("path"), items.alias("items"), F.when(v % 7 == 0, F.concat(F.lit("s"), F.floor(v / 50).cast("string"))).alias("song")))


@query("lineitem", sql="""WITH e AS (SELECT l_orderkey AS path, 3 + l_orderkey % 20 AS nominal, list(l_quantity / 2 + l_linenumber * 0.01) AS ends FROM lineitem GROUP BY 1), c AS (SELECT *, list_filter(ends, lambda x: abs(x - nominal) <= 1.5 AND nominal + 2.5 - x > 0.05) AS near FROM e),
s AS (SELECT path, CASE WHEN len(near) > 0 THEN round(list_sort(list_transform(near, lambda x: {'d': abs(x - nominal), 'e': x}))[1].e, 3) ELSE CAST(nominal AS DOUBLE) END AS cut FROM c)
SELECT path, cut, CASE path % 5 WHEN 0 THEN 7.5 WHEN 1 THEN CASE WHEN cut > 0 AND cut <= 30 AND path % 3 <> 0 AND path % 7 <> 0 THEN cut END END AS confirmed FROM s""")
def opening_cuts(lineitem):
    """Cuts snapped to the nearest end of a silence, and those that somebody confirmed."""
    e = lineitem.groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_list(F.col("l_quantity") / 2 + F.col("l_linenumber") * 0.01).alias("ends"))
    p = F.col("path")
    nominal = (F.lit(3) + p % 20).cast("double")
    d = e.select("path", P.snapped(nominal, F.col("ends"), nominal + 2.5).alias("cut"))
    said = F.when(p % 5 == 0, "7.5").when(p % 5 == 1, "true").when(p % 5 == 2, "false")
    return d.select("path", "cut", P.confirmed_cut(said, F.col("cut"), F.when(p % 3 == 0, "old").otherwise("new"), F.lit("new"), p % 7 == 0).alias("confirmed"))


@query("orders", sql="""WITH l AS (SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 2 = 0), g AS (SELECT o_custkey AS grp, o_orderkey AS path FROM orders), w AS (SELECT o_orderkey AS path, o_orderkey + 1 AS keeper FROM orders WHERE o_orderkey % 7 = 0), c AS (SELECT o_orderkey AS path, floor(o_totalprice / 1000) AS cutoff FROM orders),
b AS (SELECT grp, bool_and(g.path IN (SELECT path FROM l)) AS every, bool_or(w.keeper IS NOT NULL AND w.keeper NOT IN (SELECT path FROM l)) AS safe, list(struct_pack(c := -c.cutoff, p := g.path) ORDER BY c.cutoff DESC, g.path)[1].p AS best FROM g JOIN c ON c.path = g.path LEFT JOIN w ON w.path = g.path GROUP BY 1)
SELECT path FROM l WHERE path NOT IN (SELECT best FROM b WHERE every AND NOT safe)""")
def losers_rescued(orders):
    """Losers of two ways of finding copies, less the best of each group that would lose every member."""
    k = F.col("o_orderkey").alias("path")
    return P.rescue(orders.where("o_orderkey % 3 <> 0 OR o_custkey % 2 = 0").select(k), orders.select(F.col("o_custkey").alias("group"), k), orders.where("o_orderkey % 7 = 0").select(k, (F.col("o_orderkey") + 1).alias("keeper")), orders.select(k, F.floor(F.col("o_totalprice") / 1000).alias("cutoff")))


_WHY = ["", "your note: x", "from your link", "confirmed by you", "clean match"]


@query("orders", sql=f"""WITH r AS (SELECT o_orderkey AS path, {chosen_sql('o_orderkey', _WHY)} AS reasons, (o_custkey % 4) / 4.0 AS confidence, 'A' || o_orderkey AS artist, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Al' END AS album, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) END AS year, o_custkey // 3 AS grp, o_orderkey % 4 = 0 AS keep FROM orders),
k AS (SELECT *, [confidence, CAST(contains(reasons, 'your note') AS INT), CAST(contains(reasons, 'link') OR contains(reasons, 'confirmed') AS INT), CAST(album IS NOT NULL AS INT), CAST(year IS NOT NULL AS INT)] AS rk FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rk DESC, keep DESC, path DESC) AS n, row_number() OVER (PARTITION BY grp, keep ORDER BY path DESC) AS kn, count(*) OVER (PARTITION BY grp) AS c FROM k)
SELECT k.path, CASE WHEN t.grp IS NOT NULL THEN t.confidence ELSE k.confidence END AS confidence, CASE WHEN t.grp IS NOT NULL THEN t.artist ELSE k.artist END AS artist, CASE WHEN t.grp IS NOT NULL THEN t.title ELSE k.title END AS title, CASE WHEN t.grp IS NOT NULL THEN t.album ELSE k.album END AS album, CASE WHEN t.grp IS NOT NULL THEN t.year ELSE k.year END AS year
FROM b k LEFT JOIN (SELECT * FROM b WHERE n = 1 AND c > 1) t ON t.grp = k.grp AND k.keep AND k.kn = 1 AND t.rk > k.rk""")
def keeper_takes_best(orders):
    """Keepers that take over all identity columns of a strictly better copy."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = orders.select(k.alias("path"), chosen("o_orderkey", _WHY).alias("reasons"), ((c % 4) / 4.0).alias("confidence"), F.concat(F.lit("A"), k).alias("artist"), F.col("o_orderpriority").alias("title"), F.when(k % 3 == 0, "Al").alias("album"), F.when(k % 2 == 0, F.year("o_orderdate")).alias("year"), F.lit("r").alias("recording_id"), F.lit("s").alias("source"), F.lit("t").alias("tier"))
    g = orders.select(F.floor(c / 3).alias("group"), k.alias("path"), (k % 4 == 0).alias("keep"))
    return P.inherit(r, g).select("path", "confidence", "artist", "title", "album", "year")


_TT = ["OMG | House | NCS - Copyright Free", "OMG", "Blinded (feat. Kosta & Theo)", "Blinded", "Fade (Remix)", "Fade", "On & On (feat. Daniel Levi)", "Kédo"]
_AA = ["Curbi; Ash O'Connor", "Ash O'Connor, Curbi", "Jim Yosef", "Jim Yosef, Anna Yvette", "Kosta", "", "Kedo Rebelle"]


def _ascii(x):
    return f"lower(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]', '', 'g'))"


def _forms(x):
    bar = f"regexp_replace(coalesce({x}, ''), '\\s*\\|.*$', '')"
    return f"[{_ascii(x)}, {_ascii(bar)}, {_ascii(f'''regexp_replace({bar}, '\\s*[(\\[]?\\b(?:feat|ft)\\b\\.?\\s.*$', '', 'i')''')}]"


def _set(x):
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '(?i)\\s*(?:,|;|&|\\bx\\b|\\bvs\\.?\\b|\\bfeat\\b\\.?|\\bft\\b\\.?|/)\\s*'), lambda y: {_ascii('y')}), lambda y: y <> ''))"


@query("orders", "supplier", sql=f"""WITH t AS (SELECT o_orderkey AS track, {chosen_sql('o_orderkey', _TT)} AS title, {_set(chosen_sql('o_custkey', _AA))} AS s FROM orders), tf AS (SELECT track, title, s, p AS pos, ({_forms('title')})[p] AS form FROM t, (VALUES (1), (2), (3)) AS x(p) WHERE len(s) > 0),
k AS (SELECT DISTINCT r AS record, {chosen_sql('r', _TT)} AS title, {_set(chosen_sql('r // 2', _AA))} AS s FROM (SELECT s_suppkey % 11 AS r FROM supplier)), kf AS (SELECT DISTINCT record, title, s, ({_forms('title')})[p] AS form FROM k, (VALUES (1), (2), (3)) AS x(p)),
h AS (SELECT track, pos, count(DISTINCT record) AS n, min(record) AS record FROM tf JOIN kf ON tf.form = kf.form AND tf.form <> '' WHERE (len(list_filter(kf.s, lambda y: NOT list_contains(tf.s, y))) = 0 OR len(list_filter(tf.s, lambda y: NOT list_contains(kf.s, y))) = 0) AND {_VER.format('tf.title')} = {_VER.format('kf.title')} GROUP BY 1, 2)
SELECT track, arg_min(record, pos) AS record FROM h GROUP BY 1 HAVING arg_min(n, pos) = 1""")
def catalogue_match(orders, supplier):
    """Tracks that exactly one catalogue record matches, by title forms and sets of artists."""
    r = supplier.select((F.col("s_suppkey") % 11).alias("r")).distinct()
    half = F.element_at(F.array(*map(F.lit, _AA)), (F.floor(F.col("r") / 2) % len(_AA) + 1).cast("int"))
    return P.catalogue_match(orders.select(F.col("o_orderkey").alias("track"), chosen("o_custkey", _AA).alias("artist"), chosen("o_orderkey", _TT).alias("title")), r.select(F.col("r").alias("record"), half.alias("artist"), chosen("r", _TT).alias("title")))


@query("part", "lineitem", sql="""WITH one AS (SELECT p_name AS name, min(p_partkey) AS part, count(*) AS n FROM part GROUP BY 1), two AS (SELECT lower(p_brand || '|' || p_type) AS key, max(p_partkey) AS last, min(p_partkey) AS first FROM part GROUP BY 1)
SELECT p.p_partkey, one.part AS only_one, two.last, two.first, (SELECT count(*) FROM lineitem WHERE l_partkey = p.p_partkey) AS uses FROM part p LEFT JOIN one ON one.name = p.p_name AND one.n = 1 LEFT JOIN two ON two.key = lower(p.p_brand || '|' || p.p_type)""")
def computed_key_joins(part, lineitem):
    """Joins on computed keys: keys claimed twice dropped, last and first row of a key, and a fan-out counted."""
    p = part.select("p_partkey", "p_name", "p_brand", "p_type")
    only = P.once(p.select(F.col("p_name"), F.col("p_partkey").alias("only_one")), "p_name")
    right = p.select("p_brand", "p_type", F.col("p_partkey").alias("k"))
    d = P.keyed_join(p, right, "p_brand", "p_type", "k").withColumnRenamed("k", "last").drop("key")
    d = P.keyed_join(d, right, "p_brand", "p_type", "k", first=True).withColumnRenamed("k", "first")
    uses = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("uses"))
    return d.join(only, "p_name", "left").join(uses, "p_partkey", "left").select("p_partkey", "only_one", "last", "first", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"))
