"""Queries on answers of people and on candidates of catalogues: orders stand in for tracks, line items for candidates."""

from __future__ import annotations

import difflib
import re
import unicodedata

from pyspark.sql import functions as F

from sievelake.functions import answers as A
from sievelake.functions import names as N
from sievelake.operators import candidates as C
from sievelake.plans.registry import query
from sievelake.plans.standin import chosen, chosen_sql, sql_text
from sievelake.runtime import broadcast_if_small, cut

ANSWERS = ["y", " DA ", "n", "-", "drop", "Obriši", "redownload", "download again", "https://youtu.be/abcdefghijk (Blackbear is the artist)", "see http://x.org/a, title: Zora; album = Blue", "trim=n", "trim: yes", "trim maybe", "intro=7,5", "intro y", "intro: 31", "artist: Ana; title=Zora | version: live", "year=1999", "version=live", "mood=sad", "same as the one above", "", None, "artist=; title: A", "https://www.youtube.com/results?search_query=a+b%20c", "https://notyoutube.com/results?q=1", "https://duckduckgo.com/?q=zora", "https://duckduckgo.com/", "https://open.spotify.com/track/1", "intro=1e1"]


def _quoted(xs):
    return ", ".join(sql_text(x) for x in xs)


def _field_sql(k):
    pair = "CASE WHEN contains(p, '=') THEN strpos(p, '=') ELSE strpos(p, ':') END"
    return f"list_filter(list_transform(parts, lambda p: CASE WHEN ({pair}) > 0 AND lower(trim(left(p, ({pair}) - 1))) = '{k}' THEN nullif(trim(substr(p, ({pair}) + 1)), '') END), lambda v: v IS NOT NULL)[-1]"


PARSED = f"""an AS (SELECT o_orderkey AS id, {chosen_sql('o_orderkey', ANSWERS)} AS answer FROM orders), h AS (SELECT *, trim(coalesce(answer, '')) AS h, lower(trim(coalesce(answer, ''))) AS low FROM an),
p AS (SELECT *, lower(regexp_extract(h, '^trim\\s*[=:]?\\s*(\\S+)\\s*$', 1, 'i')) AS tr, lower(regexp_extract(h, '^intro\\s*[=:]?\\s*(\\S+)\\s*$', 1, 'i')) AS intro, regexp_split_to_array(h, '\\s*[;|]\\s*') AS parts FROM h),
f AS (SELECT *, try_cast(replace(intro, ',', '.') AS DOUBLE) AS secs, {', '.join(f'{_field_sql(k)} AS f_{k}' for k in A.FIELDS)} FROM p),
k AS (SELECT *, CASE WHEN h = '' THEN NULL WHEN low IN ({_quoted(A.YES)}) THEN 'confirm' WHEN low IN ({_quoted(A.NO)}) THEN 'reject' WHEN low IN ({_quoted(A.DROP)}) THEN 'drop' WHEN low IN ({_quoted(A.REFETCH)}) THEN 'refetch'
  WHEN regexp_matches(h, 'https?://\\S+', 'i') THEN 'url' WHEN tr IN ({_quoted(A.YES + A.NO)}) THEN 'trim' WHEN intro IN ({_quoted(A.YES + A.NO)}) OR (secs > 0 AND secs <= 30) THEN 'intro'
  WHEN coalesce(f_artist, f_title, f_album, f_year, f_version) IS NOT NULL THEN 'override' ELSE 'note' END AS kind FROM f)"""


@query("orders", sql=f"""WITH {PARSED} SELECT id, kind, CASE WHEN kind IN ('url', 'note') THEN h WHEN kind = 'trim' THEN CASE WHEN tr IN ({_quoted(A.YES)}) THEN 'true' ELSE 'false' END
  WHEN kind = 'intro' THEN CASE WHEN intro IN ({_quoted(A.YES)}) THEN 'true' WHEN intro IN ({_quoted(A.NO)}) THEN 'false' ELSE CAST(secs AS VARCHAR) END END AS text,
CASE WHEN kind = 'override' THEN f_artist END AS artist, CASE WHEN kind = 'override' THEN f_title || CASE WHEN f_version IS NOT NULL THEN ' (' || f_version || ')' ELSE '' END END AS title, CASE WHEN kind = 'override' THEN f_album END AS album, CASE WHEN kind = 'override' THEN f_year END AS year FROM k""")
def answer_grammar(orders):
    """Typed answers parsed by the full grammar."""
    return _answers(orders).select("id", A.parse_answer(F.col("answer")).alias("p")).select("id", "p.*")


def _answers(orders):
    return orders.select(F.col("o_orderkey").alias("id"), chosen("o_orderkey", ANSWERS).alias("answer"))


_SEARCH = " OR ".join(f"((host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}'){' AND q <> %s' % sql_text('') if d == 'duckduckgo.com' else ''})" for d, p in A.SEARCH_PAGES)
_URLP = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


@query("orders", sql=f"""WITH {PARSED}, r AS (SELECT id, coalesce(answer, '') AS c, trim(regexp_replace(coalesce(answer, ''), 'https?://\\S+', ' ', 'gi')) AS rest, h FROM k),
u AS (SELECT *, regexp_replace(string_split(lower(regexp_extract(h, '{_URLP}', 1)), ':')[1], '^www\\.', '') AS host, regexp_extract(h, '{_URLP}', 2) AS path, regexp_extract(regexp_extract(h, '{_URLP}', 3), '(?:^|&)q=([^&]*)', 1) AS q FROM r)
SELECT id, CASE WHEN regexp_matches(h, '^https?://', 'i') THEN CASE WHEN {_SEARCH} THEN 'search' WHEN regexp_matches(host || path, '{A.TRACK_PAGE.replace("(?i)", "")}', 'i') THEN 'track' ELSE 'other-url' END ELSE 'text' END AS kind,
CASE WHEN regexp_matches(c, '{A.VIDEO}') THEN regexp_extract(c, '{A.VIDEO}', 1) WHEN contains(c, 'search_query=') THEN 'ytsearch1:' || url_decode(replace(regexp_extract(c, 'search_query=([^&\\s]+)', 1), '+', ' ')) ELSE regexp_replace(nullif(regexp_extract(c, 'https?://\\S+', 0), ''), '[.,;)]+$', '') END AS key,
coalesce(nullif(regexp_extract(rest, '\\(?\\s*([^()]{{2,60}}?)\\s+is\\s+the\\s+artist', 1, 'i'), ''), nullif(trim(regexp_extract(rest, '\\bartist\\s*[:=]\\s*([^;|)\\n]{{2,60}})', 1, 'i')), '')) AS artist,
nullif(trim(regexp_extract(rest, '\\btitle\\s*[:=]\\s*([^;|)\\n]{{2,60}})', 1, 'i')), '') AS title, nullif(trim(regexp_extract(rest, '\\balbum\\s*[:=]\\s*([^;|)\\n]{{2,60}})', 1, 'i')), '') AS album FROM u""")
def answer_links(orders):
    """Links in answers: their kind, the key they are filed under, what is noted beside them."""
    n = A.note_fields(F.col("answer"))
    return _answers(orders).select("id", A.link_kind(F.col("answer")).alias("kind"), A.link_key(F.col("answer")).alias("key"), n["artist"].alias("artist"), n["title"].alias("title"), n["album"].alias("album"))


_KEPT = f"""{PARSED}, m AS (SELECT 'f' || (id % 97) AS file, answer, id AS seq, kind FROM k WHERE kind IS NOT NULL), top AS (SELECT file, arg_max(answer, CASE WHEN kind = 'note' THEN 0 ELSE 10000000000 END + seq) AS answer FROM m GROUP BY file)"""


def _kept(orders):
    return A.merge_answers(_answers(orders).select(F.concat(F.lit("f"), F.col("id") % 97).alias("file"), "answer", F.col("id").alias("seq")))


@query("orders", "part", sql=f"""WITH {_KEPT}, l AS (SELECT 'f' || (p_partkey % 120) AS file, min(p_name) AS link FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT coalesce(top.file, l.file) AS file, coalesce(answer, '') AS answer, coalesce(link, '') AS link FROM top FULL JOIN l ON top.file = l.file""")
def durable_answers(orders, part):
    """Everything ever answered: the last answer of a file, notes never over answers, beside its link."""
    links = part.where("p_partkey % 3 = 0").groupBy(F.concat(F.lit("f"), F.col("p_partkey") % 120).alias("file")).agg(F.min("p_name").alias("link"))
    return A.durable_answers(_kept(orders), links)


@query("orders", sql=f"""WITH {PARSED} SELECT id AS file, kind, CASE WHEN kind = 'trim' THEN CASE WHEN tr IN ({_quoted(A.YES)}) THEN 'true' ELSE 'false' END WHEN intro IN ({_quoted(A.YES)}) THEN 'true' WHEN intro IN ({_quoted(A.NO)}) THEN 'false' ELSE CAST(secs AS VARCHAR) END AS value FROM k WHERE kind IN ('trim', 'intro')""")
def typed_answers(orders):
    """Answers to the two questions about cuts."""
    d = _answers(orders).withColumnRenamed("id", "file")
    return A.typed_answers(d, "trim").withColumn("kind", F.lit("trim")).unionByName(A.typed_answers(d, "intro").withColumn("kind", F.lit("intro")))


# ------------------------------------------------------------------ candidates

WANT = [("Arctic Monkeys", "Do I Wanna Know?"), ("", "Zbog mene ne placi"), ("Prljavo Kazaliste", "Zbog mene ne plači"), ("Bad Habits", "Ed Sheeran"), ("Ana", "Lomi (feat. DJ Buka)"), (None, "Bad Habits (with Bring Me The Horizon)"), ("Nobody", "")]
FOUND = [("Arctic Monkeys", "Do I Wanna Know"), ("Prljavo kazalište", "Zbog mene ne placi"), ("Ed Sheeran", "Bad Habits"), ("DJ Buka", "Lomi"), ("Various", "Hits 2001"), ("Bring Me The Horizon", "Bad Habits"), ("", None)]
TRUST = ["filename", "weak", "tag", "description", "override", "unknown"]
ALBUMS = ["AM", "Promo Only: Modern Rock Radio", "2014-08-23: Live at Reading", "Greatest Hits", "Vol. 3", "Blue", None]
KINDS = ["Album", "EP", "Single", "Compilation", "Live", "Broadcast", None, "Odd"]
CREDIT = [["various artists"], ["arctic monkeys"], ["ana"], []]


def _plain(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", s.lower()).strip()


def _ratio(a, b):
    a, b = _plain(a), _plain(b)
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _fit_row(want, found):
    """Best of a wanted pair's readings against a found one, from the definition."""
    (a, t), (fa, ft) = want, found
    readings = [(a, t)] + ([(t, a)] if a and t else []) + [(x.strip(" ()[]"), t) for x in re.findall(r"(?:feat\.?|ft\.?|featuring|with)\s+([^()\[\]]+)", t or "", re.I)]
    best = (-1.0, 0.0, 0.0)
    for ra, rt in readings:
        aa = _ratio(ra, fa) if ra else 0.0
        tt = _ratio(rt, ft) if rt else 0.0
        f = 0.4 * aa + 0.6 * tt if ra else tt
        if f > best[0]:
            best = (f, aa, tt)
    return best


FITS = ", ".join(f"({i}, {j}, {f!r}, {a!r}, {t!r})" for i, w in enumerate(WANT) for j, g in enumerate(FOUND) for f, a, t in [_fit_row(w, g)])
CAND = f"""fits AS (SELECT * FROM (VALUES {FITS}) AS x(i, j, fit, asim, tsim)), cand AS (SELECT l_orderkey AS track, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS pos, CAST(l_orderkey % {len(WANT)} AS INT) AS i, CAST(l_partkey % {len(FOUND)} AS INT) AS j, round(l_discount * 10, 3) AS heard,
  {chosen_sql('l_orderkey', TRUST)} AS trust, l_suppkey FROM lineitem), scored AS (SELECT c.*, CAST(fit AS DOUBLE) AS fit, CAST(asim AS DOUBLE) AS asim, CAST(tsim AS DOUBLE) AS tsim FROM cand c JOIN fits USING (i, j))"""
_W = "CASE trust " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.NAME_WEIGHT.items()) + " ELSE 0.65 END"


def _candidates(lineitem):
    i, j = F.col("l_orderkey") % len(WANT), F.col("l_partkey") % len(FOUND)
    at = lambda k, rows, c: F.element_at(F.array(*[F.lit(r[c]) for r in rows]), (k + 1).cast("int"))
    return lineitem.select(F.col("l_orderkey").alias("track"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("pos"), at(i, WANT, 0).alias("wa"), at(i, WANT, 1).alias("wt"), at(j, FOUND, 0).alias("fa"), at(j, FOUND, 1).alias("ft"), F.round(F.col("l_discount") * 10, 3).alias("heard"), chosen("l_orderkey", TRUST).alias("trust"), "l_suppkey")


def _fitted(lineitem):
    """Candidates with their fits. Each pair of names is compared once, not each candidate."""
    d = _candidates(lineitem)
    pairs = C.with_name_fit(d.select("wa", "wt", "fa", "ft").distinct(), "wa", "wt", ["fa"], "ft")
    pairs = broadcast_if_small(cut(pairs.select(*[F.col(c).alias(f"_{c}") for c in ("wa", "wt", "fa", "ft")], "f")))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("wa", "wt", "fa", "ft")]
    return d.join(pairs, on).drop("_wa", "_wt", "_fa", "_ft")


@query("lineitem", sql=f"""WITH {CAND} SELECT id, round(asim, 6) AS artist_similarity, round(tsim, 6) AS title_similarity, round(CASE WHEN i = {len(WANT) - 1} THEN heard ELSE (1 - {_W}) * heard + {_W} * fit END, 6) AS combined,
round(CASE WHEN id % 3 = 0 THEN fit ELSE 0.3 * heard + 0.7 * fit END, 6) AS searched FROM scored""")
def candidate_scores(lineitem):
    """Scores of candidates found by sound and by text, from the best reading of the name."""
    d = _fitted(lineitem)
    heard, fit = F.col("heard"), F.col("f.fit")
    return d.select("id", F.round("f.artist_similarity", 6).alias("artist_similarity"), F.round("f.title_similarity", 6).alias("title_similarity"), F.round(C.heard_score(heard, fit, F.col("wt"), F.col("trust")), 6).alias("combined"), F.round(C.searched_score(F.when(F.col("id") % 3 != 0, heard), fit), 6).alias("searched"))


@query("lineitem", sql=f"""WITH {CAND}, s AS (SELECT track, pos, CASE WHEN pos % 2 = 0 THEN 'discogs' ELSE 'musicbrainz' END AS source, round(CASE WHEN pos % 2 = 0 THEN fit ELSE 0.3 * heard + 0.7 * fit END, 3) AS c FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY track, source ORDER BY c DESC, pos) AS n FROM s), b AS (SELECT * FROM r WHERE n = 1)
SELECT track, arg_max(source, c * 10 + CASE source WHEN 'musicbrainz' THEN 0.0001 ELSE 0 END) AS source, max(c) AS combined FROM b GROUP BY track""")
def best_source(lineitem):
    """The better of two sources' best candidates; of equal ones that of the first source."""
    d = _fitted(lineitem)
    second = F.col("pos") % 2 == 0
    s = d.select("track", "pos", F.when(second, "discogs").otherwise("musicbrainz").alias("source"), F.round(C.searched_score(F.when(~second, F.col("heard")), F.col("f.fit")), 3).alias("c"))
    b = s.groupBy("track", "source").agg(F.max("c").alias("c"))
    return b.groupBy("track").agg(F.max_by("source", F.struct("c", (F.col("source") == "musicbrainz").alias("m"))).alias("source"), F.max("c").alias("combined"))


_HINT = C.COMPILATION.replace("(?i)", "").replace("'", "''")
_TYPE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.TYPE_RANK.items()) + " ELSE 7 END"
_LISTS = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in c) + "]" for c in CREDIT) + "]"


@query("lineitem", sql=f"""WITH g AS (SELECT l_orderkey AS track, l_partkey * 10 + l_linenumber AS pos, {chosen_sql('l_partkey', ALBUMS)} AS album, {chosen_sql('l_suppkey', KINDS)} AS kind, l_returnflag = 'R' AS secondary, CAST({_LISTS} AS VARCHAR[][])[CAST(l_partkey % 4 AS INT) + 1] AS credit, year(l_shipdate) AS y FROM lineitem),
r AS (SELECT *, {_TYPE} + CASE WHEN secondary THEN 4 ELSE 0 END + CASE WHEN list_contains(credit, 'various artists') THEN 4 WHEN len(credit) > 0 AND NOT list_contains(credit, 'arctic monkeys') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(coalesce(album, ''), '{_HINT}', 'i') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(coalesce(album, ''), '{C.BOOTLEG}') THEN 6 ELSE 0 END AS rank FROM g)
SELECT track, album, rank, y AS year FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY rank, y, pos) AS n FROM r) WHERE n = 1""")
def release_choice(lineitem):
    """The release group a track is from: least rank with all penalties, then the earliest year."""
    credit = F.element_at(F.array(*[F.array(*map(F.lit, c)).cast("array<string>") for c in CREDIT]), (F.col("l_partkey") % 4 + 1).cast("int"))
    d = lineitem.select(F.col("l_orderkey").alias("track"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), chosen("l_partkey", ALBUMS).alias("album"), chosen("l_suppkey", KINDS).alias("kind"), (F.col("l_returnflag") == "R").alias("secondary"), credit.alias("credit"), F.year("l_shipdate").alias("year"))
    d = d.withColumn("rank", C.release_rank(F.col("kind"), F.col("secondary"), F.col("credit"), F.array(F.lit("arctic monkeys")), F.col("album")))
    return d.groupBy("track").agg(F.min_by(F.struct("album", "rank", "year"), F.struct("rank", "year", "pos")).alias("b")).select("track", "b.*")


def _lowered(x):
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


@query("lineitem", sql=f"""WITH {CAND}, n AS (SELECT track, pos, {_lowered(f"list_extract([{', '.join(sql_text(w[0]) for w in WANT)}], i + 1)")} AS wa, {_lowered(f"list_extract([{', '.join(sql_text(w[1]) for w in WANT)}], i + 1)")} AS wt, {_lowered(f"list_extract([{', '.join(sql_text(w[0]) for w in FOUND)}], j + 1)")} AS fa, {_lowered(f"list_extract([{', '.join(sql_text(w[1]) for w in FOUND)}], j + 1)")} AS ft FROM cand WHERE pos < 5)
SELECT track, min(pos) AS value FROM n WHERE wa <> '' AND wt <> '' AND (contains(fa, wa) OR contains(wa, fa)) AND (contains(ft, wt) OR contains(wt, ft)) GROUP BY track""")
def first_confirmed(lineitem):
    """The first of five candidates whose artist and title lie within the wanted ones or the other way round."""
    n = N.norm_identity
    d = _candidates(lineitem)
    return C.first_confirmed(d, "track", "pos", C.mutual(n(F.col("wa")), n(F.col("fa"))) & C.mutual(n(F.col("wt")), n(F.col("ft"))), F.col("pos"))


CONF = ["Animals", "Animals (Balkanik Remix)", "Zora (Live)", "Zora", "Honey feat. Ana", "Other song"]
PEOPLE = ["Ana", "Balkanik", "Ana & Iva", "Zed"]
SOURCES, STAGES = ["ytmusic", "deezer", "itunes"], ["direct", "direct", "cleaned", "title"]


def _agree(w, g):
    return f"CASE WHEN {w} = {g} THEN 1.0 WHEN contains({w}, {g}) OR contains({g}, {w}) THEN 0.85 ELSE len(list_intersect(string_split({w}, ' '), string_split({g}, ' '))) / CAST(len(list_distinct(list_concat(string_split({w}, ' '), string_split({g}, ' ')))) AS DOUBLE) END"


def _roman(x):
    for a, b in N.ROMANISED:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _fit(w, g):
    return f"CASE WHEN {w} = '' OR {g} = '' THEN 0 WHEN {_agree(w, g)} < 0.5 THEN greatest({_agree(w, g)}, {_agree(_roman(w), _roman(g))}) ELSE {_agree(w, g)} END"


def _ver(x):
    return f"list_distinct(list_transform(regexp_extract_all(lower({x}), '\\b({N.VERSION})\\b', 1), lambda y: regexp_replace(y, '[.\\s]', '', 'g')))"


@query("orders", "lineitem", sql=f"""WITH asked AS (SELECT o_orderkey AS track, {chosen_sql('o_orderkey', PEOPLE)} AS wa, {chosen_sql('o_orderkey', CONF)} AS wt, 100 + o_orderkey % 60 AS wd FROM orders),
ans AS (SELECT l_orderkey AS track, {chosen_sql('l_suppkey', STAGES)} AS stage, {chosen_sql('l_partkey', SOURCES)} AS source, l_linenumber AS pos, {chosen_sql('l_partkey', PEOPLE)} AS artist, {chosen_sql('l_suppkey', CONF)} AS title, 100 + l_partkey % 60 AS duration, l_discount >= 0.09 AS failed FROM lineitem),
j AS (SELECT *, {_lowered('wa')} AS nwa, {_lowered('wt')} AS nwt, {_lowered('artist')} AS na, {_lowered('title')} AS nt, {_lowered("artist || ' ' || title")} AS nall FROM ans JOIN asked USING (track)),
f AS (SELECT *, {_fit('nwa', 'na')} AS fa, {_fit('nwt', 'nt')} AS ft, CASE stage WHEN 'direct' THEN 0 WHEN 'cleaned' THEN 1 ELSE 2 END AS s FROM j),
ok AS (SELECT *, row_number() OVER (PARTITION BY track, s, source ORDER BY CASE WHEN s = 2 THEN 0 ELSE fa + ft END DESC, CASE WHEN s = 2 THEN 0 ELSE abs(wd - duration) END, pos) AS n FROM f WHERE NOT failed AND CASE WHEN s = 2 THEN ft >= 0.8 AND contains(nall, nwa) ELSE fa >= 0.6 AND ft >= 0.6 END),
h AS (SELECT * FROM ok WHERE n = 1), two AS (SELECT track, s, count(*) FILTER (source <> 'itunes') AS c FROM h GROUP BY 1, 2), h2 AS (SELECT h.* FROM h JOIN two USING (track, s) WHERE source <> 'itunes' OR (c < 2 AND s = 0)),
st AS (SELECT track, min(s) AS s FROM h2 GROUP BY 1), h3 AS (SELECT h2.* FROM h2 JOIN st USING (track, s) WHERE list_sort({_ver('wt')}) = list_sort({_ver('title')})),
g AS (SELECT track, count(*) AS n, string_agg(source, '+' ORDER BY source) AS sources, arg_max(artist, CASE source WHEN 'deezer' THEN 3 WHEN 'itunes' THEN 2 ELSE 1 END) AS artist, arg_max(title, CASE source WHEN 'deezer' THEN 3 WHEN 'itunes' THEN 2 ELSE 1 END) AS title, max(s) AS s FROM h3 GROUP BY 1)
SELECT track, CASE WHEN coalesce(n, 0) >= 2 THEN 'A' WHEN n = 1 THEN 'B' ELSE 'C' END AS grade, CAST(CASE WHEN coalesce(n, 0) >= 2 THEN 0.9 WHEN n = 1 THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence, coalesce(sources, '') AS sources,
CASE WHEN n IS NULL THEN 'nothing found' WHEN s = 0 THEN 'direct' WHEN s = 1 THEN 'cleaned query' ELSE 'title only, artist found in credit' END AS how, artist, title, coalesce(n, 0) < 2 AND track IN (SELECT track FROM ans WHERE failed) AS limited FROM asked LEFT JOIN g USING (track)""")
def catalogue_cascade(orders, lineitem):
    """Corroboration of a name by catalogues in stages, with grade, confidence, how, and whether an outage limits it."""
    asked = orders.select(F.col("o_orderkey").alias("track"), chosen("o_orderkey", PEOPLE).alias("artist"), chosen("o_orderkey", CONF).alias("title"), (F.lit(100) + F.col("o_orderkey") % 60).cast("double").alias("duration"))
    answers = lineitem.select(F.col("l_orderkey").alias("track"), chosen("l_suppkey", STAGES).alias("stage"), chosen("l_partkey", SOURCES).alias("source"), F.col("l_linenumber").alias("pos"), chosen("l_partkey", PEOPLE).alias("artist"), chosen("l_suppkey", CONF).alias("title"), (F.lit(100) + F.col("l_partkey") % 60).cast("double").alias("duration"), (F.col("l_discount") >= 0.09).alias("failed"))
    return C.corroborate(asked, answers)


SOURCE_OF = ["discogs", "web:deezer+itunes", "acoustid", None, "web:deezer"]
RTYPES = ["Album", "Live", None, "EP", "Broadcast"]
JUDGE = f"""e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 = 0 THEN 'timeout' END AS error, o_orderkey % 11 <> 0 AS matched, o_orderkey % 2 AS n_results, (o_custkey % 101) / CAST(101 AS DOUBLE) AS combined, (o_custkey % 7) / 6.0 AS asim, (o_custkey % 5) / 4.0 AS tsim,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 10) / 10.0 END AS heard, CASE WHEN o_orderkey % 4 <> 0 THEN 'x' END AS pa, CASE WHEN o_orderkey % 5 <> 0 THEN 'y' END AS pt, {chosen_sql('o_orderkey', SOURCE_OF)} AS source, o_orderkey % 6 <> 0 AS release, {chosen_sql('o_custkey', RTYPES)} AS rtype, o_custkey % 20 AS nc FROM orders)"""


@query("orders", sql=f"""WITH {JUDGE}, r AS (SELECT *, coalesce(source LIKE 'web:%+%', false) AS web FROM e), x AS (SELECT *, combined * CASE WHEN pa IS NULL THEN 0.85 WHEN asim < 0.5 THEN 0.55 ELSE 1 END * CASE WHEN tsim < 0.6 AND pt IS NOT NULL THEN 0.7 ELSE 1 END * CASE WHEN heard IS NULL AND NOT web THEN 0.9 WHEN heard < 0.8 THEN 0.9 ELSE 1 END * CASE WHEN NOT release THEN 0.95 ELSE 1 END AS conf,
list_filter([CASE WHEN pa IS NULL THEN 'filename has no artist to corroborate' WHEN asim < 0.5 THEN 'artist mismatch vs filename (similarity ' || printf('%.2f', CAST(asim AS DOUBLE)) || ')' END, CASE WHEN tsim < 0.6 AND pt IS NOT NULL THEN 'title differs from filename (similarity ' || printf('%.2f', CAST(tsim AS DOUBLE)) || ')' END,
CASE WHEN heard IS NULL AND web THEN 'corroborated by ' || replace(substr(source, 5), '+', ' and ') WHEN heard IS NULL THEN 'name-only match via ' || coalesce(source, 'text search') || ', no audio confirmation' WHEN heard < 0.8 THEN 'weak fingerprint score (' || printf('%.2f', CAST(heard AS DOUBLE)) || ')' END,
CASE WHEN NOT release THEN 'no album/year resolved' WHEN rtype IN ('Live', 'Broadcast') THEN 'album is a ' || rtype || ', may not be the original release' END, CASE WHEN nc > 12 THEN nc || ' competing candidates' END], lambda y: y IS NOT NULL) AS why FROM r)
SELECT id, CAST(round(CASE WHEN error IS NOT NULL OR NOT matched THEN 0 ELSE greatest(0, least(1, conf)) END, 6) AS DOUBLE) AS confidence, CASE WHEN error IS NOT NULL THEN 'lookup error: ' || error WHEN NOT matched AND n_results > 0 THEN 'fingerprint found but no usable recording metadata' WHEN NOT matched THEN 'no acoustic fingerprint match' WHEN len(why) = 0 THEN 'clean match' ELSE array_to_string(why, '; ') END AS why FROM x""")
def proposal_confidence(orders):
    """Confidence of a proposal by all its multipliers, with reasons."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    conf, why = C.judged({"error": F.when(k % 23 == 0, "timeout"), "matched": k % 11 != 0, "n_results": k % 2, "combined": (c % 101) / 101.0, "artist_similarity": (c % 7) / 6.0, "title_similarity": (c % 5) / 4.0, "heard": F.when(k % 3 != 0, (k % 10) / 10.0), "parsed_artist": F.when(k % 4 != 0, "x"), "parsed_title": F.when(k % 5 != 0, "y"), "source": chosen("o_orderkey", SOURCE_OF), "release": k % 6 != 0, "release_type": chosen("o_custkey", RTYPES), "n_candidates": c % 20})
    return orders.select(k.alias("id"), F.round(conf, 6).alias("confidence"), F.array_join(why, "; ").alias("why"))


OLD = [("EDEN", "circles"), ("Ensemble Pittoresque", "Ontwaakt"), ("Elitni Odredi", "Gospoda"), ("", ""), ("Beyoncé", "Halo (Live)")]
NEW = [("Eden", "Circles"), ("Mile Kitic", "Sampion"), ("Gospoda", "Gospoda"), ("Beyonce", "Halo live")]
_SAME = ", ".join(str(_plain(" ".join(o)) != "" and _ratio(" ".join(o), " ".join(n)) >= 0.92).lower() for o in OLD for n in NEW)
KIND = ["confirm", "reject", "url", "override", "note", None]


@query("orders", sql=f"""WITH o AS (SELECT o_orderkey AS id, {chosen_sql('o_orderkey', KIND)} AS kind, nullif({chosen_sql('o_custkey', [x[0] for x in OLD])}, '') AS oa, nullif({chosen_sql('o_custkey', [x[1] for x in OLD])}, '') AS ot, {chosen_sql('o_orderkey // 6', [x[0] for x in NEW])} AS na, {chosen_sql('o_orderkey // 6', [x[1] for x in NEW])} AS nt,
  list_extract([{_SAME}], CAST(o_custkey % 5 AS INT) * 4 + CAST((o_orderkey // 6) % 4 AS INT) + 1) AS same, o_custkey % 3 = 0 AS searched, o_custkey % 4 <> 0 AS has_link, CASE WHEN o_custkey % 7 = 0 THEN 'r9' WHEN o_custkey % 7 = 1 THEN 'r1' END AS link_id, 'r1' AS rid FROM orders),
s AS (SELECT *, kind = 'url' AND has_link AS linked, same AND NOT (kind = 'url' AND has_link AND link_id IS NOT NULL AND link_id <> rid) AS kept FROM o)
SELECT id, CAST(CASE WHEN (kind = 'confirm' AND oa IS NOT NULL) OR kind = 'override' THEN 1 WHEN kind = 'reject' THEN 0 WHEN linked THEN CASE WHEN searched THEN 0.85 ELSE 1 END ELSE 0.6 END AS DOUBLE) AS confidence,
CASE WHEN kind = 'reject' THEN NULL WHEN linked OR kind = 'override' THEN na ELSE oa END AS artist, CASE WHEN kind = 'reject' THEN NULL WHEN linked OR kind = 'override' THEN nt ELSE ot END AS title,
CASE WHEN kind = 'reject' THEN NULL WHEN linked THEN coalesce(link_id, CASE WHEN kept THEN rid END) WHEN kind = 'override' THEN CASE WHEN kept THEN rid END ELSE rid END AS recording_id, CASE WHEN kind = 'reject' THEN NULL WHEN linked OR kind = 'override' THEN CASE WHEN kept THEN 'Blue' END ELSE 'Blue' END AS album,
CASE WHEN kind = 'confirm' AND oa IS NOT NULL THEN 'confirmed by you' WHEN kind = 'reject' THEN 'rejected by you' WHEN linked THEN CASE WHEN searched THEN 'from a search you pasted' ELSE 'from your link' END WHEN kind = 'url' THEN 'link not resolved yet' WHEN kind = 'override' THEN 'set by you' WHEN kind = 'note' THEN 'your note' END AS why,
CASE WHEN kind = 'reject' THEN 'unmatched' WHEN kind IN ('confirm', 'override') OR (linked AND NOT searched) THEN 'auto' WHEN kind IS NOT NULL THEN 'hinted' WHEN oa IS NULL THEN 'unmatched' ELSE 'review' END AS tier FROM s""")
def answer_override(orders):
    """A person's answer laid over a proposal: what it replaces, what it keeps, and the tier that results."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = F.floor(k / 6)
    at = lambda key, rows, j: F.element_at(F.array(*[F.lit(r[j]) for r in rows]), (key % len(rows) + 1).cast("int"))
    d = orders.select(k.alias("id"), chosen("o_orderkey", KIND).alias("kind"), F.nullif(at(c, OLD, 0), F.lit("")).alias("oa"), F.nullif(at(c, OLD, 1), F.lit("")).alias("ot"), at(n, NEW, 0).alias("na"), at(n, NEW, 1).alias("nt"), (c % 3 == 0).alias("searched"), (c % 4 != 0).alias("has"), F.when(c % 7 == 0, "r9").when(c % 7 == 1, "r1").alias("lid"))
    kind, url, typed = F.col("kind"), F.col("kind") == "url", F.col("kind") == "override"
    d = d.withColumn("same", C.same_recording(F.col("oa"), F.col("ot"), F.col("na"), F.col("nt")))
    linked = url & F.col("has")
    out = C.answered(kind, {"confidence": F.lit(0.6), "artist": F.col("oa"), "title": F.col("ot"), "recording_id": F.lit("r1"), "album": F.lit("Blue"), "said_artist": F.when(typed, F.col("na")), "said_title": F.when(typed, F.col("nt")), "said_album": F.lit(None).cast("string"), "link_artist": F.when(linked, F.col("na")), "link_title": F.when(linked, F.col("nt")), "link_id": F.when(linked, F.col("lid")), "link_album": F.lit(None).cast("string"), "from_search": F.col("searched"), "respelled": F.col("same")})
    return d.select("id", *[v.alias(x) for x, v in out.items()], C.tier(kind, out["confidence"], F.col("oa").isNotNull(), kind.isNotNull()).alias("tier"))


STATUS = ["musicbrainz-confirmed", "unsplittable", "no-match", None]


@query("orders", sql=f"""WITH t AS (SELECT o_orderkey AS track, o_custkey AS c FROM orders), h AS (SELECT track, 'H' AS artist, 'h' AS title, (c % 90) / 100.0 AS combined, 'acoustid' AS source FROM t WHERE track % 2 = 0), x AS (SELECT track, 'X' AS artist, 'x' AS title, (c % 80) / 100.0 AS combined, 'discogs' AS source FROM t WHERE track % 3 = 0),
n AS (SELECT track, 'N' AS artist, 'n' AS title, {chosen_sql('track', STATUS)} AS status FROM t WHERE track % 5 <> 0), w AS (SELECT track, 'W' AS artist, 'w' AS title, substr('ABC', CAST(c % 3 AS INT) + 1, 1) AS grade, CAST([0.9, 0.8, 0.7][CAST(c % 3 AS INT) + 1] AS DOUBLE) AS confidence, 'deezer' AS sources FROM t WHERE track % 7 < 5),
b AS (SELECT t.track, CASE WHEN h.track IS NOT NULL THEN h.artist WHEN x.track IS NOT NULL THEN x.artist WHEN n.status <> 'unsplittable' THEN n.artist END AS artist, CASE WHEN h.track IS NOT NULL THEN h.title WHEN x.track IS NOT NULL THEN x.title WHEN n.status <> 'unsplittable' THEN n.title END AS title,
  CAST(CASE WHEN h.track IS NOT NULL THEN h.combined WHEN x.track IS NOT NULL THEN x.combined WHEN n.status = 'musicbrainz-confirmed' THEN 0.95 WHEN n.status <> 'unsplittable' THEN 0.7 END AS DOUBLE) AS combined, CASE WHEN h.track IS NOT NULL THEN h.source WHEN x.track IS NOT NULL THEN x.source WHEN n.status = 'musicbrainz-confirmed' THEN 'filename+musicbrainz' WHEN n.status <> 'unsplittable' THEN 'filename-only' END AS source,
  w.grade, w.confidence FROM t LEFT JOIN h USING (track) LEFT JOIN x ON x.track = t.track LEFT JOIN n ON n.track = t.track LEFT JOIN w ON w.track = t.track)
SELECT track, CASE WHEN up THEN 'W' ELSE artist END AS artist, CASE WHEN up THEN 'w' ELSE title END AS title, CASE WHEN up THEN confidence ELSE combined END AS combined, CASE WHEN up THEN 'web:deezer' ELSE source END AS source FROM (SELECT *, coalesce(grade <> 'C' AND coalesce(combined, 0) < confidence, false) AS up FROM b)""")
def proposal_merge(orders):
    """One proposal a track from sound, text, file name and web."""
    t = orders.select(F.col("o_orderkey").alias("track"), F.col("o_custkey").alias("c"))
    named = lambda d, a, *more: d.select("track", F.lit(a.upper()).alias("artist"), F.lit(a).alias("title"), *more)
    heard = named(t.where("track % 2 = 0"), "h", ((F.col("c") % 90) / 100.0).alias("combined"), F.lit("acoustid").alias("source"))
    text = named(t.where("track % 3 = 0"), "x", ((F.col("c") % 80) / 100.0).alias("combined"), F.lit("discogs").alias("source"))
    files = named(t.where("track % 5 <> 0"), "n", chosen("track", STATUS).alias("status"))
    web = named(t.where("track % 7 < 5"), "w", chosen("c", ["A", "B", "C"]).alias("grade"), chosen("c", [0.9, 0.8, 0.7]).alias("confidence"), F.lit("deezer").alias("sources"))
    return C.proposal(t, heard, text, files, web)
