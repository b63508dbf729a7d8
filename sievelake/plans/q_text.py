"""Queries on names, titles and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import text as T
from sievelake.plans.registry import query


def sql_fold(c: str) -> str:
    out = f"translate(lower({c}), '{T.ACCENTED}', '{T.PLAIN}')"
    for a, b in T.LIGATURES:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def sql_norm(c: str) -> str:
    return f"trim(regexp_replace({sql_fold(c)}, '[^a-z0-9]+', ' ', 'g'))"


@query("documents", sql=f"SELECT doc_id, md5({sql_norm('text')}) AS norm_md5, length({sql_norm('text')}) AS norm_chars FROM documents")
def text_norm(documents):
    n = T.norm(F.col("text"))
    return documents.select("doc_id", F.md5(n.cast("binary")).alias("norm_md5"), F.length(n).cast("long").alias("norm_chars"))


@query("documents", sql=f"SELECT doc_id, md5(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) AS skeleton_md5, CASE WHEN {sql_fold('text')} <> lower(text) THEN md5({sql_fold('text')}) END AS plain_md5 FROM documents")
def skeleton_deaccent(documents):
    plain = T.deaccent(F.col("text"))
    return documents.select("doc_id", F.md5(T.skeleton(F.col("text")).cast("binary")).alias("skeleton_md5"), F.when(plain != F.lower("text"), F.md5(plain.cast("binary"))).alias("plain_md5"))


STEM = "p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' - ' || p_name END || CASE WHEN p_size % 2 = 0 THEN ' - ' || p_type ELSE '' END || CASE p_size % 4 WHEN 0 THEN ' (Official Video)' WHEN 1 THEN ' [HD] (lyrics)' ELSE '' END"
_STRIP = r"(?i)\s*[(\[](official[^)\]]*|lyrics?|hd|hq|audio|video)[)\]]\s*$"


def sql_strip(c: str, rounds: int = 4) -> str:
    for _ in range(rounds):
        c = f"regexp_replace({c}, '{_STRIP}', '')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query("part", sql=rf"""WITH s AS (SELECT p_partkey, string_split_regex({sql_strip(STEM)}, '\s+[-–—]\s+') AS p FROM part)
SELECT p_partkey, CASE WHEN len(p) > 1 THEN p[1] END AS artist, CASE WHEN len(p) > 1 THEN array_to_string(p[2:], ' - ') ELSE p[1] END AS title FROM s""")
def filename_split(part):
    artist, title = T.split_name(F.expr(STEM))
    return part.select("p_partkey", artist.alias("artist"), title.alias("title"))


CREDIT = "p_name || CASE p_size % 5 WHEN 0 THEN ' feat. ' WHEN 1 THEN ' & ' WHEN 2 THEN '; ' WHEN 3 THEN ' x ' ELSE ', ' END || p_brand || CASE WHEN p_size % 2 = 0 THEN ' ft ' || p_type ELSE ',' END"


@query("part", sql=rf"""WITH s AS (SELECT p_partkey, list_filter(list_transform(string_split_regex({CREDIT}, '(?i)\s*(?:;|,|\s&\s|\sx\s|\s(?:feat|ft|featuring)\.?\s)\s*'), lambda x: trim(x)), lambda x: x <> '') AS c FROM part)
SELECT p_partkey, CAST(i AS BIGINT) AS pos, c[i] AS name, len(c) AS n FROM s, unnest(range(1, len(c) + 1)) AS u(i)""")
def split_credit_explode(part):
    c = part.select("p_partkey", T.credits(F.expr(CREDIT)).alias("c"))
    return c.select("p_partkey", F.size("c").cast("long").alias("n"), F.posexplode("c").alias("pos", "name")).select("p_partkey", (F.col("pos") + 1).cast("long").alias("pos"), "name", "n")


TITLES = "p_name || CASE p_size % 4 WHEN 0 THEN ' (Live)' WHEN 1 THEN ' Original Mix' WHEN 2 THEN ' Remix Edit' ELSE '' END"
OTHERS = "p_name || CASE p_size % 3 WHEN 0 THEN ' (live) acoustic' WHEN 1 THEN ' Mix' ELSE ' remix' END"


def sql_versions(c: str) -> str:
    w = rf"list_distinct(regexp_extract_all(lower({c}), '\b({'|'.join(T.VERSION_WORDS)})\b', 1))"
    return f"list_sort(CASE WHEN list_contains({w}, 'original') THEN list_filter({w}, lambda x: x <> 'mix') ELSE {w} END)"


@query("part", sql=f"""WITH s AS (SELECT p_partkey, {sql_versions(TITLES)} AS a, {sql_versions(OTHERS)} AS b FROM part)
SELECT p_partkey, array_to_string(a, ',') AS mine, array_to_string(b, ',') AS theirs, array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))), ',') AS mismatch FROM s""")
def version_markers_symdiff(part):
    s = part.select("p_partkey", T.version_words(F.expr(TITLES)).alias("a"), T.version_words(F.expr(OTHERS)).alias("b"))
    return s.select("p_partkey", F.array_join("a", ",").alias("mine"), F.array_join("b", ",").alias("theirs"), F.array_join(T.symmetric_difference(F.col("a"), F.col("b")), ",").alias("mismatch"))


@query("part", sql=f"""WITH n AS (SELECT DISTINCT {sql_norm('p_name')} AS name FROM part), w AS (SELECT name, unnest(string_split(name, ' ')) AS word FROM n),
p AS (SELECT DISTINCT a.name AS want, b.name AS got FROM w a JOIN w b USING (word)),
x AS (SELECT *, list_distinct(string_split(want, ' ')) AS a, list_distinct(string_split(got, ' ')) AS b FROM p)
SELECT want, got, CASE WHEN want = '' OR got = '' THEN 0.0::DOUBLE WHEN want = got THEN 1.0::DOUBLE WHEN contains(want, got) OR contains(got, want) THEN 0.85::DOUBLE ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS fit FROM x""")
def name_fit_catalogue(part):
    """Fit of every pair of catalogue names that share a word."""
    n = part.select(T.norm(F.col("p_name")).alias("name")).distinct()
    w = n.select("name", F.explode(F.split("name", " ")).alias("word"))
    p = w.select(F.col("name").alias("want"), "word").join(w.select(F.col("name").alias("got"), "word"), "word").select("want", "got").distinct()
    return p.select("want", "got", T.fit(F.col("want"), F.col("got")).alias("fit"))


@query("part", sql="""WITH n AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT p_name || 's', count(*) FROM part WHERE p_size = 1 GROUP BY 1 UNION ALL SELECT replace(p_name, 'i', ''), count(*) FROM part WHERE p_size = 2 AND contains(p_name, 'i') GROUP BY 1),
g AS (SELECT name, sum(n) AS n FROM n GROUP BY 1)
SELECT a.name AS typo, b.name AS canonical, CAST(b.n AS BIGINT) AS n FROM g a JOIN g b ON levenshtein(a.name, b.name) = 1 AND (a.n < b.n OR (a.n = b.n AND a.name > b.name))""")
def typo_alias(part):
    """Names one edit apart point to the more frequent. Blocks: names one edit apart agree on their first or their second half once the length differs by one at most."""
    made = part.select(F.col("p_name").alias("name")).unionByName(part.where("p_size = 1").select(F.concat("p_name", F.lit("s")).alias("name"))).unionByName(part.where("p_size = 2 AND contains(p_name, 'i')").select(F.replace("p_name", F.lit("i"), F.lit("")).alias("name")))
    g = made.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    # A deletion of one character of either name gives a common string, or the names differ in one place: deleting that place does too.
    cuts = F.expr("array_distinct(concat(array(name), transform(sequence(1, length(name)), i -> concat(substring(name, 1, i - 1), substring(name, i + 1)))))")
    k = g.where("name <> ''").select("name", "n", F.explode(cuts).alias("k"))
    p = k.alias("a").join(k.alias("b"), "k").where("a.name <> b.name AND (a.n < b.n OR (a.n = b.n AND a.name > b.name))")
    return p.select(F.col("a.name").alias("typo"), F.col("b.name").alias("canonical"), F.col("b.n").alias("n")).distinct().where(F.levenshtein("typo", "canonical") == 1)


@query("documents", sql="""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents), c AS (SELECT lower(w) AS folded, w AS spelling, count(*) AS n FROM w GROUP BY 1, 2)
SELECT folded, spelling, n FROM (SELECT *, row_number() OVER (PARTITION BY folded ORDER BY (length(spelling) >= 4 AND spelling = upper(spelling)), n DESC, spelling) AS r FROM c) WHERE r = 1""")
def preferred_spelling(documents):
    """Of each word's spellings the one that doesn't shout, then the most frequent, then the first by code points."""
    c = documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("spelling")).groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
    shouts = (F.length("spelling") >= 4) & (F.col("spelling") == F.upper("spelling"))
    best = c.groupBy(F.lower("spelling").alias("folded")).agg(F.min_by(F.struct("spelling", "n"), F.struct(shouts, -F.col("n"), "spelling")).alias("x"))
    return best.select("folded", "x.spelling", "x.n")


@query("part")
def sequence_ratio(part):
    """Exact Ratcliff-Obershelp ratio of names that share a word; no SQL form, tested against difflib."""
    n = part.select("p_name").distinct()
    w = n.select("p_name", F.explode(F.split("p_name", " ")).alias("word"))
    p = w.select(F.col("p_name").alias("a"), "word").join(w.select(F.col("p_name").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    return p.select("a", "b", F.round(T.sequence_ratio("a", "b"), 6).alias("ratio"))


HINT = "CASE (conv_id * 3 + turn) % 9 WHEN 0 THEN 'y' WHEN 1 THEN 'no' WHEN 2 THEN 'drop' WHEN 3 THEN 'https://x.example/' || conv_id WHEN 4 THEN 'trim=' || turn || '.5' WHEN 5 THEN 'intro=' || (turn + 25) WHEN 6 THEN 'title=T' || conv_id || '; artist=A' || turn WHEN 7 THEN 'refetch' ELSE text END"


@query("conversations", sql=rf"""WITH h AS (SELECT conv_id, turn, trim({HINT}) AS h FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(h, '^(?i)(y|yes|ok)$') THEN 'yes' WHEN regexp_matches(h, '^(?i)(n|no)$') THEN 'no' WHEN regexp_matches(h, '^(?i)drop$') THEN 'drop' WHEN regexp_matches(h, '^(?i)refetch$') THEN 'refetch' WHEN regexp_matches(h, '^https?://\S+$') THEN 'url'
  WHEN regexp_matches(h, '^trim=[0-9]+(\.[0-9]+)?$') THEN 'trim' WHEN regexp_matches(h, '^intro=[0-9]+(\.[0-9]+)?$') AND try_cast(substring(h, 7) AS DOUBLE) <= 30 THEN 'intro' WHEN regexp_matches(h, '^[a-z]+=[^;]*(;\s*[a-z]+=[^;]*)*$') THEN 'override' ELSE 'note' END AS kind,
  CASE WHEN regexp_matches(h, '^trim=[0-9]') THEN try_cast(substring(h, 6) AS DOUBLE) WHEN regexp_matches(h, '^intro=[0-9]') AND try_cast(substring(h, 7) AS DOUBLE) <= 30 THEN try_cast(substring(h, 7) AS DOUBLE) END AS seconds,
  nullif(regexp_extract(h, 'artist=([^;]*)', 1), '') AS artist FROM h""")
def hint_parse(conversations):
    """What a reviewer wrote, by a fixed precedence of forms; anything else is a note."""
    h = F.col("h")
    c = conversations.select("conv_id", "turn", F.trim(F.expr(HINT)).alias("h"))
    intro = h.rlike(r"^intro=[0-9]+(\.[0-9]+)?$") & (F.expr("try_cast(substring(h, 7) AS DOUBLE)") <= 30)
    kind = F.when(h.rlike("^(?i)(y|yes|ok)$"), "yes").when(h.rlike("^(?i)(n|no)$"), "no").when(h.rlike("^(?i)drop$"), "drop").when(h.rlike("^(?i)refetch$"), "refetch").when(h.rlike(r"^https?://\S+$"), "url").when(h.rlike(r"^trim=[0-9]+(\.[0-9]+)?$"), "trim").when(intro, "intro").when(h.rlike(r"^[a-z]+=[^;]*(;\s*[a-z]+=[^;]*)*$"), "override").otherwise("note")
    seconds = F.when(h.rlike("^trim=[0-9]"), F.expr("try_cast(substring(h, 6) AS DOUBLE)")).when(h.rlike("^intro=[0-9]") & (F.expr("try_cast(substring(h, 7) AS DOUBLE)") <= 30), F.expr("try_cast(substring(h, 7) AS DOUBLE)"))
    return c.select("conv_id", "turn", kind.alias("kind"), seconds.alias("seconds"), F.nullif(F.regexp_extract(h, "artist=([^;]*)", 1), F.lit("")).alias("artist"))


@query("pages", sql=r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN regexp_matches(url, '[?&]utm_') THEN 'tracked' WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' WHEN regexp_matches(url, '/$') THEN 'folder' ELSE 'page' END AS kind, nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS lang FROM pages""")
def hint_classify_url(pages):
    u = F.col("url")
    kind = F.when(u.rlike("[?&]utm_"), "tracked").when(F.contains(u, F.lit("?")), "query").when(F.contains(u, F.lit("#")), "fragment").when(u.rlike("/$"), "folder").otherwise("page")
    return pages.select("page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), kind.alias("kind"), F.nullif(F.regexp_extract(u, "/([a-z]{2})/", 1), F.lit("")).alias("lang"))


@query("pages", sql=r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def html_records(pages):
    h = F.col("html")
    return pages.select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.nullif(F.regexp_extract(h, '<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"), F.array_join(F.regexp_extract_all(h, F.lit('<a href="([^"]*)"'), 1), " ").alias("links"), F.size(F.regexp_extract_all(h, F.lit("<p>"), 0)).cast("long").alias("paragraphs"))


def _bigrams(df, *keys: str):
    """keys and bs: distinct pairs of neighbouring words of column text; the words themselves where there are fewer than two."""
    words = F.filter(F.split(T.norm(F.col("text")), " "), lambda x: x != "")
    # One lambda around the words keeps the optimiser from working them out anew for each pair.
    pairs = F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(w))
    return df.select(*keys, F.array_distinct(pairs[0]).alias("bs"))


_W = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
_B = "list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"


@query("documents", "benchmark", sql=f"""WITH d AS (SELECT doc_id, unnest({_B}) AS b FROM (SELECT doc_id, {_W.format(sql_norm('text'))} AS w FROM documents)), i AS (SELECT item_id, unnest({_B}) AS b FROM (SELECT item_id, {_W.format(sql_norm('text'))} AS w FROM benchmark)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1)
SELECT doc_id, item_id, round(count(*)::DOUBLE / any_value(n), 6) AS containment, CASE WHEN count(*)::DOUBLE / any_value(n) >= 0.12 THEN 'confirmed' WHEN count(*)::DOUBLE / any_value(n) >= 0.04 THEN 'weak' ELSE 'inconclusive' END AS verdict FROM d JOIN i USING (b) JOIN n USING (item_id) GROUP BY 1, 2""")
def containment_bigrams(documents, benchmark):
    """Share of a passage's distinct bigrams that a text has, for pairs that share one."""
    d = _bigrams(documents, "doc_id").select("doc_id", F.explode("bs").alias("b"))
    i = _bigrams(benchmark, "item_id").select("item_id", F.size("bs").alias("n"), F.explode("bs").alias("b"))
    c = d.join(i, "b").groupBy("doc_id", "item_id").agg((F.count(F.lit(1)) / F.max("n")).alias("c"))
    return c.select("doc_id", "item_id", F.round("c", 6).alias("containment"), F.when(F.col("c") >= 0.12, "confirmed").when(F.col("c") >= 0.04, "weak").otherwise("inconclusive").alias("verdict"))
