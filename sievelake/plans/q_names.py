"""Queries on names: customers and orders choose among spellings, credits, titles and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import names as N
from sievelake.plans.registry import query
from sievelake.plans.standin import chosen, chosen_sql

ARTISTS = ["Đorđe Balašević", "Beyoncé", "MÖTÖRHEAD", "Sigur Rós Official", "Љубав Џез", "  The   Weeknd ", "A$AP Rocky + Friends", "Straße & Söhne", "Kavasaki", "Kawasaki", "mgk; Camila Cabello", "Ensō, Łona i Webber", "ABBA", "Ќирил Шаћири VEVO", "Music", None, "", "Þórður Æsir", "Komplexi", "Quick Phoenix", "Nguyễn Ấn"]
TITLES = ["Animals (Balkanik Remix)", "Sped  Up night (Original Mix)", "Heroes ft. Tove Lo (Bvrnout Remix)", "OK (extended version)", "Neću (feat. Ana & Iva)", "Rođendan", "Live vs. Studio", "Official Video HD Song", "Defeat", "song [ft. Đole, Ana x Mia]", "the art of edm/dj set - a tale", "", None, "Lomi (Live)", "Quick Phone Theme"]
FILES = ["02. Adele - Hello (Official Video) [HD].mp3", "Hello.flac", "twenty one pilots： Heathens (Lyrics).mp3", "Ana – Mia (tekst) (audio) hq.mp3", ".hidden", "A - B - C ft. D.mp3", "12 - Ana x Mia - Zora (feat. Iva).ogg", "noext", "Artist (2) * - Song.mp3"]


def _raw(customer):
    return customer.select(F.col("c_custkey").alias("id"), chosen("c_custkey", ARTISTS).alias("a"), chosen("c_custkey", TITLES).alias("t"), chosen("c_custkey", FILES).alias("f"), chosen("c_nationkey", ARTISTS).alias("b"))


RAW = f"raw AS (SELECT c_custkey AS id, {chosen_sql('c_custkey', ARTISTS)} AS a, {chosen_sql('c_custkey', TITLES)} AS t, {chosen_sql('c_custkey', FILES)} AS f, {chosen_sql('c_nationkey', ARTISTS)} AS b FROM customer)"


def _norm(x):
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def _replaced(x, pairs):
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _catalogue(x):
    return f"trim(regexp_replace(strip_accents({_replaced(f'''lower(coalesce({x}, ''))''', N.UNDECOMPOSED.items())}), '[^a-z0-9]+', ' ', 'g'))"


_LATIN = [*N.DIGRAPHS, *zip(N.CYRILLIC, N.LATIN, strict=True)]
FOLDED = f"""raw2 AS (SELECT *, regexp_replace(lower(strip_accents(trim({_replaced("coalesce(a, '')", _LATIN)}))), '\\s+', ' ', 'g') AS fa FROM raw)"""


@query("customer", sql=f"""WITH {RAW}, {FOLDED} SELECT id, {_norm('a')} AS identity, {_catalogue('a')} AS catalogue,
trim(regexp_replace(strip_accents(replace(lower(a), 'ß', 'ss')), '\\s+', ' ', 'g')) AS store, {_replaced(_catalogue('a'), N.ROMANISED)} AS romanised,
{_replaced('a', _LATIN)} AS latin, CASE WHEN trim(regexp_replace(fa, '\\s*\\b({N.CHANNEL})\\b\\s*$', '', 'i')) = '' THEN fa ELSE trim(regexp_replace(fa, '\\s*\\b({N.CHANNEL})\\b\\s*$', '', 'i')) END AS artist_fold,
trim(regexp_replace(lower(strip_accents(trim(coalesce(a, '')))), '[^a-z0-9$+]+', ' ', 'g')) AS scene_fold,
regexp_matches(coalesce(a, ''), '[\\x{{0400}}-\\x{{04FF}}]') AS cyrillic,
len(regexp_replace(coalesce(a, ''), '\\PL', '', 'g')) >= 4 AND len(regexp_replace(coalesce(a, ''), '\\P{{Lu}}', '', 'g')) >= 0.8 * len(regexp_replace(coalesce(a, ''), '\\PL', '', 'g')) AS shouty,
CAST(len(list_filter(string_split(coalesce(a, ''), ''), lambda x: strip_accents(x) <> x)) + len(list_filter(string_split(coalesce(a, ''), ''), lambda x: x IN ('ễ', 'ấ', 'Ấ'))) AS INT) AS marks,
{_norm(f"regexp_replace(coalesce(t, ''), '\\b({N.DECORATION})\\b', ' ', 'gi')")} AS dedupe_key FROM raw2""")
def name_folds(customer):
    """Every fold of a name: for identity, catalogue, store, romanised, in Latin script, of artists and scenes; script, shouting, marks; key for duplicates."""
    a, t = F.col("a"), F.col("t")
    return _raw(customer).select("id", N.norm_identity(a).alias("identity"), N.norm_catalogue(a).alias("catalogue"), N.norm_store(a).alias("store"), N.romanise(N.norm_catalogue(a)).alias("romanised"), N.latin(a).alias("latin"), N.fold_artist(a).alias("artist_fold"), N.fold_scene(a).alias("scene_fold"), N.is_cyrillic(a).alias("cyrillic"), N.shouty(a).alias("shouty"), N.accents(a).alias("marks"), N.dedupe_key(t).alias("dedupe_key"))


@query("customer")
def nfkd_fold(customer):
    """Exact compatibility folding by the registered scalar function."""
    return _raw(customer).select("id", N.nfkd_fold("a").alias("folded"))


def _agree(w, g):
    return f"CASE WHEN {w} = {g} THEN 1.0 WHEN contains({w}, {g}) OR contains({g}, {w}) THEN 0.85 ELSE len(list_intersect(string_split({w}, ' '), string_split({g}, ' '))) / CAST(len(list_distinct(list_concat(string_split({w}, ' '), string_split({g}, ' ')))) AS DOUBLE) END"


@query("customer", sql=f"""WITH {RAW}, n AS (SELECT id, {_catalogue('a')} AS w, {_catalogue('b')} AS g FROM raw), r AS (SELECT *, {_replaced('w', N.ROMANISED)} AS rw, {_replaced('g', N.ROMANISED)} AS rg FROM n),
s AS (SELECT *, {_agree('w', 'g')} AS s1, {_agree('rw', 'rg')} AS s2 FROM r)
SELECT id, CAST(round(CASE WHEN w = '' OR g = '' THEN 0.0 WHEN s1 < 0.5 THEN greatest(s1, s2) ELSE s1 END, 6) AS DOUBLE) AS fit FROM s""")
def name_fit_romanised(customer):
    """Agreement of two names, with the second try on romanised forms."""
    return _raw(customer).select("id", F.round(N.fit(F.col("a"), F.col("b")), 6).alias("fit"))


_SPLIT = r"\s*;\s*|\s+&\s+|\s+[Xx]\s+|\x01|\s+(?:[Ff]eat\.?|[Ff][Tt]\.?|[Ff]eaturing)\s+|\s+i\s+"


def _credit(x):
    return f"list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '\\s*,\\s*(\\S)', chr(1) || '\\1', 'g'), '{_SPLIT}'), lambda x: regexp_replace(trim(x), '^[&,;]\\s+|\\s+[&,;]$', '')), lambda x: x <> '')"


_FEAT = r"(?:^|[\s(\[])\s*[(\[]?\s*(?:feat\.?|ft\.?|featuring)\s+([^)\]]+?)\s*[)\]]?\s*$"
CREDITS = f"""c1 AS (SELECT *, regexp_extract(coalesce(t, ''), '{_FEAT}', 1, 'i') AS said, regexp_extract(coalesce(t, ''), '{_FEAT}', 0, 'i') AS whole, {_credit("coalesce(a, '')")} AS parts FROM raw),
c2 AS (SELECT *, regexp_extract(said, '^[^(\\[]*', 0) AS names, trim(regexp_replace(t, '{_FEAT}', '', 'i')) AS rest FROM c1),
c3 AS (SELECT *, said[len(names) + 1:] AS tail, coalesce(parts[1], a) AS lead, list_concat(CASE WHEN whole = '' THEN [] ELSE {_credit('names')} END, parts[2:]) AS all_feats FROM c2),
c4 AS (SELECT *, list_filter(list_filter(all_feats, lambda x, i: list_position(list_transform(all_feats, lambda y: lower(y)), lower(x)) = i), lambda x: lower(x) <> lower(coalesce(lead, ''))) AS feats,
  CASE WHEN whole = '' THEN t WHEN tail = '' THEN rest ELSE trim(rest || ' ' || tail || CASE WHEN regexp_matches(rtrim(whole), '[)\\]]$') THEN CASE WHEN tail[1] = '(' THEN ')' ELSE ']' END ELSE '' END) END AS plain FROM c3)"""


@query("customer", sql=f"""WITH {RAW}, {CREDITS} SELECT id, array_to_string({_credit("coalesce(a, '')")}, '|') AS credit, coalesce(parts[1], coalesce(a, '')) AS lead_of, lead, array_to_string(feats, '|') AS feats, plain,
CASE WHEN id % 3 = 0 THEN composed ELSE composed || ' [' || CAST(CAST(round_even(60 + id % 90 + 0.5, 0) AS BIGINT) AS VARCHAR) || ' BPM]' END AS composed FROM (SELECT *, CASE WHEN len(feats) = 0 THEN plain
  WHEN regexp_matches(plain, '\\(([^()]*)\\)\\s*$') THEN regexp_replace(plain, '\\(([^()]*)\\)\\s*$', '') || '(' || regexp_extract(plain, '\\(([^()]*)\\)\\s*$', 1) || ', ft. ' || array_to_string(feats, ', ') || ')'
  ELSE plain || ' (ft. ' || array_to_string(feats, ', ') || ')' END AS composed FROM c4)""")
def credit_split_compose(customer):
    """Credits split into lead and featured names, moved from artist and title into the title's brackets, with the tempo."""
    a, t = F.col("a"), F.col("t")
    lead, feats, plain = N.split_credits(a, t)
    d = _raw(customer).select("id", F.array_join(N.split_credit(a), "|").alias("credit"), N.lead_of(a).alias("lead_of"), lead.alias("lead"), feats.alias("fs"), plain.alias("plain"))
    bpm = F.when(F.col("id") % 3 != 0, F.lit(60) + F.col("id") % 90 + F.lit(0.5))
    return d.select("id", "credit", "lead_of", "lead", F.array_join("fs", "|").alias("feats"), "plain", N.compose_title(F.col("plain"), F.col("fs"), bpm).alias("composed"))


_VER = r"remix|rmx|cover|parody|mashup|bootleg|flip|edit|acoustic|unplugged|live|instrumental|karaoke|nightcore|sped\s*up|slowed|reverb|vs\.?|refix|rework|mix"


@query("customer", sql=f"""WITH {RAW}, v AS (SELECT *, list_distinct(list_transform(regexp_extract_all(lower(coalesce(t, '')), '\\b({_VER})\\b', 1), lambda x: regexp_replace(x, '[.\\s]', '', 'g'))) AS w FROM raw)
SELECT id, array_to_string(list_sort(CASE WHEN contains(lower(coalesce(t, '')), 'original') THEN list_filter(w, lambda x: x <> 'mix') ELSE w END), ',') AS words FROM v""")
def version_words_full(customer):
    """All markers of a version, dots and spaces off."""
    return _raw(customer).select("id", F.array_join(N.version_words(F.col("t")), ",").alias("words"))


_PAIRS_UP = [p for a, b in N.UNDECOMPOSED.items() for p in ((a, b), *([({"ı": "İ"}.get(a, a.upper()), {"đ": "Dj"}.get(a, b.upper()))] if a != "ß" else []))]


@query("customer", sql=f"""WITH {RAW}, d AS (SELECT *, strip_accents({_replaced('t', _PAIRS_UP)}) AS bare FROM raw), v AS (SELECT *, CASE WHEN coalesce(t, '') = '' THEN [] ELSE list_filter([t,
{', '.join(f"CASE WHEN contains(lower(t), '{a}') THEN regexp_replace(t, '{a}', '{b}', 'gi') END" for a, b in N.ROMANISED)}, nullif(bare, t)], lambda x: x IS NOT NULL) END AS l FROM d)
SELECT id, nullif(bare, t) AS bare, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '|') AS variants FROM v""")
def title_variants(customer):
    """A title without accents (null when unchanged), and all spellings worth asking for."""
    return _raw(customer).select("id", N.deaccent(F.col("t")).alias("bare"), F.array_join(N.title_variants(F.col("t")), "|").alias("variants"))


_SMALL, _ACRO = (", ".join(f"'{x}'" for x in xs) for xs in (N.SMALL, N.ACRONYM))


@query("customer", sql=f"""WITH {RAW} SELECT id, regexp_replace(t, '([+\\-&|!(){{}}\\[\\]^"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped,
array_to_string(list_transform(regexp_extract_all(trim(coalesce(t, '')), '[ \\-/&]|[^ \\-/&]+'), lambda x, i: CASE WHEN i > 1 AND lower(x) IN ({_SMALL}) THEN lower(x) WHEN lower(x) IN ({_ACRO}) THEN upper(x) ELSE upper(x[1]) || lower(x[2:]) END), '') AS cased,
regexp_replace(regexp_replace(regexp_replace(f, '\\s*\\(([0-9]{{1,3}})\\)|\\*', '', 'g'), '\\s{{2,}}', ' ', 'g'), '^[ ,;-]+|[ ,;-]+$', '', 'g') AS artist,
CASE WHEN s = '' THEN 'Unknown' ELSE s END AS safe, regexp_matches(coalesce(a, ''), '\\blyrics?\\b|\\bvevo\\b|\\btopic\\b|\\bkanal\\b|\\brealmusic\\b|\\bofficial\\s+channel\\b|\\btv\\+|\\.tv\\b|\\.com\\b', 'i') AS channel,
regexp_full_match(trim(coalesce(a, '')), '(various(\\s+artists)?|unknown(\\s+artist)?|artist|va|no\\s*artist|untitled|n/?a|none|default|track|audio|music)', 'i') AS placeholder
FROM (SELECT *, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(t, '')), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s{{2,}}', ' ', 'g'), '\\s+([)\\]])', '\\1', 'g'), '([(\\[])\\s+', '\\1', 'g'), '^[ .]+|[ .]+$', '', 'g'), 120) AS s FROM raw)""")
def title_cleaners(customer):
    """Escaped queries, title case, catalogue artists without numbering, file-safe names, channel and placeholder names."""
    a, t = F.col("a"), F.col("t")
    return _raw(customer).select("id", N.escape_query(t).alias("escaped"), N.titlecase(t).alias("cased"), N.clean_artist(F.col("f")).alias("artist"), N.safe_name(t).alias("safe"), N.looks_like_channel(a).alias("channel"), N.is_placeholder(a).alias("placeholder"))


_CRUFT = N.STEM_CRUFT.replace("(?iU)", "").replace("'", "''")


def _stem_sql(x):
    for _ in range(4):
        x = f"regexp_replace({x}, '{_CRUFT}', ' ', 'gi')"
    return f"regexp_replace(regexp_replace({x}, '\\s{{2,}}', ' ', 'g'), '^[ \\-–—_]+|[ \\-–—_]+$', '', 'g')"


STEMS = f"""st AS (SELECT *, CASE WHEN regexp_matches(f, '^.+\\.[^.]*$') THEN regexp_replace(f, '\\.[^.]*$', '') ELSE f END AS stem FROM raw), cl AS (SELECT *, {_stem_sql('stem')} AS clean FROM st),
pa AS (SELECT *, list_filter(list_transform(regexp_split_to_array(clean, '{N.STEM_SPLIT}'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM cl),
fk AS (SELECT *, CASE WHEN len(ps) > 1 THEN ps[1] END AS fa, CASE WHEN len(ps) > 1 THEN array_to_string(ps[2:], ' - ') ELSE clean END AS ft FROM pa)"""


@query("customer", sql=f"""WITH {RAW}, {STEMS} SELECT id, fa, ft, CASE WHEN base = '' THEN {_norm('stem')} ELSE {_norm('base')} END AS song_key, CASE WHEN {_norm("concat(coalesce(fa, ''), ' ', coalesce(ft, ''))")} = '' THEN {_norm('stem')} ELSE {_norm("concat(coalesce(fa, ''), ' ', coalesce(ft, ''))")} END AS file_key,
CASE WHEN coalesce(a, '') = '' AND coalesce(t, '') = '' THEN fa WHEN id % 4 <> 0 THEN coalesce(nullif(fa, ''), nullif(a, '')) ELSE coalesce(nullif(CASE WHEN lower(trim(a)) IN ('music') THEN NULL ELSE a END, ''), nullif(fa, '')) END AS seed_artist,
CASE WHEN coalesce(a, '') = '' AND coalesce(t, '') = '' THEN ft WHEN id % 4 <> 0 THEN coalesce(nullif(ft, ''), nullif(t, '')) ELSE coalesce(nullif(t, ''), nullif(ft, '')) END AS seed_title,
CASE WHEN (coalesce(a, '') = '' AND coalesce(t, '') = '') OR id % 4 <> 0 THEN 'filename' WHEN id % 8 = 0 THEN 'weak' ELSE 'tag' END AS trust
FROM (SELECT *, trim(coalesce(a, '') || ' ' || coalesce(t, '')) AS base FROM fk)""")
def file_names_and_seeds(customer):
    """Artist and title of a file's name, song and file keys, and the seed chosen between name and tags."""
    d = _raw(customer).withColumn("n", N.split_name(F.regexp_replace("f", r"(?<=.)\.[^.]*$", ""))).withColumns({"fa": F.col("n.artist"), "ft": F.col("n.title")})
    artist, title, trust = N.seed(F.col("fa"), F.col("ft"), F.col("a"), F.col("t"), F.when(F.col("id") % 4 == 0, "vid"), F.when(F.col("id") % 8 == 0, "weak"))
    return d.select("id", "fa", "ft", N.song_key(F.col("a"), F.col("t"), F.col("f")).alias("song_key"), N.file_key(F.col("f")).alias("file_key"), artist.alias("seed_artist"), title.alias("seed_title"), trust.alias("trust"))


@query("customer", sql=f"""WITH {RAW.replace('AS f,', 'AS f0,')}, r2 AS (SELECT *, regexp_replace(f0, '^\\s*[0-9]{{1,2}}\\s*[.)-]\\s+', '') AS f FROM raw), {STEMS.replace('FROM raw)', 'FROM r2)')}, k AS (SELECT id, fa AS a, ft AS t FROM fk), {CREDITS.replace('FROM raw)', 'FROM k)')}
SELECT id, CASE WHEN a <> '' AND t <> '' THEN lead END AS lead, CASE WHEN a <> '' AND t <> '' THEN plain END AS title, CASE WHEN a <> '' AND t <> '' THEN array_to_string(feats, '|') ELSE '' END AS feats FROM c4""")
def filename_guess(customer):
    """Lead, title and featured names guessed from a file's name."""
    return _raw(customer).select("id", N.guessed(F.col("f")).alias("g")).select("id", "g.lead", "g.title", F.array_join("g.feats", "|").alias("feats"))


_WORDS = "trim(regexp_replace(replace(concat_ws(' ', nullif(a, ''), nullif(t, '')), '/', ' '), '\\s+', ' ', 'g'))"


@query("customer", sql=f"""WITH {RAW}, w AS (SELECT id, {_WORDS} AS q FROM raw), s AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{u}')" for s, u in N.SEARCHES.items())}) AS x(source, base)) SELECT id, source, base || url_encode(q) AS url FROM w, s WHERE q <> ''""")
def search_links(customer):
    """Every source's search link for artist and title."""
    return _raw(customer).select("id", F.inline(N.search_links(F.col("a"), F.col("t"))))


_REC = ", ".join(f"('{f}', '{label}', '{u}')" for f, (label, u) in N.RECORDS.items())


@query("part", sql=f"""WITH r AS (SELECT * FROM (VALUES {_REC}) AS x(field, label, base)), f AS (SELECT p_partkey AS id, {chosen_sql('p_partkey', [*N.RECORDS, 'artist'])} AS field, p_name || '/' || p_brand AS value FROM part) SELECT id, label, base || url_encode(value) AS url FROM f JOIN r USING (field)""")
def record_links(part):
    """Pages of records by identifier; other fields have none."""
    d = part.select(F.col("p_partkey").alias("id"), chosen("p_partkey", [*N.RECORDS, "artist"]).alias("field"), F.concat_ws("/", "p_name", "p_brand").alias("value"))
    return d.select("id", N.record_link(F.col("field"), F.col("value")).alias("r")).where("r IS NOT NULL").select("id", "r.label", "r.url")
