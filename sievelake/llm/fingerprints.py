"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL expressions only.

A text's paragraphs (its lines, long ones cut after sentence ends) are digested
to 64 bits. Each digest falls into one cell of each of three tables; a cell
holds a count, the XOR of its digests and the XOR of their checks. Subtracting
two sketches leaves the paragraphs that differ; cells of a single one are
peeled off until none is left. Where peeling fails, larger sketches follow: the
digests are dealt to groups of about LOAD, each with a sketch of its
own, which doubles on failure until it peels, GROWTHS times at most: the last has
1536 cells in each table, and a group fails in all with a probability under 1e-15, which
raises an error. So the differing digests are exact, and the work grows by n**1.5
at most with a text's paragraphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of each of a fingerprint's three tables; digests of a group, cells of its first tables, and sketches that are tried.
TABLE, LOAD, FIRST, GROWTHS = 16, 24, 12, 8
#: Text bytes of a range of ids.
RANGE_BYTES = 8 << 20
_ROUNDS = 12


def paragraphs(text: str) -> str:
    """SQL: distinct digests of a text's paragraphs, blank ones left out."""
    return f"array_distinct(transform(filter(split({text}, '\\\\n+|(?<=[.!?]) +'), q -> length(trim(q)) > 0), q -> xxhash64(trim(q))))"


def _entries(keys: str, sign: int, table, seed) -> str:
    at = ", ".join(f"cast(pmod(xxhash64(k, {seed} + {t}), {table}) + {t} * {table} as int) AS p{t}" for t in range(3))
    return f"transform({keys}, k -> struct({sign} AS s, k AS k, cast(xxhash64(k, -7) & 2147483647 as int) AS h, {at}))"


def _cells(entries: str, table) -> str:
    one = "transform(sequence({0}, {1}), j -> aggregate(filter({2}, e -> e.p{3} = j), struct(0 AS c, 0L AS k, 0 AS h), (a, e) -> struct(a.c + e.s AS c, a.k ^ e.k AS k, a.h ^ e.h AS h)))"
    return "concat(" + ", ".join(one.format(f"{t} * {table}", f"{t + 1} * {table} - 1", entries, t) for t in range(3)) + ")"


def cells(keys: str, table: int = TABLE, seed: int = 0) -> str:
    """SQL: the cells (c, k, h) of an array of digests."""
    return f"transform(array({_entries(keys, 1, table, seed)}), x -> {_cells('x', table)})[0]"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> struct(x.c - y.c AS c, x.k ^ y.k AS k, x.h ^ y.h AS h))"


def peel(diff: str, table, seed) -> str:
    """SQL: struct(ok, left, right): the number of digests of either side only, found by peeling the cells diff. table and seed may be SQL."""
    single = f"array_distinct(transform(filter(s.z, x -> abs(x.c) = 1 AND x.h = cast(xxhash64(x.k, -7) & 2147483647 as int)), x -> struct(x.c AS s, x.k AS k, x.h AS h, {', '.join(f'cast(pmod(xxhash64(x.k, {seed} + {t}), {table}) + {t} * {table} as int) AS p{t}' for t in range(3))})))"
    at = f"CASE WHEN j < {table} THEN e.p0 WHEN j < 2 * {table} THEN e.p1 ELSE e.p2 END"
    peeled = f"transform(s.z, (x, j) -> aggregate(filter(p, e -> {at} = j), x, (a, e) -> struct(a.c - e.s AS c, a.k ^ e.k AS k, a.h ^ e.h AS h)))"
    step = f"CASE WHEN s.go THEN transform(array({single}), p -> struct({peeled} AS z, s.l + size(filter(p, e -> e.s = 1)) AS l, s.r + size(filter(p, e -> e.s = -1)) AS r, size(p) > 0 AS go))[0] ELSE s END"
    return f"aggregate(sequence(1, {_ROUNDS}), struct({diff} AS z, 0 AS l, 0 AS r, true AS go), (s, o) -> {step}, s -> struct(forall(s.z, x -> x.c = 0 AND x.k = 0 AND x.h = 0) AS ok, s.l AS l, s.r AS r))"


def _group(a: str, b: str) -> str:
    """SQL: struct(l, r) of two small arrays of digests, by ever larger sketches."""
    table, seed = f"shiftleft({FIRST}, i - 1)", "10 * i"
    both = f"concat({_entries(a, 1, table, seed)}, {_entries(b, -1, table, seed)})"
    tried = peel(f"transform(array({both}), x -> {_cells('x', table)})[0]", table, seed)
    return f"aggregate(sequence(1, {GROWTHS}), struct(false AS ok, 0 AS l, 0 AS r), (g, i) -> CASE WHEN g.ok THEN g ELSE {tried} END, g -> CASE WHEN g.ok THEN struct(g.l AS l, g.r AS r) ELSE raise_error('no sketch of these paragraphs could be peeled') END)"


def _grouped(a: str, b: str) -> str:
    """SQL: struct(l, r) of two arrays of digests of any size."""
    g = f"cast(ceil(sqrt((size({a}) + size({b}) + 1) / {LOAD}.0)) as int)"
    pick = "filter({0}, k -> pmod(k, g) = m)"
    part = "filter({0}, k -> pmod(shiftright(k, 20), g) = n)"
    add = "(t, v) -> struct(t.l + v.l AS l, t.r + v.r AS r)"
    inner = f"aggregate(transform(sequence(0, g - 1), n -> transform(array(struct({part.format('d.a')} AS a, {part.format('d.b')} AS b)), u -> {_group('u.a', 'u.b')})[0]), struct(0 AS l, 0 AS r), {add})"
    outer = f"transform(sequence(0, g - 1), m -> transform(array(struct({pick.format(a)} AS a, {pick.format(b)} AS b)), d -> {inner})[0])"
    return f"transform(array({g}), g -> aggregate({outer}, struct(0 AS l, 0 AS r), {add}))[0]"


def likeness(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: shared digests twice over all digests of both sides; 1 where both are empty."""
    first = peel(subtract(cells_a, cells_b), TABLE, 0)
    diff = f"transform(array({first}), f -> CASE WHEN f.ok THEN struct(f.l AS l, f.r AS r) ELSE {_grouped(a, b)} END)[0]"
    return f"CASE WHEN size({a}) + size({b}) = 0 THEN 1.0D ELSE transform(array({diff}), d -> (size({a}) - d.l + size({b}) - d.r) / cast(size({a}) + size({b}) as double))[0] END"


def fingerprint(cells_col: str) -> str:
    """SQL: the cells as hexadecimal text."""
    return f"array_join(transform({cells_col}, x -> concat(lpad(hex(x.c), 4, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.h), 8, '0'))), '')"


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs (doc_id, text) with column next_text: the text of the next row by doc_id, for the last row that of the first; equal ids in order of their texts' hash.

    Ids are cut into ranges at their quantiles, and large ranges evenly again; a
    row's next is in its range or is the first of the next range that has any.
    """
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    want = max(1, min(-(-(size or 0) // range_bytes), rows))
    cuts = min(want, 2048)
    found = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(cuts + 1)], 20_000)).first()[0] or [0]
    edges = sorted({int(x) for x in found})
    fine = -(-want // cuts)
    # Binary search for the last edge that isn't above the id.
    steps = max(1, len(edges).bit_length())
    e = f"array({', '.join(f'{x}L' for x in edges)})"
    low = f"aggregate(sequence(1, {steps}), struct(0 AS lo, {len(edges)} AS hi), (s, i) -> CASE WHEN s.hi - s.lo <= 1 THEN s WHEN {e}[shiftright(s.lo + s.hi, 1)] <= doc_id THEN struct(shiftright(s.lo + s.hi, 1) AS lo, s.hi AS hi) ELSE struct(s.lo AS lo, shiftright(s.lo + s.hi, 1) AS hi) END, s -> cast(s.lo as int))"
    lo, hi = f"{e}[q]", f"coalesce(get({e}, q + 1), {e}[q] + 1)"
    at = docs.withColumn("q", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.expr(low)))
    at = at.withColumn("r", F.expr(f"CASE WHEN q < 0 THEN -1L ELSE q * {fine}L + least({fine - 1}L, greatest(0L, cast(floor((doc_id - {lo}) * {fine}D / greatest(1L, {hi} - {lo})) as bigint))) END")).drop("q")
    at = at.withColumn("th", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.col("th")]
    inside = at.withColumn("lead", F.lead(F.struct("text")).over(Window.partitionBy("r").orderBy(*order)))
    firsts = at.groupBy("r").agg(F.min_by(F.struct("text"), F.struct("doc_id", "th")).alias("first"))
    ranks = firsts.select("r")
    by = Window.orderBy("r")
    links = ranks.select("r", F.coalesce(F.lead("r").over(by), F.min("r").over(Window.partitionBy())).alias("to"))
    after = links.join(firsts.select(F.col("r").alias("to"), "first"), "to").select("r", "first")
    return inside.join(after, "r").select("doc_id", "text", F.coalesce("lead", "first")["text"].alias("next_text"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    The edited text has the last floor(n / 2) code points replaced by the first
    as many of the next row's text. Null text is empty; a table of one row is its own
    next. Repeated rows each come back; equal texts have equal fingerprints.
    Other columns play no part, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.expr("length(text) div 2")
    t = with_next(rows).select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half.cast("int")), F.substring("next_text", F.lit(1), half.cast("int"))).alias("edited"), "text", "next_text")
    t = t.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.expr(paragraphs("text")).alias("pa"), F.expr(paragraphs("edited")).alias("pb"), F.expr(paragraphs("next_text")).alias("pc"))
    t = t.select("*", *(F.expr(cells(f"p{x}")).alias(f"c{x}") for x in "abc"))
    near = {x: F.expr(likeness("pa", f"p{x}", "ca", f"c{x}")) for x in "bc"}
    return t.select("doc_id", "n_chars", "edited_sha256", F.expr(fingerprint("ca")).alias("fingerprint"), F.expr(fingerprint("cb")).alias("edited_fingerprint"), near["b"].alias("near_edited"), near["c"].alias("near_next"))
