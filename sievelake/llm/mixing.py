"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Documents are range-sorted by source and
key, running word counts come from sums that partitions hand on to each other,
and a source's mix is its whole epochs plus the documents, in order of their
keys, up to the exact rest of its budget; the document on the edge gives its first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.operators import scan
from sievelake.runtime import broadcast_if_small, cut

#: A word of a text, as a Java pattern.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of sources in order, repeated; times a source may be taken; seed of the keys.
WEIGHTS, EPOCHS, SEED = (1, 2, 3), 3, 20240517


def n_words(text: Column) -> Column:
    """Number of words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with column weight: weights in order of the names' code points, repeated, null last."""
    d = scan.ordered(sources, [], [F.asc_nulls_last("source")])
    at = scan.plain(scan.running(d, [], F.lit(1).cast("long"), "_at"))
    return at.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("_at")


def targets(sources: DataFrame, share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, source_size, weight) with column target: shares of `share` of all sizes by weight, stopped at `epochs` times a source's size, the excess reshared.

    In order of size over weight, sources stop until the level that the others
    share is above no source's stop; the level is the highest met on the way, so no round is repeated.
    """
    d = sources.withColumn("_cap", (F.col("source_size") * epochs).cast("long"))
    d = d.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    d = scan.ordered(d, [], [F.col("_ratio"), F.asc_nulls_last("source")])
    d = scan.running(scan.running(d, [], F.col("_cap"), "_caps"), [], F.col("weight"), "_weights")
    whole = d.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weights")).first()
    total, weights = share * (whole["all"] or 0), whole["weights"] or 0.0
    level = (F.lit(total) - (F.col("_caps") - F.col("_cap"))) / (F.lit(weights) - (F.col("_weights") - F.col("weight")))
    top = d.agg(F.max(level)).first()[0] or 0.0
    return scan.plain(d).withColumn("target", F.least(F.col("_cap").cast("double"), F.col("weight") * F.lit(top))).drop("_cap", "_ratio", "_caps", "_weights")


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.0, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, part, taken) of every row of docs.

    A row is taken whole `copies` times and then with its first `part` words; taken
    is the sum of its words. A source's taken words add up to its target, rounded down.
    weights (source, weight) may name weights; else they are WEIGHTS in order of the sources, and a source
    that weights doesn't name weighs nothing. Null text has no words; null is a source of its own; rows that
    share an id are rows of their own, of which equal ones may be taken differently
    often. Other columns play no part, whatever their names. Keys depend on seed, id and
    size alone, so reruns agree. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", F.lit(seed)))
    rows = cut(rows.withColumn("_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")))
    sources = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    if weights is None:
        weighted = cycled(sources)
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        weighted = sources.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").where("weight > 0")
    aim = cut(targets(weighted, share, epochs)).select(F.col("source").alias("_s"), "source_size", "target")
    d = scan.running(scan.ordered(rows, ["source"], [F.col("_key"), F.col("doc_id"), F.col("size")]), ["source"], F.col("size"), "_end")
    d = scan.plain(d).join(broadcast_if_small(aim), F.col("source").eqNullSafe(F.col("_s")), "left")
    d = d.withColumns({"source_size": F.coalesce("source_size", F.lit(0)).cast("long"), "target": F.coalesce("target", F.lit(0.0))})
    whole = F.floor("target").cast("long")
    d = d.withColumn("copies", F.expr("CASE WHEN source_size > 0 THEN cast(floor(target) AS bigint) div source_size ELSE 0L END"))
    rest = whole - F.col("copies") * F.col("source_size") - (F.col("_end") - F.col("size"))
    d = d.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix takes them: each once an epoch, with column epoch (0, 1, ...). Where only a text's first words are taken, they are joined by one space.

    how goes to mix; ids must be unique, as the mix is joined to docs by them. Rows that the mix doesn't take are left out; so are rows with a null id.
    """
    key = how.get("id_col", "doc_id")
    text = how.get("text_col", "text")
    plan = mix(docs, **how).where("taken > 0").select(F.col("doc_id").alias("_mix_id"), F.struct("copies", "part", "size").alias("_mix"))
    d = docs.join(plan, F.col(key) == F.col("_mix_id"))
    last = F.col("_mix.part") > 0
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix.copies") - F.when(last, 0).otherwise(1))))
    cut_off = (F.col("epoch") == F.col("_mix.copies")) & (F.col("_mix.part") < F.col("_mix.size"))
    shorter = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col("_mix.part"), F.lit(1)).cast("int")), " ")
    return d.withColumn(text, F.when(cut_off, shorter).otherwise(F.col(text))).select(*docs.columns, "epoch")


def sql() -> str:
    """DuckDB SQL for the rows of mix over the table documents."""
    return f"""
WITH rows_ AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
keyed AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':{SEED}'), 1, 15) AS BIGINT) AS key FROM rows_),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighted AS (SELECT *, CAST(((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) + 1 AS DOUBLE) AS weight FROM sources),
capped AS (SELECT *, {EPOCHS} * source_size AS cap FROM weighted),
before AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM capped WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((CAST(all_size AS DOUBLE) - caps) / (all_weight - weights)) AS top FROM before),
aims AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * top) AS target FROM before, level),
ends AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM keyed),
cuts AS (SELECT e.doc_id, e.source, e.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN CAST(floor(a.target) AS BIGINT) // a.source_size ELSE 0 END AS copies, stop - size AS start FROM ends e JOIN aims a ON e.source IS NOT DISTINCT FROM a.source),
parts AS (SELECT *, CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - copies * source_size - start)) AS BIGINT) AS part FROM cuts)
SELECT doc_id, source, size, source_size, target, copies, part, copies * size + part AS taken FROM parts"""
