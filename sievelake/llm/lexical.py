"""Ranked lexical search over document-sharded inverted indexes.

A shard holds some megabytes of text as CSR postings: its terms' 64-bit hashes in order,
where each term's postings start, and for each posting the document's place and its
impact, an integer worked out when the index is built. A query
goes through its terms one at a time and adds weight times impact to one dense array
of a shard's documents; each task keeps the best of its shards, and Spark merges the tasks' best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.llm import arrays as A
from sievelake.runtime import cut

#: Text bytes of a shard, hits of a query, queries that are answered in one pass over the index.
SHARD_BYTES, TOP, BLOCK = 16 << 20, 10, 2000
#: Share of a document's length in its impacts, in hundredths, and the factors of the impact.
LENGTH, SCALE, TF, MEAN = 90, 1_000_000_000, 1000, 8
#: Bytes that no term has: ASCII but for letters and digits.
GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False

INDEX = "ids array<long>, holding long, lengths binary, terms binary, starts binary, docs binary, impacts binary"


def _tokens(col: pa.Array, limit: int = A.CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes in lower case, term starts, term ends, first term of each row) of runs of rows."""
    for lo, hi, buf, s, e in A.texts(col, limit):
        yield lo, hi, A.LOWER[buf], *A.words(buf, s, e, GAP)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in batches:
        for *_, first in _tokens(batch.column(0)):
            size = np.diff(first)
            n += int((size > 0).sum())
            total += int(size.sum())
    yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms with repeats) of docs."""
    row = docs.select(F.col(text_col).alias("text")).mapInArrow(A.rested(_counted), "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["n"] or 0, row["total"] or 0


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def _unpack(b: bytes, size: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, size * np.dtype(dtype).itemsize, "zstd"), dtype)


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """The integer impact of each posting, from its count and its document's length."""
    if LENGTH * int(length.max(initial=0)) * n < 2**63:
        m = 100 - LENGTH + LENGTH * length * n // max(total, 1)
    else:
        m = np.array([100 - LENGTH + LENGTH * int(x) * n // total for x in length])
    return SCALE * tf // (TF * tf + MEAN * m)


def _postings(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of each distinct pair."""
    order = np.lexsort((rows, hashes))
    h, r = hashes[order], rows[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[new], r[new], np.diff(np.append(new, len(h)))


def _shard(parts: list, n: int, total: int) -> pa.RecordBatch:
    ids, sizes, hashes, rows, counts, base = [], [], [], [], [], 0
    for i, size, h, r, c in parts:
        ids += i
        sizes.append(size)
        hashes.append(h)
        rows.append(r + base)
        counts.append(c)
        base += len(i)
    size, h, r, c = np.concatenate(sizes), np.concatenate(hashes), np.concatenate(rows), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, r, c = h[order], r[order], c[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    starts = np.append(new, len(h)).astype(np.int32)
    packed = [_pack(size.astype(np.int64)), h[new].tobytes(), _pack(starts), _pack(r.astype(np.int32)), _pack(impacts(c, size[r], n, total).astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([int((size > 0).sum())]), *(pa.array([x], pa.binary()) for x in packed)], ["ids", "holding", "lengths", "terms", "starts", "docs", "impacts"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of every row of docs: a row of CSR postings for each shard. Write it as a table, or cut() it, to search it more than once.

    Null texts have no terms. A text longer than a shard is a shard with its neighbours. Rows that share an id are documents of their own.
    """
    A.tune(docs.sparkSession)
    n, total = statistics(docs, text_col)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, low, ws, we, first in _tokens(batch.column(1), min(A.CHUNK, shard_bytes)):
                size = np.diff(first)
                parts.append((ids.slice(lo, hi - lo).to_pylist(), size, *_postings(A.word_hashes(low, ws, we), np.repeat(np.arange(hi - lo), size))))
                held += len(low)
                if held >= shard_bytes:
                    yield _shard(parts, n, total)
                    parts, held = [], 0
        if parts:
            yield _shard(parts, n, total)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(A.rested(build), INDEX)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, low, ws, we, first in _tokens(batch.column(1)):
            h, r, _ = _postings(A.word_hashes(low, ws, we), np.repeat(np.arange(hi - lo), np.diff(first)))
            order = np.argsort(r, kind="stable")
            cuts = np.searchsorted(r[order], np.arange(1, hi - lo))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([x.tobytes() for x in np.split(h[order], cuts)], pa.binary())], ["item_id", "terms"])


def _frequencies(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for b, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = np.frombuffer(b, A.U64)
                starts = _unpack(s, len(terms) + 1, np.int32)
                at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
                if len(terms):
                    df += np.where(terms[at] == wanted, np.diff(starts)[at], 0)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], ["at", "df"])

    return run


def best(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores; of equal ones those of the smallest order."""
    if len(score) > k:
        least = score[np.argpartition(score, len(score) - k)[len(score) - k :]].min()
        found = np.flatnonzero(score >= max(least, 1))  # every tie with the k-th stays until order decides
    else:
        found = np.flatnonzero(score > 0)
    return found[np.lexsort((order[found], -score[found]))][:k]


def _searcher(wanted: np.ndarray, weight: np.ndarray, queries: list[np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries)
        for batch in batches:
            for row in batch.to_pylist():
                terms = np.frombuffer(row["terms"], A.U64)
                if not len(terms):
                    continue
                starts = _unpack(row["starts"], len(terms) + 1, np.int32)
                docs, impact = (_unpack(row[c], int(starts[-1]), np.int32) for c in ("docs", "impacts"))
                null = np.array([i is None for i in row["ids"]])
                ids = np.array([i or 0 for i in row["ids"]], np.int64)
                order = np.lexsort((ids, null)).argsort()
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                here = terms[at] == wanted
                for q, mine in enumerate(queries):
                    score = np.zeros(len(ids), np.int64)
                    for t in mine[here[mine]]:
                        a, b = starts[at[t]], starts[at[t] + 1]
                        score[docs[a:b]] += weight[t] * impact[a:b]
                    top = best(score, order, k)
                    if len(top):
                        s, i, x = (np.concatenate(p) for p in zip(kept[q], (score[top], ids[top], null[top]), strict=True))
                        top = np.lexsort((i, x, -s))[:k]
                        kept[q] = s[top], i[top], x[top]
        for q, (s, i, x) in enumerate(kept):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q, np.int32)), pa.array(i, mask=x), pa.array(s)], ["q", "doc_id", "score"])

    return run


def search(shards: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each row of items, of positive score, equal scores by ascending doc_id (null last).

    items are answered in blocks of at most `block` rows, each in one pass over the
    index; a block's terms, not the index, go to the tasks. Items without terms, null ones too, find nothing. Rows that share an
    item_id are answered each. Other columns play no part. An empty index or no items give no rows.
    """
    spark = shards.sparkSession
    A.tune(spark)
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("item_id", rows.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    kind = rows.schema["item_id"].dataType.simpleString()
    asked = rows.mapInArrow(A.rested(_query_terms), f"item_id {kind}, terms binary").withColumn("_at", F.monotonically_increasing_id())
    asked = cut(asked)
    n = shards.agg(F.sum("holding")).first()[0] or 0
    blocks = max(1, -(-asked.count() // block))
    out = None
    for part in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("_at"), F.lit(blocks)) == part).select("item_id", "terms").collect()
        each = [np.frombuffer(bytes(r["terms"]), A.U64) for r in held]
        wanted = np.unique(np.concatenate(each)) if each else np.zeros(0, A.U64)
        if not len(wanted):
            continue
        df = np.zeros(len(wanted), np.int64)
        for r in shards.select("terms", "starts").mapInArrow(A.rested(_frequencies(wanted)), "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
            df[r["at"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        queries = [np.searchsorted(wanted, t) for t in each]
        hits = shards.mapInArrow(A.rested(_searcher(wanted, weight, queries, k)), "q int, doc_id long, score long")
        w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(held)], f"q int, item_id {kind}")
        found = cut(hits.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def sql() -> str:
    """DuckDB SQL for the rows of search of every benchmark item over the table documents."""
    terms = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {terms} AS ts FROM documents),
lengths AS (SELECT rid, doc_id, CAST(len(ts) AS BIGINT) AS n FROM docs),
whole AS (SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
tfs AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT qid, item_id, t FROM (SELECT row_number() OVER () AS qid, item_id, unnest({terms}) AS t FROM (SELECT * FROM benchmark))),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, whole WHERE t IN (SELECT t FROM asked) GROUP BY t, big_n),
scored AS (SELECT qid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (rid), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10"""
