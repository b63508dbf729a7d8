"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Texts with the same shingle set form a class; only its document of the smallest
id goes on. One pass hashes every shingle once: the top bits choose one of
BINS bins, the rest compete for the bin's minimum, and an empty bin borrows
from the full bin that its own probe sequence hits first (optimal densification).
BANDS bands of ROWS bins give bucket keys. A bucket's centre is its smallest id
and every document is paired with the smallest of its buckets' centres only, so
there is a candidate edge for each document at most. Edges are confirmed on the
full sets, and make components. Where a bucket still holds several components,
its members outside the largest are held against all members of other
components, block by block, by set size and by a parity bitmap, whose Hamming
distance never exceeds the sets' difference: what these bounds leave is
confirmed on the full sets too. So no link that shares a bucket is lost, and pairs
inside a component are never made. A link of similarity 0.8 misses all buckets with
probability (1 - 0.8**ROWS)**BANDS, under 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm import arrays as A
from sievelake.operators.graph import connected_components
from sievelake.runtime import broadcast_if_small, cut

BINS, ROWS = 512, 8
BANDS = BINS // ROWS
#: Members of a block, rows of a group of blocks, bits of the parity bitmap.
BLOCK, GROUP_ROWS, BITS = 512, 20_000, 512
#: Probes made one by one; where all miss, the table of first visits tells the same sequence's first hit.
PROBES = 64
_EMPTY = np.uint64(2**64 - 1)


def _sets(col: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at, to, buf, starts, ends in A.texts(col):
        low = A.LOWER[buf]
        ws, we, first = A.words(low, starts, ends)
        h, rows = A.shingles(A.word_hashes(low, ws, we), first, k)
        yield at, to, *A.distinct(h, rows)


def _probe(b: np.ndarray, t: int) -> np.ndarray:
    return (A.mix(b.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(t)) >> np.uint64(55)).astype(np.int64)


@lru_cache(1)
def first_visits() -> np.ndarray:
    """[b, x]: the probe of bin b's sequence that comes to bin x first."""
    out = np.full((BINS, BINS), -1, np.int32)
    every = np.arange(BINS)
    t = 0
    while (out < 0).any():
        to = _probe(every, t)
        new = out[every, to] < 0
        out[every[new], to[new]] = t
        t += 1
    return out


def signatures(h: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """BINS minima per row, densified; rows without hashes keep the empty mark."""
    sig = np.full(n_rows * BINS, _EMPTY, np.uint64)
    cell = rows * BINS + (h >> np.uint64(55)).astype(np.int64)
    order = np.lexsort((h, cell))
    c = cell[order]
    lead = np.ones(len(c), bool)
    lead[1:] = c[1:] != c[:-1]
    sig[c[lead]] = h[order][lead]
    sig = sig.reshape(n_rows, BINS)
    has = (sig != _EMPTY).any(axis=1)
    full = sig != _EMPTY
    r, b = np.nonzero(~full & has[:, None])
    out = sig.copy()
    for t in range(PROBES):
        if not len(r):
            break
        to = _probe(b, t)
        hit = full[r, to]
        out[r[hit], b[hit]] = sig[r[hit], to[hit]]
        r, b = r[~hit], b[~hit]
    edge = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        at = np.flatnonzero(full[r[s]])
        out[r[s], b[s:e]] = sig[r[s], at[first_visits()[b[s:e, None], at].argmin(axis=1)]]
    return out


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, c1, c2, bands, bits) per row: set size, two order-free digests of the set, the bucket keys and the parity bitmap."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = A.mix(np.arange(1, BINS + 1, dtype=np.uint64))
        for batch in batches:
            for at, to, h, rows in _sets(batch.column(1), k):
                m = to - at
                n = np.bincount(rows, minlength=m)
                edge = np.append(0, np.cumsum(n))
                sums = []
                for salt in (3, 4):
                    c = np.append(np.uint64(0), np.cumsum(A.mix(h * A.FACTORS[salt])))
                    sums.append((c[edge[1:]] - c[edge[:-1]]).view(np.int64))
                sig = A.mix(signatures(h, rows, m) + factors)
                bands = A.mix(sig.reshape(m, BANDS, ROWS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1)))
                bits = pa.array([x.tobytes() for x in _bitmaps(h, rows, m)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, m), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), keys, bits], ["doc_id", "n", "c1", "c2", "bands", "bits"])

    A.tune(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(A.rested(run), f"doc_id {kind}, n long, c1 long, c2 long, bands array<long>, bits binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, hashes): the distinct shingles of each row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, h, rows in _sets(batch.column(1), k):
                edge = np.append(0, np.cumsum(np.bincount(rows, minlength=to - at))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(edge), pa.array(h.view(np.int64)))], ["doc_id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(A.rested(run), f"doc_id {kind}, hashes array<long>")


def _bitmaps(h: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Parity of the hashes in each of BITS cells, as BITS / 8 bytes per row."""
    cell = rows * BITS + (A.mix(h) >> np.uint64(55)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=n_rows * BITS) & 1).astype(bool).reshape(n_rows, BITS), axis=1)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb) whose full sets have 100 * intersection >= percent * union. Of rows that share an id, any text will do."""
    near = cut(pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = cut(full_sets(texts.join(broadcast_if_small(ids), "doc_id", "left_semi"), k).distinct())
    left = near.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b").withColumn("i", F.size(F.array_intersect("ha", "hb")).cast("long"))
    return cut(both.where(F.col("i") * 100 >= (F.size("ha") + F.size("hb") - F.col("i")) * percent).select("a", "b").distinct())


def _across(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of live bucket members (key, doc_id, c, n, bits) in different components that size and bitmap allow."""
    kind = live.schema["doc_id"].dataType.simpleString()
    by = live.groupBy("key", "c").agg(F.count(F.lit(1)).alias("w"))
    most = by.groupBy("key").agg(F.sum("w").alias("m"), F.max(F.struct("w", "c")).alias("top"))
    most = most.select("key", F.col("top.c").alias("top"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"), F.ceil((F.col("m") - F.col("top.w")) / BLOCK).cast("int").alias("no"))
    rows = live.join(most, "key").withColumn("h", F.xxhash64("doc_id"))
    out = rows.where("c <> top").select("key", F.pmod("h", "no").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(1).alias("side"), "doc_id", "c", "n", "bits")
    all_ = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("i"), F.pmod("h", "nb").cast("int").alias("j"), F.lit(0).alias("side"), "doc_id", "c", "n", "bits")

    def held(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("side", "ascending")])
        key, i, j, side, n = (t[x].to_numpy() for x in ("key", "i", "j", "side", "n"))
        _, c = np.unique(t["c"].to_numpy(), return_inverse=True)
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(edge, np.append(edge[1:], len(key)), strict=True):
            m = s + int(np.searchsorted(side[s:e], 1))
            for r in range(m, e):
                other = slice(s, m)
                ok = (c[other] != c[r]) & (np.minimum(n[other], n[r]) * 100 >= np.maximum(n[other], n[r]) * percent)
                at = np.flatnonzero(ok) + s
                if len(at):
                    far = np.bitwise_count(bits[at] ^ bits[r]).sum(axis=1, dtype=np.int64)
                    at = at[far * (100 + percent) <= (n[at] + n[r]) * (100 - percent)]
                    x.append(np.full(len(at), r))
                    y.append(at)
        x, y = np.concatenate(x), np.concatenate(y)
        return pa.table({"a": t["doc_id"].take(pa.array(x)), "b": t["doc_id"].take(pa.array(y)), "na": pa.array(n[x]), "nb": pa.array(n[y])})

    laid = cut(out.unionByName(all_))
    groups = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-laid.count() // GROUP_ROWS)))).alias("g")
    found = laid.groupBy(groups).applyInArrow(held, f"a {kind}, b {kind}, na long, nb long")
    flip = F.col("a") > F.col("b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(flip, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(flip, F.col("na")).otherwise(F.col("nb")).alias("nb")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text's set is its
    distinct k-word shingles, all its words as one where there are fewer than
    k. Null, empty and blank texts have an empty set and are linked with nothing. Rows
    of equal sets are one class; component_id is the smallest id reachable over
    links with 100 * intersection >= percent * union, kept marks that row. Rows
    repeated with the same id each come back, each judged by its own text, but
    as ends of links they are one document. Further columns of docs play no
    part, whatever their names. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sk = cut(sketches(texts, k))
    some = sk.where("n > 0")
    reps = cut(some.groupBy("c1", "c2", "n").agg(F.min_by(F.struct("bands", "bits"), "doc_id").alias("s"), F.min("doc_id").alias("doc_id")).select("c1", "c2", "n", "doc_id", "s.bands", "s.bits"))
    keys = reps.select(F.explode("bands").alias("key"), "doc_id", "n")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "n")).alias("a")).where("m > 1").select("key", "a")
    members = cut(keys.join(shared, "key"))
    stars = members.groupBy(F.col("doc_id").alias("b"), F.col("n").alias("nb")).agg(F.min("a").alias("a")).where("b <> a.doc_id").select(F.col("a.doc_id").alias("a"), "b", F.col("a.n").alias("na"), "nb")
    links = _confirmed(stars, texts, k, percent)
    comp = cut(connected_components(links, "a", "b"))
    placed = members.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    open_ = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    live = cut(placed.join(open_, "key").join(reps.select("doc_id", "bits"), "doc_id"))
    more = _confirmed(_across(live, percent), texts, k, percent)
    if more.limit(1).count():
        comp = cut(connected_components(links.unionByName(more), "a", "b"))
    final = reps.select("c1", "c2", "n", F.col("doc_id").alias("id")).join(comp, "id", "left").select("c1", "c2", "n", F.coalesce("component", "id").alias("component_id"))
    joined = some.select("doc_id", "n", "c1", "c2").join(final, ["c1", "c2", "n"]).select("doc_id", "n", "component_id")
    out = joined.unionByName(sk.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
