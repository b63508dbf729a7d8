"""Quality by importance resampling: hashed n-gram models of target and raw text, rows drawn by Gumbel top-k.

The target model counts the n-grams of a bounded sample of rows labelled good,
the raw model those of all rows. A row's log weight is the mean log ratio of its
n-grams under the two, so its length doesn't count; with Gumbel noise added, the
k largest keys are a draw without replacement in proportion to the weights.

Zero and unit of the weights come from the good rows themselves: each is
weighted by a model of the other folds of the sample, and the median of these
means is 0, their 5 % quantile -UNIT. k defaults to the number of rows no worse
than -slack, so the draw keeps what looks like the target as good rows do that
the model hasn't seen, and rejects what doesn't, whatever the sample's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm import arrays as A
from sievelake.runtime import broadcast_if_small, cut

#: Buckets of the hashed n-gram models; rows labelled good that the target model is fitted on, at most.
BUCKETS = 1 << 14
SAMPLE_ROWS = 6000
#: Nats between the median and the 5 % quantile of unseen good rows; nats below the median down to which a row counts towards k.
UNIT, SLACK = 4.0, 16.0
#: n-grams of the raw model that are mixed into the target's, as a share of the sample's: a small sample says little of rare n-grams.
SHARE = 0.1
#: Parts of the sample of which each is weighted by a model of the others; with fewer good rows than that nothing is rejected.
FOLDS = 10
#: Keys are fixed-point numbers of 36 bits, so that the k-th is found in three rounds of 4096 counts.
_SCALE, _HALF, _TOP = 1 << 10, 1 << 35, (1 << 36) - 1
_CLASS = np.full(256, 2, np.uint8)
_CLASS[A.SPACE] = 0
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
_SAME = np.uint64(0x5A11E5A11E5A11E5)


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each unigram and bigram. Tokens are runs of word characters or of other marks, lower-cased; a token that repeats the one before makes the same bigram whatever it is."""
    cls = _CLASS[buf]
    lead = np.ones(len(buf), bool)
    lead[1:] = cls[1:] != cls[:-1]
    lead[starts[starts < len(buf)]] = True
    s = np.flatnonzero(lead)
    e = np.append(s[1:], len(buf))
    token = cls[s] > 0
    s, e = s[token], e[token]
    h = A.word_hashes(A.LOWER[buf], s, e)
    first = np.append(np.searchsorted(s, starts), len(s))
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    two = A.mix(h[pair] * A.FACTORS[5] + h[pair + 1])
    two[h[pair] == h[pair + 1]] = _SAME
    return np.append(rows, rows[pair]), np.append(h, two) >> np.uint64(50)


def counts(texts: DataFrame, folds: int = 1) -> np.ndarray:
    """n-gram counts by fold and bucket over all rows of (fold, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(folds * BUCKETS, np.int64)
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, to, buf, starts, ends in A.texts(batch.column(1)):
                rows, bucket = grams(buf, starts, ends)
                total += np.bincount(fold[at:to][rows] * BUCKETS + bucket.astype(np.int64), minlength=folds * BUCKETS)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["bucket", "n"])

    out = np.zeros(folds * BUCKETS, np.int64)
    for r in texts.mapInArrow(A.rested(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out.reshape(folds, BUCKETS)


def ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the target and the raw model, by bucket; 0 without a target."""
    if not target.sum():
        return np.zeros(BUCKETS)
    q = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    more = SHARE * target.sum()
    return np.log((target + more * q) / (target.sum() + more) / q)


def means(docs: DataFrame, tables: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mean) per row of docs with a column fold: the mean log ratio of its n-grams by the fold's table; null where there are none."""
    kind = docs.schema[id_col].dataType.simpleString()
    flat = tables.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, to, buf, starts, ends in A.texts(batch.column(1)):
                rows, bucket = grams(buf, starts, ends)
                w = np.bincount(rows, flat[fold[at:to][rows] * BUCKETS + bucket.astype(np.int64)], minlength=to - at).astype(np.float64)
                n = np.bincount(rows, minlength=to - at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(w / np.maximum(n, 1), mask=n == 0)], ["doc_id", "mean"])

    A.tune(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col), F.col("fold")).mapInArrow(A.rested(run), f"doc_id {kind}, mean double")


def weights(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, log_weight) of every row of docs (id, text): 0 at the median of unseen good rows and -UNIT at their 5 % quantile; 0 where a row has no n-grams, and everywhere with fewer than FOLDS good rows."""
    A.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = cut(good.select(F.col("doc_id")).where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))
    target = counts(sample.select("fold", "text"), FOLDS)
    one = rows.withColumn("fold", F.lit(0))
    raw = counts(one.select("fold", "text"))[0]
    unseen = means(sample, np.stack([ratio(target.sum(axis=0) - t, raw) for t in target]))
    n, q = unseen.agg(F.count("mean"), F.percentile("mean", [0.5, 0.05])).first()
    if n < FOLDS:
        return rows.select("doc_id", F.lit(0.0).alias("log_weight"))
    unit = UNIT / max(q[0] - q[1], 1e-3)
    return means(one, ratio(target.sum(axis=0), raw)[None]).select("doc_id", F.coalesce((F.col("mean") - q[0]) * unit, F.lit(0.0)).alias("log_weight"))


def gumbel(seed: int):
    """Noise drawn from the id, so every run and retry draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the 36-bit numbers in column `key`, exactly, from three rounds of at most 4096 counts."""
    if k <= 0:
        return None
    prefix, left = 0, k
    for shift in (24, 12, 0):
        part = keys.where(F.shiftright("key", shift + 12) == prefix).groupBy(F.shiftright("key", shift).alias("b")).count().collect()
        for r in sorted(part, key=lambda r: -r["b"]):
            prefix = r["b"]
            if r["count"] >= left:
                break
            left -= r["count"]
        else:
            return 0
    return prefix


def resample(docs: DataFrame, good: DataFrame, k: int | None = None, slack: float = SLACK, sample_rows: int = SAMPLE_ROWS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_weight, kept) of every row of docs; good names the doc_ids of target rows.

    Null, empty and n-gram-less texts have log weight 0 and are kept unless k is
    given. Rows whose key equals the k-th are all kept, so repeated rows share
    their fate and k may be exceeded by ties. Fewer than FOLDS good rows with
    text: all weights are 0 and all rows are kept. An empty table gives no rows.
    Other columns play no part, whatever their names.
    """
    scored = cut(weights(docs, good, id_col, text_col, sample_rows).withColumn("gumbel", gumbel(seed)))
    if k is None:
        k = scored.where(F.col("log_weight") >= -slack).count()
    key = F.least(F.lit(_TOP), F.greatest(F.lit(0), F.floor((F.col("log_weight") + F.col("gumbel")) * _SCALE) + _HALF)).cast("long")
    keyed = scored.withColumn("key", key)
    floor = kth_largest(keyed, k)
    return keyed.select("doc_id", "log_weight", (F.col("key") >= floor if floor is not None else F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, good: DataFrame, **more) -> DataFrame:
    """docs without the rows that resample() rejects. Rows with a null id always stay; rows that share an id go together if one of them goes."""
    out = cut(resample(docs.select("doc_id", "text"), good, **more).where("NOT kept").select("doc_id").distinct())
    return docs.join(broadcast_if_small(out), "doc_id", "left_anti").select(docs.columns)
