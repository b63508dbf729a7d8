"""Whitening of embeddings by a tall-and-skinny QR (TSQR).

Entries become integers, so sums by dimension are exact. Each partition centres
its rows by them and keeps one triangular factor R, into which batches are folded; the
factors of all partitions are merged in a tree. The right singular vectors of the last R are the
components; the covariance is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.llm import arrays as A
from sievelake.runtime import cut

#: Components kept; factors merged in one group; rows folded into R at once; scale and shift of entries.
COMPONENTS, FAN, ROWS, SCALE, SHIFT = 8, 8, 4096, 1024.0, 100_000
#: A component whose eigenvalue is below this share of the largest has no variance beyond rounding.
FLAT = 1e-24


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, rows x dims of doubles) of the rows of a batch, all of one length, in pieces."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        col = part.column(1)
        values = col.flatten()
        yield part.column(0), np.asarray(values.to_numpy(zero_copy_only=False), np.float64).reshape(len(part), -1)


def _fixed(c: np.ndarray) -> np.ndarray:
    """The entries as integers."""
    x = np.floor(SCALE * c)
    if (np.abs(x) >= 2.0**62).any():
        raise ValueError("an entry is too large for a 64-bit integer")
    return x.astype(np.int64) + SHIFT


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose vector is there and whose entries are all finite."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("v")).where(v.isNotNull() & fine & (F.size(v) > 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for _, c in _vectors(batch):
            x = _fixed(c)
            n += len(x)
            # Halves are added apart, as the sum of many large integers may not fit in 64 bits.
            got = [int(h) * (1 << 32) + int(lo) for h, lo in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
            total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(x) for x in total])], ["dim", "n", "total"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    s = np.array(sums, dtype=object)
    if max(map(abs, sums)) < 2**61 and n * (int(np.abs(x).max(initial=0)) + 1) < 2**61:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def _fold(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The R of rows below an earlier R, with a diagonal that isn't negative."""
    m = rows if r is None else np.concatenate([r, rows])
    out = np.linalg.qr(m, mode="r")
    sign = np.where(np.diagonal(out) < 0, -1.0, 1.0)
    return out[: len(sign)] * sign[:, None]


def _packed(node: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([len(r)], pa.int32()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["node", "height", "r"])


def factor(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: R of each partition, merged by FAN until one is left. Only that last one, dims x dims, comes to the driver."""
    dims = len(sums)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for _, c in _vectors(batch):
                r = _fold(r, (_centred(_fixed(c), n, sums) / n).astype(np.float64))
        if r is not None:
            yield _packed(TaskContext.get().partitionId(), r)

    def merge(table: pa.Table) -> pa.Table:
        r = None
        for _, h, b in sorted(zip(*(table.column(c).to_pylist() for c in ("node", "height", "r")), strict=True)):
            r = _fold(r, np.frombuffer(b, np.float64).reshape(h, dims))
        return pa.Table.from_batches([_packed(table.column("node")[0].as_py() // FAN, r)])

    schema = "node long, height int, r binary"
    level = cut(vectors.mapInArrow(A.rested(local), schema))
    last = level.agg(F.max("node")).first()[0]
    while last:
        level = cut(level.groupBy(F.expr(f"node div {FAN}").alias("up")).applyInArrow(merge, schema))
        last //= FAN
    row = level.first()
    return np.frombuffer(bytes(row["r"]), np.float64).reshape(row["height"], dims)


def _moments(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return z.sum(axis=0), z.T @ z


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row of rows and component.

    Rows whose vector is null or holds null, NaN or infinite entries are left out, as are empty
    vectors and, where lengths differ, those of another length than most (of equal counts, the longest stays).
    Repeated rows each count and each come back; a null id is an id. Components number min(components, dims),
    less those without variance (all of them for one row or for equal rows: then no rows come back). Other columns play no part. An
    entry beyond 64 bits raises, as does a deviation. An empty table gives no rows.
    """
    spark = rows.sparkSession
    A.tune(spark)
    schema = T.StructType([T.StructField("vec_id", rows.schema[id_col].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    all_ = usable(rows, id_col, vector_col)
    size = all_.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    vectors = all_.where(F.size("v") == size["dims"])
    found = vectors.mapInArrow(A.rested(_sums), "dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    n, sums = found[0]["n"], [int(r["total"]) for r in found]
    _, s, vt = np.linalg.svd(factor(vectors, n, sums))
    e = np.zeros(len(sums))
    e[: len(s)] = s**2 / n
    k = int((e[:components] > FLAT * max(e[0], 1e-300)).sum()) if e[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], schema)
    basis, scale, share = vt[:k].T.copy(), np.sqrt(e[:k]), e[:k] / e.sum()

    def project(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _centred(_fixed(c), n, sums)
        return d, (d / n).astype(np.float64) @ basis / scale

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, c in _vectors(batch):
                a, b = _moments(project(c)[1])
                first += a
                second += b
        i, j = (x.ravel() for x in np.indices((k + 1, k)))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([second, first[None]]).ravel())], ["i", "j", "total"])

    summed = vectors.mapInArrow(A.rested(moments), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    m = np.zeros((k + 1, k))
    for r in summed:
        m[r["i"], r["j"]] = r["total"] / n
    error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())
    names = schema.names

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, c in _vectors(batch):
                d, z = project(c)
                big = int(np.abs(d).max(initial=0))
                if big * big * d.shape[1] >= 2**63:  # the bound may be wide of the sums themselves
                    d = d.astype(object)
                total = (d * d).sum(axis=1)
                if d.dtype == object and max(total) >= 2**63:
                    raise ValueError("a deviation is too large for a 64-bit integer")
                at = np.repeat(np.arange(len(c)), k)
                columns = [ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(c))), pa.array(np.full(len(at), n)), pa.array(total.astype(np.int64)[at]), pa.array(z.ravel()), pa.array(np.tile(share, len(c))), pa.array(np.full(len(at), error))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(A.rested(rows_of), schema)
