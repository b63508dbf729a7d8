"""Whitening against an eigendecomposition of the exact covariance, with nulls, repeats, other lengths, flat and empty tables."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("n", "v", "dims", "component", "label", "whitened"):
        df = df.withColumn(c, F.lit("x"))
    return df


def check(spark, rows, **how):
    usable = [(i, np.array([float(np.float32(c)) for c in v])) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(v) for _, v in usable)
    dims = max(lengths, key=lambda d: (lengths[d], d))
    usable = [(i, np.floor(1024 * v).astype(int) + 100_000) for i, v in usable if len(v) == dims]
    n = len(usable)
    x = np.stack([v for _, v in usable]).astype(object)
    s = x.sum(axis=0)
    d = n * x - s
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in d.T.dot(d)])
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(8, dims)
    want = (d / n).astype(float) @ vector[:, :k] / np.sqrt(value[:k])
    got = whitening.whiten(table(spark, rows), **how).collect()
    assert len(got) == n * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
        assert abs(r.explained / (value[r.component - 1] / np.trace(cov)) - 1) < 1e-9
    signs = {}
    for (i, _), dev, w in zip(usable, (d * d).sum(axis=1), want, strict=True):
        for c in range(1, k + 1):
            z = [r.whitened for r in by[i, int(dev)][c]]
            signs.setdefault(c, np.sign(z[0] * w[c - 1]) if abs(w[c - 1]) > 0.1 else None)
            if signs[c] is None:
                signs.pop(c)
                continue
            assert min(abs(signs[c] * a - w[c - 1]) for a in z) < 1e-6
    assert len(signs) == k


@pytest.mark.parametrize("parts", [1, 13])
def test_whitening_equals_eigendecomposition(spark, parts, monkeypatch):
    rng = np.random.default_rng(parts)
    base = rng.normal(size=(400, 12)) * np.linspace(1, 0.05, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (500, None), (501, [None] * 12), (502, [float("nan")] + [0.0] * 11), (503, [float("inf")] + [0.0] * 11), (504, [0.5] * 5), (505, []), (506, rows[0][1][:11] + [None])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    df_parts = lambda df: df.repartition(parts)
    made = globals()["table"]
    monkeypatch.setitem(globals(), "table", lambda s, r: df_parts(made(s, r)))
    check(spark, rows)


def test_long_and_hot(spark):
    """A third of all rows is one vector; entries near the limit keep deviations exact."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(c) for c in rng.normal(size=9) * 3000]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(30)]
    check(spark, rows)


def test_few_dims_flat_and_empty(spark):
    check(spark, [(k, [float(k), float(k * k % 7)]) for k in range(20)])
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0
    two = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0])])).collect()
    assert [(r.vec_id, r.component, round(abs(r.whitened), 9)) for r in sorted(two)] == [(1, 1, 1.0), (2, 1, 1.0)]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [(1, [1e30, 1.0]), (2, [0.0, 1.0])])).collect()


def test_merge_is_a_tree():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 7))
    r = None
    for k in range(0, 300, 41):
        r = whitening._fold(r, m[k : k + 41])
    assert np.allclose(r, whitening._fold(None, m)) and (np.diagonal(r) >= 0).all()
