import math

import numpy as np
import pytest
from pyspark.sql import types as T

from judgefuse.llm import queries, whitening as W

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("n", T.StringType())])


def plain(rows, k=16):
    """The contract with numpy's own decomposition and Python integers."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * c - t) / n for c, t in zip(v, s)] for v in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u.T[::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    out = {}
    for i, v in x.items():
        own = np.array([float(n * c - t) / n for c, t in zip(v, s)])
        for j in range(k):
            out[i, j + 1] = (n, sum((n * c - t) ** 2 for c, t in zip(v, s)), float(own @ u[j] / math.sqrt(e[j])), e[j] / e.sum())
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        n, deviation, w, explained = want[r.vec_id, r.component]
        s = sign.setdefault(r.component, 1 if r.whitened * w > 0 else -1)
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(s * w, abs=1e-7)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert 0 <= r.identity_error < 1e-9


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    scale = np.linspace(0.1, 1, d)
    return [(i, (rng.standard_normal(d) * scale).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed,n,d", [(1, 300, 24), (2, 40, 5)])
def test_against_numpy(spark, seed, n, d):
    rows = vectors(seed, n, d)
    rows += [(n + i, v) for i, v in rows[:30]]  # copies count once in the fit
    check(W.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)).collect(), plain(rows))


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op12_embedding_whitening(spark, sf).collect()
    check(got, plain(rows))
    assert len(got) == 16 * len(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(3, 30, 4)
    bad = [(100, None), (101, []), (102, [1.0, nan, 0.0, 0.0]), (103, [1.0, inf, 0.0, 0.0]), (104, [None, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad + [(None, good[0][1])]], SCHEMA)
    got = W.whiten(df).collect()
    check([r for r in got if r.vec_id is not None], plain(good))
    assert sum(r.vec_id is None for r in got) == 4
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.limit(0)).columns == W.whiten(df).columns
    one = spark.createDataFrame([(1, [0.5, 0.25], "x"), (2, [0.5, 0.25], "x")], SCHEMA)
    assert W.whiten(one).count() == 0                       # no spread, no component
    line = spark.createDataFrame([(i, [i / 64, i / 32], "x") for i in range(9)], SCHEMA)
    assert {r.component for r in W.whiten(line).collect()} == {1}   # rank one


@pytest.mark.parametrize("seed", range(4))
def test_inertia_counts(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    a[:5, :5] = 0  # zero pivots on the diagonal
    e = np.linalg.eigvalsh(a)
    for s in [*rng.uniform(e[0] - 1, e[-1] + 1, 25), 0.0]:
        assert W.above(a, s) == int((e > s).sum())


def test_close_tied_and_zero_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((12, 12)))[0]
    e = np.array([9, 9, 9, 4, 4 - 1e-9, 3, 1, 1e-3, 1e-6, 0, 0, 0.0])
    a = q @ np.diag(e) @ q.T
    a = (a + a.T) / 2
    values, vectors_ = W.Spectrum(a).eigenpairs(16)
    assert len(values) == 9 and np.allclose(values, e[:9], rtol=1e-9, atol=1e-12)
    assert np.abs(vectors_ @ vectors_.T - np.eye(9)).max() < 1e-6
    assert np.abs(vectors_ @ a - values[:, None] * vectors_).max() < 1e-12
    assert len(W.Spectrum(np.zeros((3, 3))).eigenpairs(2)[0]) == 0
