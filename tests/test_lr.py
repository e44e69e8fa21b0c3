"""LR baseline: the fit equals an independent Newton solve of the same objective."""

import numpy as np
import pytest

from judgefuse.operators import baseline_lr as LR


def newton(X, y, w, C, iters=100):
    """minimise C * sum w_i * logloss_i + 0.5 * ||beta||^2 (intercept unpenalised)."""
    n, d = X.shape
    Xa = np.hstack([X, np.ones((n, 1))])
    b = np.zeros(d + 1)
    reg = np.eye(d + 1)
    reg[d, d] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xa @ b))
        g = C * Xa.T @ (w * (p - y)) + reg @ b
        H = C * (Xa.T * (w * p * (1 - p))) @ Xa + reg
        step = np.linalg.solve(H, g)
        b -= step
        if np.abs(step).max() < 1e-13:
            break
    return b[:d], b[d]


def test_fit_matches_newton(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        cid = f"c{i // 3}"
        gui, code, nr = (float(rng.integers(0, 2)) for _ in range(3))
        agent = float(rng.integers(0, 2)) if i % 3 == 2 else None
        label = int((gui + code + rng.random()) > 1.4)
        rows.append((cid, i, gui, code, nr, agent, label))
    df = spark.createDataFrame(rows, "test_case_id string, ord long, E1_gui double, E2_code double, "
                                     "E4_noresp double, agent double, phi int")
    # phi is constant per case in real data: take the last label of each case
    feats = LR.case_features(df)
    p = LR.fit(feats, C=1.0)
    pdf = feats.toPandas()
    X = pdf[list(LR.FEATURES)].to_numpy(float)
    y = pdf["label"].to_numpy(float)
    mu, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1.0
    Xs = (X - mu) / sd
    n1 = y.sum(); n0 = len(y) - n1
    w = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    coef, icpt = newton(Xs, y, w, 1.0)
    got = np.array([p.coefficients[f] for f in LR.FEATURES])
    assert np.allclose(p.scaler_mean, mu, atol=1e-12)
    assert np.allclose(p.scaler_scale, sd, atol=1e-12)
    assert np.allclose(got, coef, atol=1e-9)
    assert p.intercept == pytest.approx(icpt, abs=1e-9)


def test_fit_needs_both_classes_and_bears_separable_ones(spark):
    rows = [(f"c{i}", i, float(i % 2), 1.0, 0.0, 1.0, i % 2) for i in range(40)]
    cols = "test_case_id string, ord long, E1_gui double, E2_code double, E4_noresp double, agent double, phi int"
    feats = LR.case_features(spark.createDataFrame(rows, cols))
    p = LR.fit(feats)   # a perfectly separating channel, and channels without any spread
    assert max(abs(v) for v in LR.optimality(feats, p).values()) < 1e-8
    for some in (feats.filter("label = 1"), feats.limit(0)):
        with pytest.raises(ValueError, match="both classes"):
            LR.fit(some)
