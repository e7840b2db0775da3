"""Allocation solvers against their optimality conditions and a brute-force search."""
import itertools

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import allocation as A


def cov_of(rng, n):
    x = rng.normal(0, 1, (3 * n, n)) * rng.uniform(0.2, 2, n) + rng.normal(0, 1, (3 * n, 1))
    return np.cov(x.T)


@pytest.mark.parametrize("n, cap", [(2, 1.0), (8, 0.3), (25, 0.1), (25, 0.04), (40, 1.0)])
def test_min_variance_gap(n, cap):
    rng = np.random.default_rng(n)
    cov = cov_of(rng, n)
    w, gap = A.min_variance_gap(cap)(None, None, cov, None)
    assert gap <= 1e-10 and abs(w.sum() - 1) < 1e-9 and w.min() >= -1e-12 and w.max() <= cap + 1e-9
    for _ in range(200):
        v = A.cheapest(rng.normal(0, 1, n), cap)
        u = 0.5 * w + 0.5 * v
        assert u @ cov @ u >= w @ cov @ w * (1 - 1e-9)


def test_cap_that_cannot_be_met():
    with pytest.raises(ValueError):
        A.min_variance_gap(0.1)(None, None, np.eye(3), None)


def test_risk_parity_gap():
    cov = cov_of(np.random.default_rng(1), 12)
    w, gap = A.risk_parity_gap()(None, None, cov, None)
    part = w * (cov @ w)
    assert gap <= 1e-10 and np.allclose(part / part.sum(), 1 / 12, atol=1e-9)


@pytest.mark.parametrize("k, n, cap", [(1, 3, 1.0), (6, 4, 0.5), (30, 10, 0.2)])
def test_master_bound_and_point_meet(k, n, cap):
    g = np.random.default_rng(k).normal(0, 1, (k, n))
    w, low = A.master(g, cap)
    assert abs((g @ w).max() - low) < 1e-7 and w.max() <= cap + 1e-9


def cvar(R, w, alpha):
    loss = np.sort(-R @ w)[::-1]
    m = (1 - alpha) * len(R)
    k = int(np.floor(m))
    return (loss[:k].sum() + (m - k) * loss[k]) / m


def test_min_cvar_against_a_fine_grid(spark):
    rng = np.random.default_rng(6)
    R = rng.standard_t(4, (90, 3)) * [0.01, 0.02, 0.015] + 0.001
    d = pd.DataFrame([(i, f"s{j}", R[i, j]) for i, j in itertools.product(range(90), range(3))] + [(91, "s0", None)], columns=["day", "symbol", "ret"])
    out = A.min_cvar(spark.createDataFrame(d), "day", "symbol", "ret", alpha=0.93, cap=0.7).toPandas().sort_values("symbol")
    assert out.gap.max() <= 1e-6 and abs(out.weight.sum() - 1) < 1e-9 and out.weight.max() <= 0.7 + 1e-9
    assert abs(cvar(R, out.weight.to_numpy(), 0.93) - out.cvar.iloc[0]) < 1e-9
    grid = [np.array([a, b, 1 - a - b]) for a in np.arange(0, 0.7001, 0.01) for b in np.arange(0, 0.7001, 0.01) if 0 <= 1 - a - b <= 0.7]
    assert out.cvar.iloc[0] <= min(cvar(R, w, 0.93) for w in grid) + 1e-9
