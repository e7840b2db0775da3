"""Path rules against their definitions, row by row, also when the rows come in pieces."""
import numpy as np
import pytest

from tickloom.operators import portfolio
from tickloom.paths import ratchet, reflected_alarms, swings, trailing


@pytest.mark.parametrize("cut", [1, 7, 400])
def test_reflected_alarms(cut):
    x = np.random.default_rng(0).normal(0, 1, (2, 400))
    level, want = np.zeros(2), []
    for v in x.T:
        level = np.maximum(0, level + v)
        want.append(bool((level > 6).any()))
        if want[-1]:
            level = np.zeros(2)
    got, state = [], np.zeros(2)
    for i in range(0, 400, cut):
        flags, state = reflected_alarms(x[:, i:i + cut], state, 6)
        got += flags.tolist()
    assert got == want and 5 < sum(want) < 100
    assert np.allclose(state, level)


@pytest.mark.parametrize("cut", [1, 13, 500])
def test_ratchet(cut):
    rng = np.random.default_rng(1)
    close = 100 + np.cumsum(rng.normal(0, 1, 500))
    band = close + rng.uniform(1, 4, 500)
    f, last, want = 102.0, 100.0, []
    for b, c in zip(band, close):
        f, last = (b if last > f else min(f, b)), c
        want.append(f)
    got, f, last = [], 102.0, 100.0
    for i in range(0, 500, cut):
        part = ratchet(band[i:i + cut], close[i:i + cut], f, last)
        got += part.tolist()
        f, last = part[-1], close[i:i + cut][-1]
    assert got == want and len(set(want)) > 20


@pytest.mark.parametrize("cut", [1, 9, 600])
def test_swings(cut):
    rng = np.random.default_rng(2)
    mid = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 600)))
    high, low = np.round(mid * 1.003, 1), np.round(mid * 0.997, 1)
    got, st = [], [0.0, -1.0, 0.0, 0.0, 0.0]
    for i in range(0, 600, cut):
        found, st = swings(np.arange(i, min(i + cut, 600)), high[i:i + cut], low[i:i + cut], 0.03, st)
        got += [(k + i, *p) for k, *p in found]
    # every pivot is the last extreme between the pivots around it, and its reversal is the first row 3 % away from it
    assert len(got) > 8 and all(a[3] == -b[3] for a, b in zip(got, got[1:]))
    start = 0
    for n, (confirm, at, price, kind) in enumerate(got):
        side = high if kind == 1 else -low
        lo = start if n else 0
        assert price == (high if kind == 1 else low)[int(at)] and side[int(at)] == side[lo:confirm + 1].max() and (side[int(at) + 1:confirm + 1] < side[int(at)]).all()
        opposite = low[int(at) + 1:confirm] <= price * 0.97 if kind == 1 else high[int(at) + 1:confirm] >= price * 1.03
        assert not opposite.any()
        assert low[confirm] <= price * 0.97 if kind == 1 else high[confirm] >= price * 1.03
        start = confirm


def test_trailing():
    v, st, got = np.arange(20.0), [], []
    for part in np.array_split(v, 6):
        at, win, st = trailing(part, st, 5)
        assert len(at) == len(win) and (at < len(part)).all()
        got += win.max(axis=1).tolist() if len(win) else []
    assert got == v[4:].tolist() and len(st) == 4


def _cov():
    a = np.random.default_rng(3).normal(0, 1, (200, 6)) @ np.random.default_rng(4).normal(0, 1, (6, 6))
    cov = np.cov(a.T)
    sd = np.sqrt(np.diag(cov))
    return cov, cov / np.outer(sd, sd)


def test_hierarchical_parity_splits_risk():
    cov, cor = _cov()
    w = portfolio.hrp(list("abcdef"), None, cov, cor)
    assert np.isclose(w.sum(), 1) and (w > 0).all()
    two = portfolio.hrp(list("ab"), None, cov[:2, :2], cor[:2, :2])
    assert np.allclose(two, np.array([cov[1, 1], cov[0, 0]]) / (cov[0, 0] + cov[1, 1]))
    # independent equal assets get equal weights
    assert np.allclose(portfolio.hrp(list("abcd"), None, np.eye(4), np.eye(4)), 0.25)


def test_views_move_means_as_the_joint_posterior():
    cov, _ = _cov()
    names, views, targets = list("abcdef"), [{"a": 1.0, "b": -1.0}, {"c": 1.0}], [0.02, 0.05]
    got = portfolio.black_litterman(lambda n: 1 / 6, P=views, Q=targets)(names, None, cov, None)
    prior, p = 2.5 * cov @ np.full(6, 1 / 6), np.array([[v.get(n, 0) for n in names] for v in views])
    t = 0.05 * cov
    # all views at once: prior plus gain times what the views say beyond it
    gain = t @ p.T @ np.linalg.inv(p @ t @ p.T + np.diag(np.diag(p @ t @ p.T)))
    assert np.allclose(got, prior + gain @ (np.array(targets) - p @ prior))
    assert np.allclose(portfolio.black_litterman(lambda n: 1 / 6)(names, None, cov, None), prior)
