"""Hidden Markov models in blocks against plain loops over all rows."""
import numpy as np
import pandas as pd
import pytest

from tickloom.operators import hmm
from tickloom.series import RN, Series, SeriesSpec


def chain(rng, n, scale=(0.5, 2.0), shift=(0.0, 0.3), stay=0.97):
    s, out = 0, []
    for _ in range(n):
        s = s if rng.random() < stay else 1 - s
        out.append((s, rng.normal(shift[s], scale[s])))
    return np.array([a for a, _ in out]), np.array([b for _, b in out])


def plain(x, par, n):
    """Forward, backward and Viterbi, one row after another."""
    pi, A, mu, var = hmm.unpack(par, n)
    B = np.exp(hmm.log_density(x, mu, var))
    f, c, g = np.empty_like(B), np.empty(len(x)), np.empty_like(B)
    for t in range(len(x)):
        v = (pi if t == 0 else f[t - 1] @ A) * B[t]
        c[t] = v.sum()
        f[t] = v / c[t]
    z, moves = np.ones(n), np.zeros((n, n))
    for t in range(len(x) - 1, -1, -1):
        g[t] = f[t] * z / (f[t] * z).sum()
        if t:
            p = f[t - 1][:, None] * A * (B[t] * z)
            moves += p / p.sum()
            z = A @ (B[t] * z)
            z = z / z.sum()
    with np.errstate(divide="ignore"):
        la, lb = np.log(A), hmm.log_density(x, mu, var)
        d, back = np.log(pi) + lb[0], []
    for t in range(1, len(x)):
        s = d[:, None] + la
        back.append(s.argmax(0))
        d = s.max(0) + lb[t]
    path = [int(d.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return f, g, moves, np.log(c).sum(), np.array(path[::-1])


def plain_fit(x, n, limit=500, tol=1e-10):
    par, was = hmm.begun(x, n), -np.inf
    for _ in range(limit):
        f, g, moves, total, _ = plain(x, par, n)
        if total - was <= tol * max(1, abs(total)):
            break
        was = total
        w = g.sum(0)
        mu = (g * x[:, None]).sum(0) / w
        par = hmm.pack(g[0], moves / moves.sum(1, keepdims=True), mu, (g * (x[:, None] - mu) ** 2).sum(0) / w + hmm.FLOOR)
    return par, total


@pytest.mark.parametrize("n, rows", [(2, 1), (2, 2), (2, 50), (3, 333), (1, 20)])
def test_chunks_of_one_block(n, rows):
    rng = np.random.default_rng(rows)
    x = rng.normal(0, 1, rows) * np.where(np.arange(rows) % 50 < 25, 1, 3)
    par = hmm.begun(x, n)
    f, g, moves, total, path = plain(x, par, n)
    b = hmm.Block(x, par, n, True)
    a, z = b.enter(np.full(n, 1 / n), np.ones(n), b.products())
    ff, t = b.forward(a)
    gg, m = b.backward(a, ff, z)
    assert np.allclose(b.flat(ff), f, atol=1e-12) and np.allclose(b.flat(gg), g, atol=1e-12) and np.allclose(m, moves, atol=1e-9) and abs(t - total) < 1e-8
    last = np.array([p for p in b.best_products()])
    score = np.zeros(n)
    for p in last:
        score = (score[:, None] + p).max(0)
    assert (b.path(np.zeros(n), int(score.argmax())) == path).all()


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    out = []
    for key, n in (("hot", 700), ("small", 120), ("one", 1), ("flat", 40)):
        x = np.zeros(n) if key == "flat" else chain(rng, n)[1]
        out.append(pd.DataFrame({"symbol": key, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "x": x}))
    out.append(pd.DataFrame({"symbol": "hot", "ts": pd.date_range("2023-01-01", periods=9, freq="h"), "x": np.nan}))
    d = spark.createDataFrame(pd.concat(out)).selectExpr("symbol", "ts", "nullif(x, cast('NaN' as double)) as x")
    return Series.of(d, SeriesSpec(("symbol",), ("ts",)))


def test_many_blocks_equal_one_loop(series):
    rows, fitted = hmm.hmm_regimes(series, "x", block=64)
    fit = {r.symbol: r for r in fitted.collect()}
    got = rows.toPandas()
    data = series.flat().df.where("x is not null").select("symbol", RN, "x").toPandas()
    assert len(got) == len(data)
    for key, d in data.groupby("symbol"):
        d = d.sort_values(RN)
        x = d.x.to_numpy() - d.x.mean()
        r = fit[key]
        assert r.settled and r.gain <= 1e-10
        mine = got[got.symbol == key].sort_values(RN)
        assert (mine[RN].to_numpy() == d[RN].to_numpy()).all()
        f, g, _, total, path = plain(x, r.par, 2)
        o = np.argsort(hmm.unpack(r.par, 2)[3], kind="stable")
        assert abs(total - r.loglik) < 1e-6
        assert np.allclose(np.stack(mine.filtered), f[:, o], atol=1e-9) and np.allclose(np.stack(mine.smoothed), g[:, o], atol=1e-9)
        if key != "flat":
            assert (mine.state.to_numpy() == np.argsort(o)[path]).all()
        best = plain_fit(x, 2)[1] if len(x) > 100 else total
        assert r.loglik >= best - 1e-4 * abs(best)


def test_states_are_found_and_filter_looks_back_only(spark):
    rng = np.random.default_rng(8)
    truth, x = chain(rng, 1500, (0.3, 3.0), (0, 0))
    d = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=1500, freq="h"), "x": x}))
    c = hmm.Chain(Series.of(d, SeriesSpec(("symbol",), ("ts",))), "x", block=200)
    fitted = c.fit()
    rows = c.states(fitted).toPandas().sort_values(RN)
    assert (rows.state.to_numpy() == truth).mean() > 0.95
    assert ((np.stack(rows.filtered)[:, 1] > 0.5) == truth).mean() > 0.9
    m = hmm.model(fitted, ["symbol"]).toPandas()
    assert m.variance.is_monotonic_increasing and abs(np.sqrt(m.variance[0]) - 0.3) < 0.05 and abs(np.sqrt(m.variance[1]) - 3) < 0.4 and all(abs(sum(v) - 1) < 1e-9 for v in m.moves)
    cut = d.where("ts < timestamp'2024-02-01'")
    short = hmm.Chain(Series.of(cut, SeriesSpec(("symbol",), ("ts",))), "x", block=130)
    shifted = fitted.selectExpr("symbol", "par")
    # the mean is taken off, so give the short series the model of its own offset
    off = float(cut.agg({"x": "avg"}).first()[0]) - float(x.mean())
    par = [(r.symbol, [*r.par[:6], *[m - off for m in r.par[6:8]], *r.par[8:]]) for r in shifted.collect()]
    part = short.states(spark.createDataFrame(par, "symbol string, par array<double>")).toPandas().sort_values(RN)
    assert np.allclose(np.stack(part.filtered), np.stack(rows.filtered)[:len(part)], atol=1e-9)
