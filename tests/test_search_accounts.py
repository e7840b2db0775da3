"""Halving and random search against loops over pandas; account rows."""
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import accounts, search
from tickloom.series import Series, SeriesSpec

SPEC = SeriesSpec(("symbol",), ("ts",))
FAST, SLOW = [3, 5], [10, 20, 40]


def test_halving_against_a_loop(spark, bars, prices):
    rows = search.crossover_rows(Series.of(bars, SPEC), FAST + SLOW)
    got = {(r.symbol, r.rung, r.config): r for r in search.halving(rows, ["symbol"], search.grid(fast=FAST, slow=SLOW), search.crossover_pnl(), 3, 0.5).collect()}
    configs = list(itertools.product(FAST, SLOW))
    seen = 0
    for sym, g in prices.groupby("symbol"):
        c = g.sort_values("ts").close.reset_index(drop=True)
        ret = c.shift(-1) / c - 1
        alive = list(range(len(configs)))
        for rung, left in enumerate(search.survivors(len(configs), 3, 0.5), 1):
            n = int(len(c) * 2.0 ** (rung - 3))
            score = {}
            for i in alive:
                f, s = c.rolling(configs[i][0]).mean(), c.rolling(configs[i][1]).mean()
                pnl = (ret * np.where(f > s, 1, -1)).where(s.notna())[:n].dropna()
                score[i] = pnl.mean() if len(pnl) else -np.inf
                r = got[(sym, rung, i)]
                assert r.rows == len(pnl) and (r.fast, r.slow) == configs[i]
                assert (r.score is None) == (len(pnl) == 0) and (r.score is None or abs(r.score - score[i]) < 1e-12)
                seen += 1
            alive = sorted(alive, key=lambda i: (-round(score[i], 12) if np.isfinite(score[i]) else np.inf, i))[:left]
            assert {i for (a, b, i), r in got.items() if (a, b) == (sym, rung) and r.kept} == set(alive)
    assert seen == len(got)


def test_survivor_is_that_of_the_full_grid(spark):
    """On a trend with a saw tooth one config is best at every length: halving ends where the full grid does."""
    n = 400
    close = 100 * np.exp(0.001 * np.arange(n) + 0.03 * np.sin(np.arange(n) * 2 * np.pi / 24))
    d = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n), "close": close}))
    rows = search.crossover_rows(Series.of(d, SPEC), FAST + SLOW)
    full = search.halving(rows, ["symbol"], search.grid(fast=FAST, slow=SLOW), search.crossover_pnl(), 1, 1 / 6).where("kept").collect()
    half = search.halving(rows, ["symbol"], search.grid(fast=FAST, slow=SLOW), search.crossover_pnl(), 3, 0.4).where("kept and rung = 3").collect()
    assert len(full) == len(half) == 1 and full[0].config == half[0].config and abs(full[0].score - half[0].score) < 1e-15


def test_random_picks_are_even_and_seeded(spark):
    pick = lambda seed: spark.range(1).select(F.inline(search.random_picks(3000, seed, a=[1, 2, 3], b=[0.5, 1.5]))).collect()
    one, same, other = pick(1), pick(1), pick(2)
    assert one == same and one != other and [r.config for r in one] == list(range(3000))
    for want in itertools.product([1, 2, 3], [0.5, 1.5]):
        assert abs(sum((r.a, r.b) == want for r in one) - 500) < 100


def test_empty_rows(spark):
    d = spark.createDataFrame([], "symbol string, ts timestamp, close double")
    rows = search.crossover_rows(Series.of(d, SPEC), FAST + SLOW)
    assert search.halving(rows, ["symbol"], search.grid(fast=FAST, slow=SLOW), search.crossover_pnl()).count() == 0


def test_account_rows(spark):
    d = spark.createDataFrame([(1, True, None, True, 4, "100"), (2, False, True, False, 2, "1"), (3, None, None, None, None, None), (4, False, False, False, 3, "25000"), (5, False, False, False, 3, None)],
                              "id int, trading_blocked boolean, account_blocked boolean, pattern_day_trader boolean, daytrade_count int, equity string")
    got = {r.id: r.w for r in d.select("id", accounts.account_warnings().alias("w")).collect()}
    assert got == {1: ["trading blocked", "pattern day trader", "day trades: 4", "low equity"], 2: ["trading blocked"], 3: [], 4: ["day trades: 3"], 5: ["day trades: 3", "low equity"]}
    v = spark.createDataFrame([("a", "NetLiquidation", "10.5", "USD"), ("a", "NetLiquidation", "99", "EUR"), ("a", "Leverage", "2", "USD"), ("b", "BuyingPower", "x", "USD"), ("c", "BuyingPower", "1", "EUR")],
                              "acc string, tag string, value string, currency string")
    s = {r.acc: r for r in accounts.account_summary(v, ["acc"]).collect()}
    assert set(s) == {"a", "b"} and float(s["a"].NetLiquidation) == 10.5 and s["a"].BuyingPower is None and s["b"].BuyingPower is None
