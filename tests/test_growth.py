import os

import pytest
from pyspark.sql import functions as F

from tickloom.operators import options as O
from tickloom.operators import statarb as Q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_search_the_expiries_without_an_exchange(spark):
    rows = [(t, 0.01 * t * 4, 0.1 * t, -0.4, 0.0, 0.2) for t in (0.1, 0.2, 0.4)]
    params = spark.createDataFrame(rows, "T double, a double, b double, rho double, m double, s double")
    pts = spark.createDataFrame([(0, 0.05, 0.1), (1, 0.1, 0.0), (2, 0.3, -0.2), (3, 0.9, 0.1), (0, 0.05, 0.1), (4, None, 0.1)], "id int, T double, k double")
    got = O.interp_iv(pts, params)
    assert "monotonically_increasing_id" not in plan(got) and plan(got).count("hashpartitioning") == 0
    w = lambda t, k: 0.04 * t + 0.1 * t * (-0.4 * k + (k * k + 0.04) ** 0.5)
    r = got.collect()
    assert len(r) == 6
    want = {0: (w(0.1, 0.1) / 0.1) ** 0.5, 1: (w(0.1, 0.0) / 0.1) ** 0.5, 2: ((w(0.2, -0.2) + w(0.4, -0.2)) / 2 / 0.3) ** 0.5, 3: (w(0.4, 0.1) / 0.4) ** 0.5}
    for x in r:
        assert x.iv is None if x.id == 4 else x.iv == pytest.approx(want[x.id])


def test_bump_greeks_price_each_bump_once(spark):
    d = spark.createDataFrame([(1, 150.0, 140.0, 0.25, 0.045, 0.013, 0.2, 1), (2, 150.0, 165.0, 0.5, 0.045, 0.013, 0.25, -1)], "id int, S double, K double, T double, r double, q double, v double, cp int")
    args = ("S", "K", "T", "r", "q", "v", "cp")
    calls = []

    def pricer(*a):
        calls.append(1)
        return O.bsm_price_once(*a)
    got = {r.id: r for r in O.bump_greeks(d, ["id"], pricer, *args).collect()}
    assert len(calls) == 1
    for x in d.select("id", O.bsm_price(*args).alias("a"), O.bsm_price_once(*args).alias("b"), *[c.alias(n) for n, c in {**O.greeks(*args), "vanna": O.second_order(*args)["vanna"]}.items()]).collect():
        assert x.a == x.b
        for n in ("delta", "gamma", "vega", "theta", "rho", "vanna"):
            assert got[x.id][n] == pytest.approx(x[n], rel=1e-3, abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_vintages_are_dealt_once(spark):
    from __spark_entry__ import QUERIES
    assert plan(QUERIES["first_release_revisions"](spark, SF)).count("Exchange hashpartitioning") <= 1


def test_pair_legs_read_their_prices_once(spark):
    p = spark.createDataFrame([("s", "a", 1, 2.0), ("s", "b", 1, 3.0)], "sector string, symbol string, d int, x double")
    assert plan(Q.sector_pairs(p.where("x > 1"), "sector", "symbol", "d", "x")).count("InMemoryRelation") >= 1


def test_orders_keep_seen_executions_in_one_state(spark):
    import pandas as pd

    from tickloom.operators.ledger import NEXT, STATES
    from tickloom.streaming.twins import Orders

    class Value:
        v, calls = None, 0

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            Value.calls += 1
            self.v = v

    class Handle:
        def getValueState(self, *_):
            return Value()

    o = Orders(STATES, NEXT)
    o.init(Handle())
    batch = lambda *r: iter([pd.DataFrame([dict(ts=i, seq=i, kind="fill", state=None, exec_id=e, qty=2.0, price=1.0, order_qty=10.0) for i, e in r])])
    a = list(o.handleInputRows(("k",), batch((0, "x"), (1, "y"), (2, "x")), None))[0]
    b = list(o.handleInputRows(("k",), batch((3, "y"), (4, "z")), None))[0]
    assert list(a.filled) == [2.0, 4.0, 4.0] and list(b.filled) == [4.0, 6.0] and Value.calls == 2
