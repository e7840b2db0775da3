"""Expanding medians in blocks against pandas."""
import numpy as np
import pandas as pd
import pytest

from tickloom.operators.expanding import expanding_median
from tickloom.series import RN, Series, SeriesSpec


@pytest.mark.parametrize("block, ranges", [(16, 8), (1, 64), (4096, 512)])
def test_expanding_median(spark, block, ranges):
    rng = np.random.default_rng(block)
    parts = []
    for key, n in (("hot", 300), ("ties", 120), ("down", 90), ("one", 1), ("none", 3)):
        x = {"hot": rng.normal(0, 1, n).cumsum(), "ties": rng.integers(0, 3, n).astype(float), "down": -np.arange(n) ** 1.5, "one": np.ones(n), "none": np.full(n, np.nan)}[key]
        if key == "hot":
            x[rng.random(n) < 0.1] = np.nan
        parts.append(pd.DataFrame({"symbol": key, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "x": x}))
    d = pd.concat(parts)
    s = Series.of(spark.createDataFrame(d).selectExpr("symbol", "ts", "nanvl(x, null) as x"), SeriesSpec(("symbol",), ("ts",)))
    got = expanding_median(s, "x", block=block, ranges=ranges).toPandas()
    assert len(got) == d.x.notna().sum()
    for key, g in d.groupby("symbol"):
        want = g.x.reset_index(drop=True).expanding().median()[g.x.notna().to_numpy()]
        mine = got[got.symbol == key].sort_values(RN)
        assert mine[RN].tolist() == want.index.tolist() and np.allclose(mine["median"].astype(float), want, atol=1e-12)
