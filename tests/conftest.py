import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import build
    s = build("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def prices():
    """Two random walks with daily bars, in arrival order."""
    rng = np.random.default_rng(7)
    out = []
    for sym, n in (("A", 230), ("B", 90)):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        o = c * np.exp(rng.normal(0, 0.01, n))
        h, lo = np.maximum(o, c) * (1 + rng.uniform(0, 0.01, n)), np.minimum(o, c) * (1 - rng.uniform(0, 0.01, n))
        out.append(pd.DataFrame({"symbol": sym, "ts": pd.date_range("2024-01-01", periods=n, freq="D"), "open": o, "high": h, "low": lo, "close": c, "volume": rng.integers(1, 50, n).astype(float)}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, prices):
    return spark.createDataFrame(prices).cache()
