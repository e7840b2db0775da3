"""Queries on prices of zero and close to it, against their SQL."""
import duckdb
import numpy as np
import pandas as pd
import pytest

from tickloom.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Ten days of ticks into summer time; some hours open at zero, some so low that a short loses more than all."""
    at = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(3)
    n = 6000
    d = pd.DataFrame({"event_id": np.arange(n), "ts": pd.Timestamp("2024-03-05") + pd.to_timedelta(np.sort(rng.integers(0, 864000, n)), "s"), "user_id": rng.integers(0, 99, n),
                      "event_type": rng.choice(["a", "b", "c", "d"], n), "value": rng.exponential(48, n).round(2) + 0.5, "props": "{}"})
    first = d.sort_values("event_id").groupby(["event_type", d.ts.dt.floor("h")]).head(1)
    d.loc[first[(first.event_type == "a") & (first.ts.dt.hour == 5)].index, "value"] = 0.0
    d.loc[first[first.event_type.isin(["b", "c"]) & (first.ts.dt.hour % 3 == 1)].index, "value"] = 0.01
    d.astype({"ts": "datetime64[us]"}).to_parquet(at / "events.parquet")
    return str(at)


def compare(spark, name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want, got = sorted(cur.fetchall()), sorted(map(tuple, QUERIES[name](spark, sf).select(*cols).collect()))
    spark.catalog.clearCache()
    assert [repr(r) for r in got] == [repr(r) for r in want]
    return want


def test_flagship(spark, events):
    want = compare(spark, "flagship", events)
    assert sum(np.isnan(r[1]) for r in want) >= 2


def test_time_of_day(spark, events):
    assert any(np.isinf(r[-1]) for r in compare(spark, "time_of_day", events))
