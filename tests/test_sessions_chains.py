"""Chains, calendar operators, Student-t fits and partitioned files."""
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import chains, sessions, student
from tickloom.series import Series, SeriesSpec
from tickloom.sources import market as M


def test_one_long_chain_is_checked_in_blocks(spark):
    prev, out = chains.START, []
    for i in range(500):
        body = f"record {i}"
        h = hashlib.sha256(f"{prev}|{body}".encode()).hexdigest()
        out.append(("a", i, body, prev, h))
        prev = h
    spec = SeriesSpec(("k",), ("i",), "i div 100", block_rows=16)
    for broken, change in ((-1, None), (0, "prev"), (16, "prev"), (31, "body"), (499, "body"), (200, "hash")):
        rows = [list(r) for r in out]
        if change:
            rows[broken][{"body": 2, "prev": 3, "hash": 4}[change]] = "0" * 64 if change != "body" else "changed"
            if change == "prev" and broken == 0:
                rows[0][3] = "f" * 64
        d = spark.createDataFrame([tuple(r) for r in rows], "k string, i long, body string, prev string, hash string")
        assert tuple(chains.verify(d, spec).first()) == ("a", 500, broken)
    sealed = chains.sealed(spark.createDataFrame([("a", 1, "x"), ("a", 0, "y")], "k string, i long, t string"), ["k"], "i", F.col("t")).orderBy("i").collect()
    assert sealed[0].prev == chains.START and sealed[1].prev == sealed[0].hash == hashlib.sha256(f"{chains.START}|y".encode()).hexdigest()


def test_business_days(spark):
    days = pd.date_range("2024-01-01", "2024-03-31")
    d = spark.createDataFrame(pd.DataFrame({"d": days.date}))
    ns = [1, 3, 7, -1, -3, -6]
    got = d.select("d", *[sessions.business_days_on(F.col("d"), n).alias(f"n{i}") for i, n in enumerate(ns)]).orderBy("d").toPandas()
    for i, n in enumerate(ns):
        assert list(pd.to_datetime(got[f"n{i}"])) == [x + pd.offsets.BDay(n) for x in days]


def test_profile_counts_half_hours_once(spark):
    d = spark.createDataFrame([("a", f"2024-01-02 {h}", p) for h, p in (("09:31:00", 10.2), ("09:40:00", 10.4), ("10:05:00", 10.1), ("10:06:00", 12.0), (None, None))[:4]], "symbol string, ts string, price double").withColumn("ts", F.to_timestamp("ts"))
    p = {r.bin: r.periods for r in sessions.time_price_profile(d, ["symbol"], "ts", "price", 1.0).collect()}
    assert p == {10: 2, 12: 1}
    assert tuple(sessions.profile_levels(sessions.time_price_profile(d, ["symbol"], "ts", "price", 1.0), ["symbol"]).first())[2:] == (2, 10, 10, 12)


def test_nearest_row_needs_leaks(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 1, 900)
    y = np.convolve(r, np.ones(20), "valid")
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "t": np.arange(len(y)), "y": y}))
    s = Series.of(d, SeriesSpec(("k",), ("t",), "t div 100", block_rows=64))
    fold = rng.integers(0, 5, len(y))
    lookup = F.element_at(F.array(*[F.lit(int(f)) for f in fold]), (F.col("_at") + 1).cast("int"))
    for name, f, gap, k in (("mixed", lookup, 0, fold), ("blocks", F.expr("_at div 100"), 0, np.arange(len(y)) // 100), ("purged", F.expr("_at div 100"), 20, np.arange(len(y)) // 100)):
        got = sessions.nearest_row_r2(s.add(), "y", f, gap).first()
        hat = []
        for i in range(len(y)):
            a = b = i
            while a >= 0 and k[a] == k[i]:
                a -= 1
            while b < len(y) and k[b] == k[i]:
                b += 1
            a, b = a - gap, b + gap
            hat.append(y[a] if a >= 0 and (b >= len(y) or i - a <= b - i) else y[b] if b < len(y) else np.nan)
        hat = np.array(hat)
        want = 1 - np.nansum((y - hat) ** 2) / ((y - y.mean()) ** 2).sum()
        assert got.n == len(y) and abs(got.r2 - want) < 1e-9
        assert (got.r2 > 0.7) == (name == "mixed")


def test_student_t(spark):
    rng = np.random.default_rng(2)
    x = {"heavy": 3 + 2 * rng.standard_t(4, 4000), "normal": rng.normal(0, 1e-4, 3000), "few": np.arange(3.0), "flat": np.ones(20)}
    d = pd.concat([pd.DataFrame({"k": k, "x": v}) for k, v in x.items()] + [pd.DataFrame({"k": "heavy", "x": [np.nan, np.inf]})])
    got = student.fit(spark.createDataFrame(d), ["k"], "x").toPandas().set_index("k")
    assert set(got.index) == {"heavy", "normal"} and got.settled.all() and (got.decrement <= 1e-12).all()

    def loglik(v, nu, m, s):
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * nu) - math.log(s)
        return len(v) * c - (nu + 1) / 2 * np.log1p(((v - m) / s) ** 2 / nu).sum()
    for k, r in got.iterrows():
        best = loglik(x[k], r["df"], r["loc"], r["scale"])
        assert abs(best - r["loglik"]) < 1e-5
        for a, b, c in ((1.02, 0, 1), (0.98, 0, 1), (1, 0.01, 1), (1, -0.01, 1), (1, 0, 1.01), (1, 0, 0.99)):
            assert loglik(x[k], min(r["df"] * a, 1e6), r["loc"] + b * r["scale"], r["scale"] * c) <= best + 1e-6
    assert 3.4 < got.df["heavy"] < 4.8 and abs(got.scale["heavy"] - 2) < 0.15


def test_one_partition_is_replaced_and_folders_are_pruned(spark, tmp_path):
    d = spark.createDataFrame([(s, f"2024-01-0{i} 10:00:00", float(i)) for s in ("a", "b") for i in (1, 2)], "symbol string, ts string, close double").withColumn("ts", F.to_timestamp("ts"))
    root = str(tmp_path / "bars")
    M.write_partitioned(d, root)
    M.write_partitioned(d.where("symbol = 'a' and close = 2").withColumn("close", F.lit(9.0)), root, mode="overwrite")
    r = M.read_partitioned(spark, root, d.schema)
    assert sorted((x.symbol, x.close) for x in r.collect()) == [("a", 1.0), ("a", 9.0), ("b", 1.0), ("b", 2.0)]
    one = M.read_partitioned(spark, root, d.schema, "symbol = 'a' and date = date'2024-01-02'")
    assert len(one.inputFiles()) >= 1 and one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "ReadSchema: struct<ts:timestamp,close:double>" in plan
