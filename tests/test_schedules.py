import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import execution as X


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_profiles_give_the_rows_of_the_long_form_without_an_exchange(spark):
    o = spark.createDataFrame([(i, None if i == 3 else q) for i, q in enumerate([0, 1, 7, 20, 21, 22, 999_983])], "id int, qty long")
    o = o.withColumn("weights", F.array(*[F.lit(w) for w in (3, 1, 1, 2, 5)]))
    got = B.largest_remainder_profile(o, "weights", "qty")
    long = o.select("id", "qty", F.posexplode("weights").alias("slice", "w"))
    want = B.largest_remainder(long, "id", "w", "qty", "slice")
    rows = lambda d: sorted((r.id, r.slice, r.child) for r in d.collect() if r.id != 3)
    assert rows(got) == rows(want)
    assert [r.child for r in got.where("id = 3").collect()] == [None] * 5
    assert exchanges(got) == 0


def test_cost_moments_of_a_schedule(spark):
    d = spark.createDataFrame([(1, [4.0, 2.0, 1.0]), (2, [None, 3.0]), (3, []), (4, [None])], "id int, child array<double>")
    d = d.withColumns({"sigma": F.lit(0.3), "eta": F.lit(0.1), "gamma": F.lit(0.02)})
    got = X.cost_moments(d, ["id"])
    assert exchanges(got) == 0
    r = {x.id: x for x in got.collect()}
    assert r[1].mean == pytest.approx(0.01 * 49 + 0.09 * 21) and r[1].variance == pytest.approx(0.09 * (9 + 1))
    assert r[2].mean == pytest.approx(0.01 * 9 + 0.09 * 9) and r[2].variance == pytest.approx(0.09 * 9)
    assert r[3].mean is None and r[4].mean is None and r[3].variance == r[4].variance == 0


def test_order_queries_do_not_exchange_slices(spark):
    from __spark_entry__ import QUERIES
    sf = "/root/testdata/sf0.001"
    assert exchanges(QUERIES["schedules"](spark, sf)) == 0
    plan = QUERIES["cost_moments"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
