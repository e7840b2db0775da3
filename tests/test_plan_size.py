"""Plans that stay small."""
import os

import pytest

from tickloom.plans import QUERIES

TINY = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no tables")
def test_residual_backtest_plan_stays_small(spark):
    plan = QUERIES["residual_backtest"](spark, TINY)._jdf.queryExecution().toString()
    spark.catalog.clearCache()
    assert len(plan) < 1_000_000
