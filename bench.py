"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tickloom.plans import QUERIES  # noqa: E402
from tickloom.session import build  # noqa: E402

HEADLINE = ("flagship", "tick_bars", "asof_join", "spread_measures", "sma", "bbands", "ema", "rsi", "vwap", "session_vwap", "dollar_bars", "donchian_breakout", "realized_pnl", "journal_stats",
            "screen", "exact_percentiles", "bm25", "bsm_price", "implied_vol", "walk_forward_optimize")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["ema"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()      # start the Python workers
    times = {}
    for q in HEADLINE:
        t0 = time.time()
        QUERIES[q](spark, sf).write.format("noop").mode("overwrite").save()
        times[q] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
