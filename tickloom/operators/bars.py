"""Bars and grouped aggregation over ticks and bars."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..joins import asof_join
from ..series import Series, SeriesSpec, col


def _ordered(seq: str | None, ts: str) -> Column:
    return F.struct(ts, seq) if seq else F.col(ts)


def tick_bars(ticks: DataFrame, rule: str, keys=("symbol",), ts="ts", seq: str | None = "seq", price="price", size="size"
              ) -> DataFrame:
    """Ticks to clock bars labelled by the bar open.  Every aggregate combines before the shuffle."""
    o = _ordered(seq, ts)
    return (ticks.groupBy(*keys, F.window(ts, rule).alias("_w"))
            .agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, o).alias("close"), F.sum(size).alias("volume"), F.count(F.lit(1)).alias("n_ticks"))
            .withColumn(ts, F.col("_w.start")).drop("_w"))


def time_bars(ticks: DataFrame, rule: str, keys=("symbol",), ts="ts", seq: str | None = "seq", price="price", size="size"
              ) -> DataFrame:
    """Right-closed clock bars labelled by the close: a tick on the boundary belongs to the bar that ends there."""
    shifted = ticks.withColumn("_s", F.col(ts) - F.expr("interval 1 microsecond"))
    o = _ordered(seq, ts)
    return (shifted.groupBy(*keys, F.window("_s", rule).alias("_w"))
            .agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, o).alias("close"), F.sum(size).alias("volume"))
            .withColumn(ts, F.col("_w.end")).drop("_w"))


def resample_ohlcv(bars: DataFrame, rule: str, keys=("symbol",), ts="ts", offset: str | None = None) -> DataFrame:
    """Coarser bars labelled by their open; empty periods do not appear."""
    w = F.window(ts, rule, rule, offset) if offset else F.window(ts, rule)
    return (bars.groupBy(*keys, w.alias("_w"))
            .agg(F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"))
            .withColumn(ts, F.col("_w.start")).drop("_w"))


def dollar_bars(ticks: DataFrame, spec: SeriesSpec, threshold: float, price="price", size="size") -> DataFrame:
    """A bar closes each time the cumulative traded value crosses a multiple of the threshold."""
    s = Series.of(ticks, spec).running({"_cum": ("sum", col(price) * col(size))})
    d = s.add(bar_id=F.floor(F.col("_cum") / threshold).cast("bigint")).done(keep_rn=True)
    return d.groupBy(*spec.keys, "bar_id").agg(
        F.min_by(price, "_rn").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, "_rn").alias("close"), F.sum(size).alias("volume"), F.max("ts").alias("ts"))


def bar_stats(s: Series, x="close") -> DataFrame:
    """Jarque-Bera, lag-1 autocorrelation and count of log returns."""
    s = s.ready([x], 2)
    s = s.add(_r=F.log(col(x) / s.lag(x)), back=1, uses=[x])
    s = s.add(_p=s.lag("_r"), back=1, uses=["_r"])
    n = F.count("_r")
    return s.flat().df.groupBy(*s.keys).agg(
        (n / 6.0 * (F.pow(F.skewness("_r"), 2) + F.pow(F.kurtosis("_r"), 2) / 4)).alias("jb"),
        F.corr("_r", "_p").alias("ac1"), n.alias("n"))


def vwap(trades: DataFrame, by: list[str], price="price", size="size") -> DataFrame:
    """Volume-weighted price per group; groups without volume are flagged, not dropped."""
    v = F.sum(size)
    return trades.groupBy(*by).agg(F.try_divide(F.sum(col(price) * col(size)), v).alias("vwap"), v.alias("volume"),
                                   (v == 0).alias("no_volume"))


def volume_profile(df: DataFrame, keys: list[str], price="price", volume="volume", bins=50, value_area=0.7) -> DataFrame:
    """Fullest price bin and the value area grown from it, one row per key.

    The table is reduced to `bins` rows per key first; growth picks the heavier neighbour (right on ties) and is a fold
    over the bins of one key.
    """
    span = df.groupBy(*keys).agg(F.min(price).alias("_lo"), F.max(price).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((col(price) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    hist = (df.join(span, keys).withColumn("_b", b).groupBy(*keys, "_lo", "_hi", "_b").agg(F.sum(volume).cast("double").alias("_v")))
    arr = hist.groupBy(*keys, "_lo", "_hi").agg(F.map_from_entries(F.collect_list(F.struct("_b", "_v"))).alias("_m"))
    h = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    arr = arr.withColumn("_h", h).withColumn("_tot", F.aggregate("_h", F.lit(0.0), lambda a, v: a + v))
    arr = arr.withColumn("_poc", (F.array_position("_h", F.array_max("_h")) - 1).cast("int"))

    def grow(acc, _):
        left = F.when(acc["lo"] > 0, F.element_at("_h", acc["lo"])).otherwise(-1.0)
        right = F.when(acc["hi"] < bins - 1, F.element_at("_h", acc["hi"] + 2)).otherwise(-1.0)
        go = acc["acc"] < value_area * F.col("_tot")
        r = right >= left
        return F.struct(F.when(go & ~r, acc["lo"] - 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(go & r, acc["hi"] + 1).otherwise(acc["hi"]).alias("hi"),
                        F.when(go, acc["acc"] + F.when(r, right).otherwise(left)).otherwise(acc["acc"]).alias("acc"))
    start = F.struct(F.col("_poc").alias("lo"), F.col("_poc").alias("hi"), F.array_max("_h").alias("acc"))
    arr = arr.withColumn("_a", F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grow))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return arr.select(*keys, (F.col("_lo") + w * (F.col("_poc") + 0.5)).alias("poc"),
                      (F.col("_lo") + w * F.col("_a.lo")).alias("val"), (F.col("_lo") + w * (F.col("_a.hi") + 1)).alias("vah"))


def align_higher_tf(ltf: DataFrame, indicator, spec: SeriesSpec, rule="1 hour", offset="30 minutes", back=0,
                    out="htf", safe=True) -> DataFrame:
    """Indicator of completed higher-timeframe closes on the lower-timeframe rows.

    A higher bar is known only after it closed, so its value moves one higher bar on before the as-of join; `safe=False`
    keeps the leak for comparison.  `indicator(series) -> series` adds `out` to the higher bars.
    """
    keys = list(spec.keys)
    htf = (ltf.groupBy(*keys, F.window("ts", rule, rule, offset).alias("_w")).agg(F.max_by("close", "ts").alias("close"))
           .select(*keys, F.col("_w.start").alias("ts"), "close"))
    s = indicator(Series.of(htf, spec, back=back + 1))
    if safe:
        s = s.ready([out], 1)
        s = s.add({out: s.lag(out)}, back=1, uses=[out])
    h = s.done().select(*keys, F.col("ts").alias("htf_ts"), out)
    return asof_join(ltf, h, keys, "ts", "htf_ts", [out])


def pct_above_ma(s: Series, n=50, x="close", date="ts") -> DataFrame:
    """Share of symbols above their own mean per date; symbols without a mean are left out."""
    s = s.ready([x], n - 1)
    d = s.add(_m=s.mean(x, n)).done()
    return d.groupBy(date).agg(F.avg(F.when(F.col("_m").isNotNull(), (col(x) > F.col("_m")).cast("double"))).alias("breadth"))


def compounded(ret: Column) -> Column:
    """Product of 1 + r minus 1 as an aggregate that keeps its sign and survives a total loss."""
    g = 1 + ret
    sign = F.when(F.count(F.when(g == 0, 1)) > 0, 0.0).when(F.count(F.when(g < 0, 1)) % 2 == 1, -1.0).otherwise(1.0)
    return sign * F.exp(F.coalesce(F.sum(F.when(g != 0, F.log(F.abs(g)))), F.lit(0.0))) - 1


def monthly_table(df: DataFrame, keys: list[str], ret="ret", ts="ts") -> DataFrame:
    """Compounded return by year, one column per month."""
    m = df.groupBy(*keys, F.year(ts).alias("year"), F.month(ts).alias("_m")).agg(compounded(col(ret)).alias("_r"))
    p = m.groupBy(*keys, "year").pivot("_m", list(range(1, 13))).agg(F.first("_r"))
    return p.select(*keys, "year", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])


def rollup_totals(df: DataFrame, dims: list[str], aggs: list[Column], label="TOTAL") -> DataFrame:
    """Grouped values with TOTAL rows of every prefix of the dimensions."""
    r = df.rollup(*dims).agg(*aggs)
    return r.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit(label)) for d in dims})


def attribution(pnl: DataFrame, strategy="strategy", value="pnl", periods=252) -> DataFrame:
    total = F.sum(value)
    g = pnl.groupBy(strategy).agg(total.alias("total"), (div(F.avg(value), F.stddev_samp(value)) * math.sqrt(periods)).alias("sharpe"))
    all_ = g.agg(F.sum("total").alias("_all"))
    return g.crossJoin(F.broadcast(all_)).withColumn("share", div(F.col("total"), F.col("_all"))).drop("_all")


def latency_histogram(df: DataFrame, by: list[str], x: str, bounds=(0.001, 0.005, 0.01, 0.025, 0.05, 0.1)) -> DataFrame:
    """Cumulative bucket counts per upper bound (the last is unbounded), with sum and count."""
    cols = [F.count(F.when(col(x) <= b, 1)).alias(f"_c{i}") for i, b in enumerate(bounds)]
    g = df.groupBy(*by).agg(*cols, F.count(x).alias("n"), F.sum(x).alias("total"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_c{i}").alias("cum")) for i, b in enumerate(bounds)],
                   F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("cum")))
    return g.select(*by, "n", "total", F.inline(rows))


def histogram_quantile(hist: DataFrame, by: list[str], q: float) -> DataFrame:
    """Upper bound of the first bucket whose cumulative count reaches q n."""
    return hist.where(F.col("cum") >= q * F.col("n")).groupBy(*by).agg(F.min("le").alias("quantile"))


def slo_report(df: DataFrame, by: list[str], x: str, threshold: float, target=0.999) -> DataFrame:
    ok = F.avg((col(x) <= threshold).cast("double"))
    return df.groupBy(*by).agg(ok.alias("compliance"), (ok >= target).alias("met"), ((1 - ok) / (1 - target)).alias("budget_used"))


def quantile_buckets(df: DataFrame, value: str, edges: DataFrame, names: list[str], out="bucket") -> DataFrame:
    """1-based bucket of a value among quantile edges (right-closed, as a quantile cut does); edges is one row."""
    d = df.crossJoin(F.broadcast(edges))
    b = F.lit(1)
    for n in names:
        b = b + (F.col(value) > F.col(n)).cast("int")
    return d.withColumn(out, b).drop(*names)


def reliability_table(df: DataFrame, prob: str, y: str, bins=5) -> DataFrame:
    """Equal-width probability bins: mean prediction, observed rate, count."""
    b = F.least(F.floor(col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(prob).alias("mean_pred"), F.avg(col(y).cast("double")).alias("observed"),
                                          F.count(F.lit(1)).alias("n"))


def regime_sharpe(df: DataFrame, by: list[str], ret="ret", periods=252, min_n=20) -> DataFrame:
    """Annualized Sharpe per group; NULL with few rows or no variance."""
    sd = F.stddev_samp(ret)
    n = F.count(ret)
    return df.groupBy(*by).agg(F.when((n >= min_n) & (sd > 0), F.avg(ret) / sd * math.sqrt(periods)).alias("sharpe"),
                               F.avg(ret).alias("mean"), n.alias("n"))


def share_of_total(df: DataFrame, n: str, out="share") -> DataFrame:
    tot = df.agg(F.sum(n).alias("_t"))
    return df.crossJoin(F.broadcast(tot)).withColumn(out, F.col(n) / F.col("_t")).drop("_t")


# ---------------------------------------------------------------- journals
def r_multiples(df: DataFrame, out="r_multiple") -> DataFrame:
    """Result in units of planned risk; NULL without a stop."""
    return df.withColumn(out, div(F.col("side") * (F.col("exit") - F.col("entry")), F.abs(F.col("entry") - F.col("stop"))))


def journal_stats(df: DataFrame, by: list[str], r="r_multiple") -> DataFrame:
    d = df.where(F.col(r).isNotNull())
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col(r) > 0).cast("double")).alias("win_rate"),
                              F.avg(F.when(F.col(r) > 0, F.col(r))).alias("avg_win_R"),
                              F.avg(F.when(F.col(r) <= 0, F.col(r))).alias("avg_loss_R"), F.avg(r).alias("expectancy_R"))


def rule_violations(df: DataFrame, open_="09:30", close="16:00") -> DataFrame:
    t = F.date_format("entry_time", "HH:mm")
    rules = F.array_compact(F.array(F.when(F.col("stop").isNull(), "no_stop"),
                                    F.when(~((t >= open_) & (t < close)), "outside_hours"),
                                    F.when(F.col("qty") > F.col("planned_qty"), "oversized")))
    return df.select("trade_id", F.explode(rules).alias("rule"))


def daily_report(fills: DataFrame, equity: DataFrame, by: list[str], ts="ts") -> DataFrame:
    """Last-day profit, return and drawdown with fill count and quantity-weighted slippage per account."""
    slip = F.col("side") * (F.col("price") - F.col("arrival_mid")) / F.col("arrival_mid") * 1e4
    f = fills.groupBy(*by).agg(F.count(F.lit(1)).alias("n_fills"),
                               div(F.sum(slip * F.col("qty")), F.sum("qty")).alias("slippage_bps"))
    last = equity.groupBy(*by).agg(F.max(ts).alias("_t1"), F.max("equity").alias("_peak"), F.max_by("equity", ts).alias("_e1"))
    prev = (equity.join(last.select(*by, "_t1"), by).where(F.col(ts) < F.col("_t1")).groupBy(*by)
            .agg(F.max_by("equity", ts).alias("_e0")))
    return (last.join(prev, by).join(f, by, "left")
            .select(*by, (F.col("_e1") - F.col("_e0")).alias("pnl"), (F.col("_e1") / F.col("_e0") - 1).alias("return"),
                    (F.col("_e1") / F.col("_peak") - 1).alias("drawdown"), "n_fills", "slippage_bps"))


def weekly_decisions(inside: DataFrame, incidents: DataFrame, by: list[str]) -> DataFrame:
    """demote / scale / hold per strategy and week from the share of days inside the band and the incidents."""
    share = inside.groupBy(*by).agg(F.avg(F.col("inside").cast("double")).alias("share"))
    d = share.join(incidents, by, "left").withColumn("incidents", F.coalesce("incidents", F.lit(0)))
    s, i = F.col("share"), F.col("incidents")
    return d.withColumn("decision", F.when((s < 0.5) | (i >= 2), "demote").when((s == 1.0) & (i == 0), "scale").otherwise("hold"))


def largest_remainder_profile(orders: DataFrame, weights: str, qty: str, seq="slice", out="child") -> DataFrame:
    """`largest_remainder` where each order brings its profile as an array: one row per slice, without an exchange or a sort."""
    total = F.aggregate(F.transform(weights, lambda w: w.cast("double")), F.lit(0.0), lambda a, w: a + w)
    raw = F.transform(weights, lambda w: F.col(qty) * w / F.col("_total"))
    ranked = F.array_sort(F.transform("_raws", lambda x, i: F.struct((F.floor(x) - x).alias("f"), i.cast("int").alias("seq"), F.floor(x).alias("base"))))
    d = orders.withColumn("_total", total).withColumn("_raws", raw)
    d = d.withColumn("_left", F.col(qty) - F.aggregate("_raws", F.lit(0).cast("bigint"), lambda a, x: a + F.floor(x)))
    d = d.select(*orders.columns, "_left", F.posexplode(ranked).alias("_rank", "_s"))
    return d.select(*orders.columns, F.col("_s.seq").alias(seq), (F.col("_s.base") + (F.col("_rank") < F.col("_left")).cast("int")).alias(out))


def largest_remainder(df: DataFrame, order: str, weight: str, qty: str, seq: str, out="child") -> DataFrame:
    """Integer sizes in proportion to a profile; the rest goes to the largest fractions, earlier rows first on ties."""
    w = Window.partitionBy(order)
    raw = F.col(qty) * F.col(weight) / F.sum(weight).over(w)
    d = df.withColumn("_raw", raw).withColumn("_base", F.floor("_raw"))
    d = d.withColumn("_left", F.col(qty) - F.sum("_base").over(w))
    rank = F.row_number().over(w.orderBy((F.col("_raw") - F.col("_base")).desc(), F.col(seq)))
    return d.withColumn(out, F.col("_base") + (rank <= F.col("_left")).cast("int")).drop("_raw", "_base", "_left")
