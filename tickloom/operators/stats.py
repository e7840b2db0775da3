"""Statistical aggregates and tests over series and panels."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import div
from ..functions.special import chi2_sf_1, chi2_sf_2, f_sf, kolmogorov_sf, normal_cdf, normal_ppf, normal_ppf_value
from ..quantiles import percentiles
from ..series import RN, Series, SeriesSpec, col, index_rows, kept
from .patterns import consecutive
from .strategies import equity_curve, pct_rank

EULER = 0.5772156649015329


# ---------------------------------------------------------------- regression by sums
@F.pandas_udf(T.StructType([T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("se", T.ArrayType(T.DoubleType())),
                            T.StructField("ssr", T.DoubleType())]))
def _solve(g: pd.Series, v: pd.Series, yy: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Solve one small normal system per row (after all sums are done)."""
    out = []
    for a, b, s, m in zip(g, v, yy, n):
        if a is None or b is None:
            out.append((None, None, None))
            continue
        b = np.asarray(b, float)
        k = b.size
        G = np.asarray(a, float).reshape(k, k)
        if m <= k or not np.all(np.isfinite(G)) or np.linalg.matrix_rank(G) < k:
            out.append((None, None, None))
            continue
        inv = np.linalg.inv(G)
        c = inv @ b
        ssr = max(float(s - c @ b), 0.0)
        out.append((c.tolist(), np.sqrt(np.maximum(np.diag(inv) * ssr / (m - k), 0)).tolist(), ssr))
    return pd.DataFrame(out, columns=["coef", "se", "ssr"])


def regress(df: DataFrame, keys: list[str], y: Column, xs: list[Column]) -> DataFrame:
    """OLS per key from sums of products: n, coef, se, ssr, syy.  Rows with a NULL are left out; put lit(1) first for a constant."""
    names = [f"_x{i}" for i in range(len(xs))]
    d = df.select(*keys, y.cast("double").alias("_y"), *[x.cast("double").alias(n) for x, n in zip(xs, names)]).dropna(subset=["_y", *names])
    k = len(xs)
    sums = {(i, j): F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_g{i}_{j}") for i in range(k) for j in range(i, k)}
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"), F.sum("_y").alias("_sy"),
                             *sums.values(), *[F.sum(F.col(x) * F.col("_y")).alias(f"_v{i}") for i, x in enumerate(names)])
    gram = F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    sol = _solve(gram, F.array(*[F.col(f"_v{i}") for i in range(k)]), F.col("_yy"), F.col("n").cast("double"))
    return g.withColumn("_s", sol).select(*keys, "n", "_s.coef", "_s.se", "_s.ssr", (F.col("_yy") - F.col("_sy") * F.col("_sy") / F.col("n")).alias("syy"))


# ---------------------------------------------------------------- unit roots and cointegration
# fixed values: response-surface coefficients of MacKinnon (1994) with a constant, for 1 and 2 variables
_MACKINNON = {1: {"star": -1.61, "min": -18.83, "max": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
              2: {"star": -2.62, "min": -18.86, "max": 0.92, "small": (2.92, 1.5012, 0.039796), "large": (2.1945, 0.64695, -0.29198, -0.042377)}}


def mackinnon_pvalue(stat: Column, n_vars: int = 1) -> Column:
    m = _MACKINNON[n_vars]

    def poly(c):
        acc = F.lit(0.0)
        for k in reversed(c):
            acc = acc * stat + k
        return acc
    z = F.when(stat <= m["star"], poly(m["small"])).otherwise(poly(m["large"]))
    return F.when(stat > m["max"], 1.0).when(stat < m["min"], 0.0).otherwise(normal_cdf(z))


def adf(s: Series, x: str, n_vars: int = 1, const: bool = True) -> DataFrame:
    """Dickey-Fuller test with one lag per key: the regression needs only sums of products."""
    s = s.ready([x], 2)
    s = s.add(_d=col(x) - s.lag(x), _l=s.lag(x), back=1, uses=[x])
    s = s.add(_dl=s.lag("_d"), back=1, uses=["_d"])
    xs = [F.lit(1.0)] * const + [F.col("_l"), F.col("_dl")]
    r = regress(s.flat().df, s.keys, F.col("_d"), xs)
    i = 1 if const else 0
    stat = F.col("coef")[i] / F.col("se")[i]
    return r.withColumn("adf_stat", stat).withColumn("p_value", mackinnon_pvalue(F.col("adf_stat"), n_vars)).select(*s.keys, "n", "adf_stat", "p_value")


ORDERS = tuple(round(0.1 * k, 2) for k in range(11))


def min_frac_diff(df: DataFrame, spec: SeriesSpec, x: str, ds: tuple[float, ...] = ORDERS, p: float = 0.05, thresh: float = 1e-4) -> DataFrame:
    """Per key and difference order: unit-root p-value and correlation with the original on the same rows; the smallest order below `p`.

    All orders share one layout whose halo is that of the longest filter; a key shorter than a filter has NULLs there.
    """
    from .indicators import ffd_weights
    filters = [(float(d), np.array(ffd_weights(d, thresh))[::-1]) for d in ds]
    keys = list(spec.keys)
    back = max(len(w) for _, w in filters) + 1                       # the filter, and two lags of its result
    base = df.select(*keys, *[c for c in spec.order if c not in keys], F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    rows = Series.of(base, spec, back)
    own = (F.expr(f"{RN} div {rows.block}") == F.col("_blk")).alias("_own")
    sch = T.StructType([*[rows.df.schema[k] for k in keys], *[T.StructField(c, T.DoubleType()) for c in ("d", "_x", "_f", "_d", "_l", "_dl")]])

    def block(pdf):
        v = pdf.sort_values(RN)
        xx, mine, out = v["_x"].to_numpy(float), v["_own"].to_numpy(bool), []
        for d, w in filters:
            f = np.full(len(xx) + 2, np.nan)                         # two rows before the first have no value
            if len(xx) >= len(w):
                f[len(w) + 1:] = np.convolve(xx, w, mode="valid")
            diff = np.diff(f)
            o = v[keys].assign(d=d, _x=xx, _f=f[2:], _d=diff[1:], _l=f[1:-1], _dl=diff[:-1])
            out.append(o[mine & ~np.isnan(f[2:])])
        return pd.concat(out)[[f.name for f in sch.fields]]

    long = rows.df.select(*keys, "_blk", RN, "_x", own).groupBy(*keys, "_blk").applyInPandas(block, sch)
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    long = kept(long.withColumns({c: clean(c) for c in ("_d", "_l", "_dl")}))
    by = [*keys, "d"]
    r = regress(long, by, F.col("_d"), [F.lit(1.0), F.col("_l"), F.col("_dl")])
    test = r.select(*by, mackinnon_pvalue(F.col("coef")[1] / F.col("se")[1]).alias("adf_p"))
    grid = base.select(*keys).distinct().withColumn("d", F.explode(F.array(*[F.lit(d) for d, _ in filters])))
    corr = long.groupBy(*by).agg(F.corr("_f", "_x").alias("corr"))
    u = kept(grid.join(corr, by, "left").join(test, by, "left"))
    best = u.where(F.col("adf_p") < p).groupBy(*keys).agg(F.min("d").alias("min_d"))
    return u.join(best, keys, "left").select(*keys, "corr", "adf_p", "d", "min_d")


KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))    # fixed values: published critical values


def kpss(s: Series, x: str, lags: int) -> DataFrame:
    """Level stationarity: cumulative residuals over a Bartlett long-run variance; p-value interpolated in the table."""
    keys = s.keys
    mean = s.flat().df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.count(x).alias("_n"))
    base = s.flat().df.drop("_blk", RN)
    d = (base.join(mean, keys) if keys else base.crossJoin(F.broadcast(mean))).withColumn("_e", F.col(x) - F.col("_m"))
    t = Series.of(kept(d), s.spec, back=lags)
    prods = {f"_g{j}": F.col("_e") * t.lag("_e", j) for j in range(1, lags + 1)}
    cov = t.add(prods).flat().df.groupBy(*keys).agg(F.sum(F.col("_e") * F.col("_e")).alias("_g0"), *[F.sum(k).alias(k) for k in prods])
    cum = t.running({"_S": ("sum", F.col("_e"))}).df.groupBy(*keys, "_n").agg(F.sum(F.col("_S") * F.col("_S")).alias("_eta"))
    lr = F.col("_g0")
    for j in range(1, lags + 1):
        lr = lr + 2 * (1 - j / (lags + 1)) * F.col(f"_g{j}")
    j = cum.join(cov, keys) if keys else cum.crossJoin(cov)
    stat = F.col("_eta") / (F.col("_n") * F.col("_n")) / (lr / F.col("_n"))
    p = F.when(F.col("stat") <= KPSS_TABLE[0][0], KPSS_TABLE[0][1])
    for (a, pa_), (b, pb) in zip(KPSS_TABLE, KPSS_TABLE[1:]):
        p = p.when(F.col("stat") <= b, pa_ + (pb - pa_) * (F.col("stat") - a) / (b - a))
    return j.withColumn("stat", stat).withColumn("p_value", p.otherwise(KPSS_TABLE[-1][1])).select(*keys, "stat", "p_value")


def fit_ou(s: Series, x: str, dt=1.0) -> DataFrame:
    """Mean-reversion speed, level, volatility and half-life from the AR(1) sums; no reversion gives an infinite half-life."""
    s = s.ready([x], 1)
    d = s.add(_l=s.lag(x)).flat().df
    r = regress(d, s.keys, col(x), [F.lit(1.0), F.col("_l")])
    a, b = F.col("coef")[0], F.col("coef")[1]
    ok = (b > 0) & (b < 1)
    theta = -F.log(b) / dt
    return r.select(*s.keys, F.when(ok, theta).otherwise(0.0).alias("theta"), F.when(ok, a / (1 - b)).alias("mu"),
                    F.when(ok, F.sqrt(F.col("ssr") / (F.col("n") - 2)) * F.sqrt(2 * theta / (1 - b * b))).alias("sigma"),
                    F.when(ok, math.log(2) / theta).otherwise(float("inf")).alias("half_life"))


def engle_granger(df: DataFrame, spec: SeriesSpec, y="y", x="x") -> DataFrame:
    """OLS of y on x per pair, one-lag cointegration test of the spread and its half-life."""
    keys = list(spec.keys)
    ols = regress(df, keys, F.col(y), [F.lit(1.0), F.col(x)]).select(*keys, F.col("coef")[0].alias("alpha"), F.col("coef")[1].alias("beta"))
    d = kept(df.join(ols, keys).withColumn("_spread", F.col(y) - F.col("beta") * F.col(x) - F.col("alpha")))
    s = Series.of(d, spec, back=2)
    test = adf(s, "_spread", 2, const=False).select(*keys, F.col("p_value").alias("pvalue"))
    hl = fit_ou(s, "_spread").select(*keys, "half_life")
    vol = d.groupBy(*keys).agg(F.stddev_samp("_spread").alias("spread_vol"))
    return ols.join(test, keys).join(hl, keys).join(vol, keys)


def variance_ratio(s: Series, x: str, q=5) -> DataFrame:
    s = s.ready([x], q)
    d = s.add(_q=col(x) - s.lag(x, q), _1=col(x) - s.lag(x)).flat().df
    return d.groupBy(*s.keys).agg((F.var_samp("_q") / (q * F.var_samp("_1"))).alias("variance_ratio"))


def hurst(s: Series, x: str, lags=range(2, 64)) -> DataFrame:
    """Slope of log std of lagged differences on log lag; all lags come from one window pass."""
    s = s.ready([x], max(lags))
    d = s.add({f"_d{k}": col(x) - s.lag(x, k) for k in lags}).flat().df
    g = d.groupBy(*s.keys).agg(*[F.stddev_pop(f"_d{k}").alias(f"_s{k}") for k in lags])
    rows = F.array(*[F.struct(F.lit(math.log(k)).alias("lx"), F.log(f"_s{k}").alias("ly")) for k in lags])
    return g.select(*s.keys, F.inline(rows)).groupBy(*s.keys).agg(F.regr_slope("ly", "lx").alias("hurst"))


# ---------------------------------------------------------------- distribution summaries
def describe(df: DataFrame, keys: list[str], r="ret") -> DataFrame:
    """Mean, std, skewness, excess kurtosis, Jarque-Bera statistic and p-value."""
    g = df.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurtosis") * F.col("kurtosis") / 4)
    return g.withColumn("jb", jb).withColumn("jb_p", chi2_sf_2("jb"))


def tail_count(df: DataFrame, keys: list[str], r="ret", k=4.0) -> DataFrame:
    m = df.groupBy(*keys).agg(F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"))
    d = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))
    g = d.groupBy(*keys).agg(F.count(F.when(F.abs(F.col(r) - F.col("_m")) > k * F.col("_s"), 1)).alias("beyond"), F.count(r).alias("n"))
    return g.withColumn("expected", F.col("n") * 2 * normal_cdf(F.lit(-float(k)))).drop("n")


def autocorr(s: Series, x: str, lag=1, out="autocorr") -> DataFrame:
    s = s.ready([x], lag)
    return s.add(_l=s.lag(x, lag)).flat().df.groupBy(*s.keys).agg(F.corr(x, "_l").alias(out))


def mean_tstat(df: DataFrame, keys: list[str], r="ret") -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(r) / (F.stddev_samp(r) / F.sqrt(F.count(r)))).alias("t_stat"))


def years_needed(sharpe_annual: Column, t_target=2.0) -> Column:
    return F.pow(F.lit(t_target) / sharpe_annual, 2)


def qlike(realized: Column, forecast: Column) -> Column:
    q = realized / forecast
    return F.avg(q - F.log(q) - 1)


def hist_var_cvar(df: DataFrame, keys: list[str], r="ret", alpha=0.99) -> DataFrame:
    """Quantile loss (linear interpolation) and the mean loss at or beyond it."""
    d = df.withColumn("_loss", -F.col(r))
    v = percentiles(d, keys, "_loss", [alpha], ["var"])
    j = d.join(v, keys) if keys else d.crossJoin(F.broadcast(v))
    return j.groupBy(*keys, "var").agg(F.avg(F.when(F.col("_loss") >= F.col("var"), F.col("_loss"))).alias("cvar"))


def var_by_method(df: DataFrame, keys: list[str], r="ret", alpha=0.99) -> DataFrame:
    """Historical, normal and Cornish-Fisher loss quantiles side by side."""
    z = normal_ppf_value(1 - alpha)
    g = df.groupBy(*keys).agg(F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.skewness(r).alias("_k3"), F.kurtosis(r).alias("_k4"))
    k3, k4 = F.col("_k3"), F.col("_k4")
    cf = z + (z * z - 1) * k3 / 6 + (z ** 3 - 3 * z) * k4 / 24 - (2 * z ** 3 - 5 * z) * k3 * k3 / 36
    h = hist_var_cvar(df, keys, r, alpha)
    j = g.join(h, keys) if keys else g.crossJoin(h)
    return j.select(*keys, F.col("var").alias("historical"), F.col("cvar").alias("cvar_historical"), (-(F.col("_m") + z * F.col("_s"))).alias("normal"),
                    (-(F.col("_m") + cf * F.col("_s"))).alias("cornish_fisher"))


def tear_sheet(s: Series, r="ret", periods=252, extra_keys=()) -> DataFrame:
    """One row per series: growth, risk, drawdown depth and duration, tail shape."""
    s = equity_curve(s, r)
    s = s.add(drawdown=F.col("equity") / F.greatest("peak", F.lit(1.0)) - 1)
    s = consecutive(s.add(_under=F.col("drawdown") < 0), "_under", "_run")
    keys = s.keys
    d = s.df
    n = F.count(r)
    sd = F.stddev_samp(r)
    g = d.groupBy(*keys).agg(
        (F.pow(F.max_by("equity", RN), float(periods) / n) - 1).alias("cagr"), (sd * math.sqrt(periods)).alias("vol"), (F.avg(r) / sd * math.sqrt(periods)).alias("sharpe"),
        (F.avg(r) / F.sqrt(F.avg(F.pow(F.least(F.col(r), F.lit(0.0)), 2))) * math.sqrt(periods)).alias("sortino"), F.min("drawdown").alias("max_dd"),
        F.max("_run").alias("dd_duration"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurtosis"))
    q = percentiles(d.select(*keys, r), keys, r, [0.05, 0.95], ["_p5", "_p95"])
    j = g.join(q, keys) if keys else g.crossJoin(q)
    return j.withColumn("calmar", F.when(F.col("max_dd") < 0, F.col("cagr") / F.abs("max_dd"))).withColumn(
        "tail_ratio", F.col("_p95") / F.abs("_p5")).drop("_p5", "_p95")


def benchmark_stats(df: DataFrame, keys: list[str], r="ret", bench="bench", rf=0.0, periods=252) -> DataFrame:
    """Beta, annual alpha and information ratio against a benchmark column; Sharpe and Sortino over the risk-free rate."""
    daily = rf / periods
    e = F.col(r) - daily
    beta = F.covar_samp(r, bench) / F.var_samp(bench)
    diff = F.col(r) - F.col(bench)
    return df.groupBy(*keys).agg(beta.alias("beta"), ((F.avg(e) - beta * (F.avg(bench) - daily)) * periods).alias("alpha"),
                                 (F.avg(diff) / F.stddev_samp(diff) * math.sqrt(periods)).alias("ir"),
                                 (F.avg(e) / F.stddev_samp(r) * math.sqrt(periods)).alias("sharpe"),
                                 (F.avg(e) / F.sqrt(F.avg(F.pow(F.least(e, F.lit(0.0)), 2))) * math.sqrt(periods)).alias("sortino"))


def regime_vols(df: DataFrame, keys: list[str], r="ret", prob="prob", threshold=0.5, periods=252) -> DataFrame:
    hot = F.col(prob) > threshold
    return df.groupBy(*keys).agg((F.stddev_samp(F.when(~hot, F.col(r))) * math.sqrt(periods)).alias("calm_vol"),
                                 (F.stddev_samp(F.when(hot, F.col(r))) * math.sqrt(periods)).alias("stress_vol"))


# ---------------------------------------------------------------- trades
def trades_from_positions(s: Series, pos="pos") -> DataFrame:
    """Round trips of a decided position: filled at the next open, closed on a change of side; an open trade is dropped."""
    s = s.ready([pos, "open", "high", "low"], 1, 1)
    p = F.signum(F.coalesce(col(pos), F.lit(0.0)))
    s = s.add(_p=p, _q=F.coalesce(s.lag(p), F.lit(0.0)), _no=s.lead("open", 1), _ni=s.lead(F.col(RN), 1))
    # the first row decides nothing: a trade starts on a change
    start = (F.col("_p") != 0) & (F.col("_p") != F.col("_q")) & (F.col(RN) > 0)
    s = s.add(_chg=(F.col("_p") != F.col("_q")) & (F.col(RN) > 0), _start=start)
    s = s.flat().running({"_id": ("count", F.when(F.col("_chg"), 1))})
    keys = s.keys
    d = s.df
    runs = d.groupBy(*keys, "_id").agg(F.first("_p").alias("direction"), F.max("_start").alias("_ok"), F.min_by("_no", RN).alias("_entry"), F.min_by("_ni", RN).alias("entry_i"),
                                       F.max_by("_no", RN).alias("_after"), F.max("_ni").alias("_last_next"))
    nxt = Window.partitionBy(*keys).orderBy("_id")
    runs = runs.withColumns({"exit_i": F.lead("entry_i").over(nxt), "_exit": F.lead("_entry").over(nxt)})
    t = runs.where(F.col("_ok") & F.col("exit_i").isNotNull() & (F.col("direction") != 0))
    # bars entry_i .. exit_i - 1 are the rows of the run moved on by one
    ext = s.halo(1)
    hl = ext.add(_pid=ext.lag("_id")).flat().df.groupBy(*keys, F.col("_pid").alias("_id")).agg(F.max("high").alias("_hi"), F.min("low").alias("_lo"))
    t = t.join(hl, [*keys, "_id"])
    e, up = F.col("_entry"), F.col("direction") > 0
    fav = F.when(up, F.col("_hi") / e - 1).otherwise(1 - F.col("_lo") / e)
    adv = F.when(up, F.col("_lo") / e - 1).otherwise(1 - F.col("_hi") / e)
    return t.select(*keys, "entry_i", "exit_i", F.col("direction").cast("int").alias("direction"), (F.col("direction") * (F.col("_exit") / e - 1)).alias("ret"),
                    F.least(adv, F.lit(0.0)).alias("mae"), F.greatest(fav, F.lit(0.0)).alias("mfe"))


def trade_stats(trades: DataFrame, spec: SeriesSpec, r="ret") -> DataFrame:
    keys = list(spec.keys)
    runs = consecutive(Series.of(kept(trades), spec).add(_loss=F.col(r) < 0), "_loss", "_run").df
    win, loss = F.when(F.col(r) > 0, F.col(r)), F.when(F.col(r) < 0, F.col(r))
    return runs.groupBy(*keys).agg(F.avg((F.col(r) > 0).cast("double")).alias("win_rate"), div(F.avg(win), F.abs(F.avg(loss))).alias("payoff"), F.avg(r).alias("expectancy"),
                                   div(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"), F.max("_run").alias("max_consecutive_losses"))


# ---------------------------------------------------------------- significance
def sharpe_moments(df: DataFrame, keys: list[str], r="ret") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(r).alias("T"), (F.avg(r) / F.stddev_samp(r)).alias("sr"), F.skewness(r).alias("g3"), (F.kurtosis(r) + 3).alias("g4"))


def sharpe_se(sr: Column, n: Column) -> Column:
    return F.sqrt((1 + 0.5 * sr * sr) / n)


def psr(sr_star=0.0) -> Column:
    """Probabilistic Sharpe ratio from the columns of `sharpe_moments`."""
    sr, v = F.col("sr"), 1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") * F.col("sr")
    return normal_cdf((sr - sr_star) * F.sqrt(F.col("T") - 1) / F.sqrt(v))


def min_track_record(sr_star=0.0, alpha=0.05) -> Column:
    sr, v = F.col("sr"), 1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") * F.col("sr")
    return F.when(sr > sr_star, 1 + v * F.pow(normal_ppf_value(1 - alpha) / (sr - sr_star), 2)).otherwise(float("inf"))


def expected_max_sharpe(trials: DataFrame, keys: list[str], sr="sr") -> DataFrame:
    n = F.count(sr)
    return trials.groupBy(*keys).agg(F.stddev_samp(sr).alias("_sd"), n.alias("_n")).select(*keys, (F.col("_sd") * (
        (1 - EULER) * normal_ppf(1 - 1 / F.col("_n")) + EULER * normal_ppf(1 - 1 / (F.col("_n") * math.e)))).alias("sr0"))


def kupiec(df: DataFrame, keys: list[str], exception: str, p: float) -> DataFrame:
    """Proportion-of-failures likelihood ratio and p-value."""
    g = df.groupBy(*keys).agg(F.count(F.when(F.col(exception), 1)).cast("double").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))

    def xlogy(a, b):
        return F.when(a == 0, 0.0).otherwise(a * F.log(b))
    x, n = F.col("x"), F.col("n")
    ph = x / n
    lr = -2 * (xlogy(n - x, F.lit(1 - p)) + xlogy(x, F.lit(p))) + 2 * (xlogy(n - x, 1 - ph) + xlogy(x, ph))
    return g.withColumn("lr", F.greatest(lr, F.lit(0.0))).withColumn("p_value", chi2_sf_1("lr"))


def bh(df: DataFrame, p="p_value", alpha=0.1, by: tuple[str, ...] = (), tie="id") -> DataFrame:
    """Benjamini-Hochberg q-values and discoveries over all rows (or per `by` group), without one global sort task."""
    spec = SeriesSpec(by, (p, tie), f"cast(floor({p} * 4096) as bigint)")
    idx = index_rows(df, spec, "_rk")
    tot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    d = idx.join(tot, list(by)) if by else idx.crossJoin(F.broadcast(tot))
    d = d.withColumn("_q", F.col(p) * F.col("_m") / (F.col("_rk") + 1)).withColumn("_desc", F.col("_m") - F.col("_rk"))
    s = Series.of(d, SeriesSpec(by, ("_desc",), "_desc div 100000")).running({"q_value": ("min", F.col("_q"))})
    d = s.done().withColumn("q_value", F.least("q_value", F.lit(1.0)))
    return d.withColumn("discovery", F.col("q_value") <= alpha).drop("_rk", "_m", "_q", "_desc")


def hill(df: DataFrame, keys: list[str], r="ret", k=100) -> DataFrame:
    """Tail index of the k largest losses; ranks come from a threshold found in the sketch, not from sorting all rows."""
    d = df.withColumn("_x", -F.col(r)).where(F.col("_x") > 0)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", 0.5, 10_000).alias("_a"), F.percentile_approx("_x", F.lit(0.99), 10_000).alias("_b"))
    # a safe lower bound for the (k+1)-th largest: the upper sketch where it leaves more than 2k rows above
    j = d.join(n, keys) if keys else d.crossJoin(F.broadcast(n))
    j = j.where(F.col("_x") >= F.when(F.col("_n") * 0.009 > 2 * k, F.col("_b")).when(F.col("_n") * 0.45 > 2 * k, F.col("_a")).otherwise(0.0))
    w = Window.partitionBy(*keys).orderBy(F.col("_x").desc())
    t = j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k + 1)
    return t.groupBy(*keys).agg((F.avg(F.when(F.col("_rn") <= k, F.log("_x"))) - F.max(F.when(F.col("_rn") == k + 1, F.log("_x")))).alias("xi"))


def evt_var_es(df: DataFrame, keys: list[str], r="ret", q=0.99, threshold_q=0.95, rounds=4, grid=24) -> DataFrame:
    """Peaks over threshold: generalized Pareto fit by likelihood on a refined grid, then VaR and ES.

    With t = xi / beta the likelihood only needs mean log(1 + t x): every round is one sum over exceedances x grid.
    """
    d = df.withColumn("_l", -F.col(r))
    u = percentiles(d, keys, "_l", [threshold_q], ["u"])
    n = d.groupBy(*keys).agg(F.count("_l").alias("n"))
    j = d.join(u, keys) if keys else d.crossJoin(F.broadcast(u))
    e = j.where(F.col("_l") > F.col("u")).select(*keys, (F.col("_l") - F.col("u")).alias("_x"))
    stat = e.groupBy(*keys).agg(F.max("_x").alias("_mx"), F.avg("_x").alias("_av"), F.count("_x").alias("nu"))
    cur = stat.withColumns({"_lo": -0.95 / F.col("_mx"), "_hi": 20.0 / F.col("_av")})
    x, cur = kept(e), kept(cur)
    for _ in range(rounds):
        g = cur.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("_i"))
        # denser near zero, where the heavy-tail range is
        g = g.withColumn("_t", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.pow(F.col("_i") / grid, 2 if _ == 0 else 1))
        c = (x.join(g, keys) if keys else x.crossJoin(F.broadcast(g)))
        ll = (c.groupBy(*keys, "_i", "_t").agg(F.avg(F.log1p(F.col("_t") * F.col("_x"))).alias("xi")))
        ll = ll.withColumn("_ll", F.when(F.abs("xi") < 1e-9, F.lit(None)).otherwise(-F.log(F.col("xi") / F.col("_t")) - F.col("xi") - 1))
        best = ll.groupBy(*keys).agg(F.max_by("_t", "_ll").alias("_bt"), F.max_by("_i", "_ll").alias("_bi"))
        nb = ll.join(best, keys) if keys else ll.crossJoin(best)
        cur = kept(nb.groupBy(*keys, "_bt").agg(F.max(F.when(F.col("_i") == F.greatest(F.col("_bi") - 1, F.lit(0)), F.col("_t"))).alias("_lo"),
                                            F.max(F.when(F.col("_i") == F.least(F.col("_bi") + 1, F.lit(grid)), F.col("_t"))).alias("_hi")))
    f = x.join(cur, keys) if keys else x.crossJoin(F.broadcast(cur))
    fit = f.groupBy(*keys, "_bt").agg(F.avg(F.log1p(F.col("_bt") * F.col("_x"))).alias("xi")).withColumn("beta", F.col("xi") / F.col("_bt"))
    res = fit.join(stat.select(*keys, "nu"), keys).join(u, keys).join(n, keys) if keys else fit.crossJoin(stat.select("nu")).crossJoin(u).crossJoin(n)
    xi, beta, uu = F.col("xi"), F.col("beta"), F.col("u")
    var = uu + beta / xi * (F.pow(F.col("n") / F.col("nu") * (1 - q), -xi) - 1)
    return res.withColumn("VaR", var).withColumn("ES", (F.col("VaR") + beta - xi * uu) / (1 - xi)).select(*keys, "xi", "beta", "u", "VaR", "ES")


def newey_west(s: Series, x: str, lags: int) -> DataFrame:
    """HAC standard error of the mean with Bartlett weights."""
    keys = s.keys
    m = s.flat().df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.count(x).alias("n"))
    base = s.flat().df.drop("_blk", RN)
    d = (base.join(m, keys) if keys else base.crossJoin(F.broadcast(m))).withColumn("_d", F.col(x) - F.col("_m"))
    t = Series.of(d, s.spec, back=lags)
    t = t.add({f"_g{j}": F.col("_d") * t.lag("_d", j) for j in range(1, lags + 1)})
    g = t.flat().df.groupBy(*keys, "n", "_m").agg(F.sum(F.col("_d") * F.col("_d")).alias("_g0"), *[F.sum(f"_g{j}").alias(f"_g{j}") for j in range(1, lags + 1)])
    v = F.col("_g0")
    for j in range(1, lags + 1):
        v = v + 2 * (1 - j / (lags + 1)) * F.coalesce(F.col(f"_g{j}"), F.lit(0.0))
    return g.withColumn("se", F.sqrt(v) / F.col("n")).withColumn("t_stat", F.col("_m") / F.col("se")).select(*keys, F.col("_m").alias("mean"), "se", "t_stat")


def hac_regression(s: Series, y: str, x: str, lags=5) -> DataFrame:
    """Slope of y on x with HAC standard errors: score products by lag are summed, a 2 x 2 sandwich finishes."""
    keys = s.keys
    ols = regress(s.flat().df, keys, F.col(y), [F.lit(1.0), F.col(x)]).select(*keys, F.col("coef")[0].alias("alpha"), F.col("coef")[1].alias("beta"))
    d = s.flat().df.drop("_blk", RN).join(ols, keys).withColumn("_e", F.col(y) - F.col("alpha") - F.col("beta") * F.col(x)).withColumn("_u", F.col("_e") * F.col(x))
    t = Series.of(d, s.spec, back=lags)
    cols = {}
    for j in range(1, lags + 1):
        cols |= {f"_a{j}": F.col("_e") * t.lag("_e", j), f"_b{j}": F.col("_e") * t.lag("_u", j) + F.col("_u") * t.lag("_e", j), f"_c{j}": F.col("_u") * t.lag("_u", j)}
    g = t.add(cols).flat().df.groupBy(*keys, "alpha", "beta").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col("_e") * F.col("_e")).alias("_a0"),
        F.sum(F.col("_e") * F.col("_u")).alias("_b0"), F.sum(F.col("_u") * F.col("_u")).alias("_c0"), *[F.sum(c).alias(c) for c in cols])
    w = [2 * (1 - j / (lags + 1)) for j in range(1, lags + 1)]
    A = F.col("_a0") + sum((w[j - 1] * F.col(f"_a{j}") for j in range(1, lags + 1)), F.lit(0.0))
    B = F.col("_b0") + sum((w[j - 1] / 2 * F.col(f"_b{j}") for j in range(1, lags + 1)), F.lit(0.0))
    Cc = F.col("_c0") + sum((w[j - 1] * F.col(f"_c{j}") for j in range(1, lags + 1)), F.lit(0.0))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    p, q = -F.col("sx") / det, F.col("n") / det      # second row of the inverse
    se = F.sqrt(p * p * A + 2 * p * q * B + q * q * Cc)
    return g.withColumn("se_beta", se).withColumn("t_beta", F.col("beta") / F.col("se_beta")).select(*keys, "alpha", "beta", "se_beta", "t_beta")


def chow_test(df: DataFrame, keys: list[str], y: str, x: str, second: Column) -> DataFrame:
    """Break at a known row: pooled regression against one per segment."""
    xs = [F.lit(1.0), F.col(x)]
    pooled = regress(df, keys, F.col(y), xs).select(*keys, "n", F.col("ssr").alias("_s"))
    seg = regress(df.withColumn("_seg", second), [*keys, "_seg"], F.col(y), xs).groupBy(*keys).agg(F.sum("ssr").alias("_s12"), F.count(F.lit(1)).alias("_k"))
    j = pooled.join(seg, keys).where(F.col("_k") == 2)
    f = ((F.col("_s") - F.col("_s12")) / 2) / (F.col("_s12") / (F.col("n") - 4))
    return j.withColumn("f_stat", f).withColumn("p_value", f_sf("f_stat", F.lit(2.0), (F.col("n") - 4).cast("double"))).select(*keys, "f_stat", "p_value")


def cusum_residuals(s: Series, y: str, x: str) -> DataFrame:
    """Break at an unknown row: largest cumulative residual of the regression, Kolmogorov tail."""
    keys = s.keys
    ols = regress(s.flat().df, keys, F.col(y), [F.lit(1.0), F.col(x)]).select(*keys, F.col("coef").alias("_c"), F.col("ssr").alias("_ssr"), F.col("n").alias("_n"))
    d = s.flat().df.drop("_blk", RN).join(ols, keys).withColumn("_e", F.col(y) - F.col("_c")[0] - F.col("_c")[1] * F.col(x))
    t = Series.of(kept(d), s.spec).running({"_S": ("sum", F.col("_e"))})
    # variance with two degrees of freedom removed
    stat = F.max(F.abs("_S") / F.sqrt(F.col("_ssr") / (F.col("_n") - 2) * F.col("_n")))
    return t.df.groupBy(*keys).agg(stat.alias("stat")).withColumn("p_value", kolmogorov_sf("stat"))


def normal_posterior(df: DataFrame, keys: list[str], r="ret", prior_mean=0.0, prior_sd=0.001) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(r).alias("_n"), F.avg(r).alias("_m"), F.var_samp(r).alias("_v"))
    prec = 1 / prior_sd ** 2 + F.col("_n") / F.col("_v")
    return g.select(*keys, ((prior_mean / prior_sd ** 2 + F.col("_n") * F.col("_m") / F.col("_v")) / prec).alias("post_mean"), F.sqrt(1 / prec).alias("post_sd"))


def net_sharpe_by_capital(df: DataFrame, keys: list[str], capitals: list[float], turnover: float, adv: float, vol: float, r="ret", k=1.0, periods=252) -> DataFrame:
    m = df.groupBy(*keys).agg(F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"))
    d = m.withColumn("capital", F.explode(F.array(*[F.lit(float(c)) for c in capitals])))
    cost = turnover * k * vol * F.sqrt(turnover * F.col("capital") / adv)
    return d.select(*keys, "capital", ((F.col("_m") - cost) / F.col("_s") * math.sqrt(periods)).alias("net_sharpe"))


def capacity(by_capital: DataFrame, keys: list[str], min_sharpe=0.5) -> DataFrame:
    return by_capital.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("net_sharpe") >= min_sharpe, F.col("capital"))), F.lit(0.0)).alias("capacity"))


# ---------------------------------------------------------------- drift, ranks, curves
def psi(expected: DataFrame, actual: DataFrame, value: str, keys: list[str], bins=10) -> DataFrame:
    """Population stability of `actual` against quantile bins of `expected` (one edge row per feature key)."""
    names = [f"_q{i}" for i in range(1, bins)]
    e = percentiles(expected, keys, value, [i / bins for i in range(1, bins)], names)

    def share(df, out):
        d = df.join(e, keys) if keys else df.crossJoin(F.broadcast(e))
        b = F.lit(0)
        for q in names:
            b = b + (F.col(value) >= F.col(q)).cast("int")
        g = d.withColumn("_b", b).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*keys)
        return g.withColumn(out, F.col("_c") / F.sum("_c").over(w)).drop("_c")
    j = share(expected, "_e").join(share(actual, "_a"), [*keys, "_b"], "full")
    a, b = F.coalesce("_a", F.lit(0.0)) + 1e-6, F.coalesce("_e", F.lit(0.0)) + 1e-6
    return j.groupBy(*keys).agg(F.sum((a - b) * F.log(a / b)).alias("psi"))


def ks_two_sample(df: DataFrame, keys: list[str], value: str, sample: str) -> DataFrame:
    """Largest distance of two empirical distributions per key (sample column: boolean) with the asymptotic p-value."""
    c = df.groupBy(*keys, value).agg(F.count(F.when(F.col(sample), 1)).alias("_a"), F.count(F.when(~F.col(sample), 1)).alias("_b"))
    tot = c.groupBy(*keys).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    j = (c.join(tot, keys) if keys else c.crossJoin(tot)).withColumn("_d", F.abs(F.sum("_a").over(w) / F.col("_na") - F.sum("_b").over(w) / F.col("_nb")))
    g = j.groupBy(*keys, "_na", "_nb").agg(F.max("_d").alias("ks"))
    en = F.sqrt(F.col("_na") * F.col("_nb") / (F.col("_na") + F.col("_nb")))
    return g.withColumn("p_value", kolmogorov_sf(en * F.col("ks"))).drop("_na", "_nb")


def rank_ic(df: DataFrame, by: list[str], pred: str, realized: str) -> DataFrame:
    d = df.where(F.col(pred).isNotNull() & F.col(realized).isNotNull())
    d = d.withColumn("_p", pct_rank(pred, by)).withColumn("_r", pct_rank(realized, by))
    ic = F.try_divide(F.covar_pop("_p", "_r"), F.stddev_pop("_p") * F.stddev_pop("_r"))
    return d.groupBy(*by).agg(ic.alias("ic"), F.count(F.lit(1)).alias("n"))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under precision-recall; equal scores are one step, so the table is one row per distinct score."""
    c = df.groupBy(*keys, score).agg(F.sum(label).cast("double").alias("_tp"), F.count(F.lit(1)).alias("_n"))
    s = Series.of(c.withColumn("_neg", -F.col(score)), SeriesSpec(tuple(keys), ("_neg",), "cast(floor(_neg * 1000) as bigint)"))
    d = s.running({"_ctp": ("sum", F.col("_tp")), "_cn": ("sum", F.col("_n"))}).df
    tot = c.groupBy(*keys).agg(F.sum("_tp").alias("_P"))
    j = d.join(tot, keys) if keys else d.crossJoin(F.broadcast(tot))
    return j.groupBy(*keys).agg(F.sum(F.col("_tp") / F.col("_P") * F.col("_ctp") / F.col("_cn")).alias("pr_auc"))


def pinball(pred: Column, y: Column, q: float) -> Column:
    e = y - pred
    return F.avg(F.greatest(q * e, (q - 1) * e))


def shadow_compare(df: DataFrame, keys: list[str], champion="champion", challenger="challenger", min_days=60, margin=0.3, periods=252) -> DataFrame:
    """Sharpe of both arms and promotion; needs the daily returns of both and their positions' agreement flag `agree`."""
    a, b = (F.avg(c) / F.stddev_samp(c) * math.sqrt(periods) for c in (champion, challenger))
    g = df.groupBy(*keys).agg(a.alias("champion_sharpe"), b.alias("challenger_sharpe"), F.avg(F.col("agree").cast("double")).alias("agreement"), F.count(F.lit(1)).alias("days"))
    return g.withColumn("promote", (F.col("days") >= min_days) & (F.col("challenger_sharpe") >= F.col("champion_sharpe") + margin))


def conformal_interval(cal: DataFrame, keys: list[str], resid: str, alpha=0.1) -> DataFrame:
    """k-th smallest absolute residual with k = ceil((n + 1)(1 - alpha)), infinite when k > n."""
    from ..quantiles import kth_smallest
    d = cal.withColumn("_a", F.abs(resid))
    k = kth_smallest(d, keys, "_a", f"ceil((n + 1) * {1 - alpha})")
    return k.withColumn("half_width", F.coalesce("kth", F.lit(float("inf")))).drop("kth")


def coverage(lo: Column, hi: Column, y: Column) -> Column:
    return F.avg(((y >= lo) & (y <= hi)).cast("double"))


def lookback_windows(s: Series, x: str, n: int, out="window") -> Series:
    """Arrays of the last n values; incomplete ones are NULL."""
    s = s.ready([x], n - 1)
    return s.add({out: s.values(x, n)}, back=n - 1, uses=[x])


def time_split(n: Column, i: Column, val_frac=0.15, test_frac=0.15, gap=0) -> Column:
    """train / val / test by row position, with `gap` rows dropped before each later part."""
    t0, v0 = F.floor(n * (1 - test_frac)), F.floor(n * (1 - test_frac - val_frac))
    return (F.when(i >= t0, "test").when(i >= t0 - gap, "drop").when(i >= v0, "val").when(i >= v0 - gap, "drop").otherwise("train"))


def inside_band(live: Series, band: DataFrame, ret="ret", lower_only=False) -> DataFrame:
    """Cumulative live return against the band of its day (1-based)."""
    s = live.running({"cum": ("sum", col(ret))})
    d = s.done(keep_rn=True).withColumn("day", F.col(RN) + 1).drop(RN).join(F.broadcast(band), "day")
    ok = F.col("cum") >= F.col("lower")
    return d.withColumn("inside", ok if lower_only else ok & (F.col("cum") <= F.col("upper")))


# ---------------------------------------------------------------- event studies
def event_study(panel: DataFrame, spec: SeriesSpec, events: DataFrame, stock="ret", market="mkt", est=(-250, -30), win=(-1, 5), by: tuple[str, ...] = ()) -> DataFrame:
    """Market-model cumulative abnormal return per offset: mean over events, t of the final value, count.

    Events name a key and a row number (`event_rn`).  Estimation sums and window rows come from one row-number range
    join; only events with both windows complete count.
    """
    from ..joins import interval_join
    keys = list(spec.keys)
    d = index_rows(panel, spec)
    e = events.withColumn("event_id", F.monotonically_increasing_id()).withColumns({"_lo": F.col("event_rn") + min(est[0], win[0]), "_hi": F.col("event_rn") + max(est[1], win[1])})
    width = max(abs(est[0] - win[1]), 64)
    j = interval_join(d.select(*keys, RN, stock, market), e, keys, RN, "_lo", "_hi", width=width).withColumn("_o", F.col(RN) - F.col("event_rn"))
    g = j.groupBy("event_id").agg(*[f.alias(n) for f, n in (
        (F.regr_slope(F.when(F.col("_o").between(*est), F.col(stock)), F.when(F.col("_o").between(*est), F.col(market))), "_b"),
        (F.regr_intercept(F.when(F.col("_o").between(*est), F.col(stock)), F.when(F.col("_o").between(*est), F.col(market))), "_a"),
        (F.count(F.when(F.col("_o").between(*est), F.col(stock))), "_ne"), (F.count(F.when(F.col("_o").between(*win), F.col(stock))), "_nw"))])
    full = g.where((F.col("_ne") == est[1] - est[0] + 1) & (F.col("_nw") == win[1] - win[0] + 1))
    w = j.where(F.col("_o").between(*win)).join(full, "event_id").withColumn("_ar", F.col(stock) - F.col("_a") - F.col("_b") * F.col(market))
    car = Window.partitionBy("event_id").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("car", F.sum("_ar").over(car))
    return w.groupBy(*by, F.col("_o").alias("offset")).agg(F.avg("car").alias("mean_car"), (F.avg("car") / (F.stddev_samp("car") / F.sqrt(F.count("car")))).alias("t_stat"), F.count("car").alias("n"))


def implied_vs_realized(df: DataFrame, keys: list[str], implied="implied", realized="realized") -> DataFrame:
    i, r = F.col(implied), F.abs(F.col(realized))
    return df.groupBy(*keys).agg(F.avg(i).alias("mean_implied"), F.avg(r).alias("mean_realized"), F.avg((r > i).cast("double")).alias("share_exceeded"),
                                 F.avg(i - r).alias("mean_premium"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- label overlap
def num_concurrent(bars: DataFrame, spans: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Labels active per bar from +1 / -1 steps; spans are row numbers t0_rn, t1_rn."""
    keys = list(spec.keys)
    d = index_rows(bars, spec)
    up = spans.groupBy(*keys, F.col("t0_rn").alias(RN)).agg(F.count(F.lit(1)).alias("_u"))
    dn = spans.groupBy(*keys, (F.col("t1_rn") + 1).alias(RN)).agg(F.count(F.lit(1)).alias("_d"))
    j = d.join(up, [*keys, RN], "left").join(dn, [*keys, RN], "left").withColumn("_st", F.coalesce("_u", F.lit(0)) - F.coalesce("_d", F.lit(0))).withColumnRenamed(RN, "rn")
    s = Series.of(kept(j), spec).running({"concurrent": ("sum", F.col("_st"))})
    return s.done().drop("_u", "_d", "_st")


def avg_uniqueness(concurrent: DataFrame, spans: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean of 1 / concurrency over each span, from prefix sums joined at both ends."""
    keys = list(spec.keys)
    s = Series.of(kept(concurrent), spec).running({"_cum": ("sum", F.when(F.col("concurrent") > 0, 1 / F.col("concurrent")).otherwise(0.0))})
    c = s.done().select(*keys, "rn", "_cum")
    a = c.select(*keys, (F.col("rn") + 1).alias("t0_rn"), F.col("_cum").alias("_c0"))
    b = c.select(*keys, F.col("rn").alias("t1_rn"), F.col("_cum").alias("_c1"))
    j = spans.join(b, [*keys, "t1_rn"]).join(a, [*keys, "t0_rn"], "left")
    return j.withColumn("uniqueness", (F.col("_c1") - F.coalesce("_c0", F.lit(0.0))) / (F.col("t1_rn") - F.col("t0_rn") + 1)).drop("_c0", "_c1")
