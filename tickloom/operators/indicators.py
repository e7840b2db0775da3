"""Indicators over block-laid series.  Every function takes a `Series` and returns it with new columns.

Warm-up rows are kept and NULL.  A value at row t uses rows <= t only, except where the name says forward.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import div
from ..scan import Recur, affine
from ..series import RN, Series, col
from .registry import indicator

OHLC = ("open", "high", "low", "close")


# ---------------------------------------------------------------- returns and ranks
@indicator("log_returns", "returns", lambda: 1)
def log_returns(s: Series, x="close", out="log_ret") -> Series:
    s = s.ready([x], 1)
    return s.add({out: F.log(col(x) / s.lag(x))}, back=1, uses=[x])


@indicator("simple_returns", "returns", lambda: 1)
def simple_returns(s: Series, x="close", out="ret") -> Series:
    s = s.ready([x], 1)
    return s.add({out: col(x) / s.lag(x) - 1}, back=1, uses=[x])


@indicator("rank_pct", "normalize", lambda n: n - 1, {"n": (20, 2, 252)})
def rank_pct(s: Series, x="close", n=20, out="rank_pct") -> Series:
    """Share of the last n values that are <= the current one."""
    s = s.ready([x], n - 1)
    return s.add({out: F.size(F.filter(s.values(x, n), lambda v: v <= col(x))) / n}, back=n - 1, uses=[x]).add(
        {out: F.when(s.full(x, n), F.col(out))}, uses=[out])


@indicator("iv_rank", "normalize", lambda window: window - 1, {"window": (252, 20, 504)})
def iv_rank(s: Series, x="close", window=252, out="iv_rank") -> Series:
    """Position of x in its window range, in percent; 50 when flat."""
    s = s.ready([x], window - 1)
    lo, hi = s.min(x, window), s.max(x, window)
    v = F.when(hi == lo, 50.0).otherwise(div(100.0 * (col(x) - lo), hi - lo))
    return s.add({out: F.when(s.full(x, window), v)}, back=window - 1, uses=[x])


@indicator("iv_percentile", "normalize", lambda window: window - 1, {"window": (252, 20, 504)})
def iv_percentile(s: Series, x="close", window=252, out="iv_pct") -> Series:
    """Percent of the previous window-1 values strictly below the current one."""
    s = s.ready([x], window - 1)
    prior = s.values(x, window - 1, -1)
    v = 100.0 * F.size(F.filter(prior, lambda p: p < col(x))) / (window - 1)
    return s.add({out: F.when(prior.isNotNull(), v)}, back=window - 1, uses=[x])


# ---------------------------------------------------------------- averages and bands
@indicator("sma", "direction", lambda n: n - 1, {"n": (20, 2, 200)})
def sma(s: Series, x="close", n=20, out="sma") -> Series:
    s = s.ready([x], n - 1)
    return s.add({out: s.mean(x, n)}, back=n - 1, uses=[x])


@indicator("wma", "direction", lambda n: n - 1, {"n": (20, 2, 200)})
def wma(s: Series, x="close", n=20, out="wma") -> Series:
    """Linearly weighted mean, newest row heaviest."""
    s = s.ready([x], n - 1)
    return s.add({out: weighted(s, x, [float(i + 1) for i in range(n)], n * (n + 1) / 2)}, back=n - 1, uses=[x])


def weighted(s: Series, x, weights: list[float], total: float = 1.0) -> Column:
    """Dot product of the last len(weights) values (oldest first) with plan-time weights."""
    w = F.array(*[F.lit(v / total) for v in weights])
    prod = F.zip_with(s.values(x, len(weights)), w, lambda a, b: a * b)
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)


@indicator("bbands", "volatility", lambda n: n - 1, {"n": (20, 2, 200), "k": (2.0, 0.5, 4.0)},
           outputs=("upper", "middle", "lower"))
def bbands(s: Series, x="close", n=20, k=2.0, out="bb") -> Series:
    """Mean and mean +- k population standard deviations."""
    s = s.ready([x], n - 1)
    m, sd = s.mean(x, n), s.std_pop(x, n)
    return s.add({f"{out}_upper": m + k * sd, f"{out}_middle": m, f"{out}_lower": m - k * sd}, back=n - 1, uses=[x])


@indicator("donchian", "volatility", lambda n: n - 1, {"n": (20, 2, 200)}, outputs=("upper", "lower"))
def donchian(s: Series, n=20, out="dc", high="high", low="low") -> Series:
    s = s.ready([high, low], n - 1)
    return s.add({f"{out}_upper": s.max(high, n), f"{out}_lower": s.min(low, n)}, back=n - 1, uses=[high, low])


# ---------------------------------------------------------------- oscillators
@indicator("stoch", "momentum", lambda k, smooth_k, d: k + smooth_k + d - 3,
           {"k": (14, 2, 100), "smooth_k": (3, 1, 10), "d": (3, 1, 10)}, outputs=("k", "d"))
def stoch(s: Series, k=14, smooth_k=3, d=3, out="stoch", high="high", low="low", close="close") -> Series:
    need = k + smooth_k + d - 3
    s = s.ready([high, low, close], need)
    hh, ll = s.max(high, k), s.min(low, k)
    fast = F.when(s.full(close, k), F.when(hh > ll, 100.0 * (col(close) - ll) / (hh - ll)).otherwise(0.0))
    s = s.add(_fast=fast, back=k - 1, uses=[high, low, close])
    s = s.add(_slow=s.mean("_fast", smooth_k), back=smooth_k - 1, uses=["_fast"])
    s = s.add({f"{out}_d": s.mean("_slow", d)}, back=d - 1, uses=["_slow"])
    s = s.add({f"{out}_k": F.when(F.col(RN) >= need, F.col("_slow"))}, uses=["_slow"])
    return s.drop("_fast", "_slow")


@indicator("willr", "momentum", lambda n: n - 1, {"n": (14, 2, 100)})
def willr(s: Series, n=14, out="willr", high="high", low="low", close="close") -> Series:
    s = s.ready([high, low, close], n - 1)
    hh, ll = s.max(high, n), s.min(low, n)
    v = F.when(hh > ll, -100.0 * (hh - col(close)) / (hh - ll)).otherwise(0.0)
    return s.add({out: F.when(s.full(high, n), v)}, back=n - 1, uses=[high, low, close])


@indicator("cci", "momentum", lambda n: n - 1, {"n": (20, 2, 100)})
def cci(s: Series, n=20, out="cci", high="high", low="low", close="close") -> Series:
    s = s.ready([high, low, close], n - 1)
    s = s.add(_tp=(col(high) + col(low) + col(close)) / 3, uses=[high, low, close])
    s = s.add(_m=s.mean("_tp", n), _v=s.values("_tp", n), back=n - 1, uses=["_tp"])
    mad = F.aggregate("_v", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_m"))) / n
    v = F.when(mad > 0, (F.col("_tp") - F.col("_m")) / (0.015 * mad)).otherwise(0.0)
    return s.add({out: F.when(F.col("_m").isNotNull(), v)}, uses=["_m"]).drop("_tp", "_m", "_v")


@indicator("roc", "momentum", lambda n: n, {"n": (10, 1, 100)})
def roc(s: Series, x="close", n=10, out="roc") -> Series:
    s = s.ready([x], n)
    return s.add({out: 100.0 * (div(col(x), s.lag(x, n)) - 1)}, back=n, uses=[x])


@indicator("mfi", "pvt", lambda n: n, {"n": (14, 2, 100)})
def mfi(s: Series, n=14, out="mfi", high="high", low="low", close="close", volume="volume") -> Series:
    s = s.ready([high, low, close, volume], n)
    s = s.add(_tp=(col(high) + col(low) + col(close)) / 3, uses=[high, low, close, volume])
    up = s.lag("_tp")
    flow = F.col("_tp") * col(volume)
    s = s.add(_pos=F.when(up.isNotNull(), F.when(F.col("_tp") > up, flow).otherwise(0.0)),
              _neg=F.when(up.isNotNull(), F.when(F.col("_tp") < up, flow).otherwise(0.0)), back=1, uses=["_tp"])
    p, q = s.sum("_pos", n), s.sum("_neg", n)
    v = F.when(p + q > 0, 100.0 * p / (p + q)).otherwise(0.0)
    return s.add({out: F.when(s.full("_pos", n), v)}, back=n - 1, uses=["_pos", "_neg"]).drop("_tp", "_pos", "_neg")


@indicator("efficiency_ratio", "momentum", lambda n: n, {"n": (10, 2, 100)})
def efficiency_ratio(s: Series, x="close", n=10, out="er") -> Series:
    s = s.ready([x], n)
    s = s.add(_ad=F.abs(col(x) - s.lag(x)), back=1, uses=[x])
    path = s.sum("_ad", n)
    v = F.when(path > 0, F.abs(col(x) - s.lag(x, n)) / path).otherwise(0.0)
    return s.add({out: F.when(s.full("_ad", n), v)}, back=n - 1, uses=["_ad"]).drop("_ad")


@indicator("zscore", "normalize", lambda n: n - 1, {"n": (20, 2, 252)})
def zscore(s: Series, x="close", n=20, out="z", sample=False) -> Series:
    """(x - mean) / std over n rows, population std unless `sample`; NULL when the std is zero."""
    s = s.ready([x], n - 1)
    sd = s.std(x, n) if sample else s.std_pop(x, n)
    return s.add({out: div(col(x) - s.mean(x, n), sd)}, back=n - 1, uses=[x])


@indicator("rolling_z", "normalize", lambda window: window - 1, {"window": (252, 20, 504), "min_periods": (60, 2, 252)})
def rolling_z(s: Series, x="close", window=252, min_periods=60, out="z") -> Series:
    """Trailing z with sample std, from `min_periods` values on; NULL on zero std."""
    s = s.ready([x], window - 1)
    w = s.rows(-window + 1)
    sd = F.stddev_samp(col(x)).over(w)
    v = F.when(sd > 0, (col(x) - F.avg(col(x)).over(w)) / sd)
    return s.add({out: F.when(F.count(col(x)).over(w) >= min_periods, v)}, back=window - 1, uses=[x])


@indicator("early_warning_z", "normalize", lambda window: window, {"window": (250, 20, 500)})
def early_warning_z(s: Series, x="close", window=250, out="z") -> Series:
    """z of the current value against the window that ended one row earlier."""
    s = s.ready([x], window)
    return s.add({out: div(col(x) - s.mean(x, window, -1), s.std(x, window, -1))}, back=window, uses=[x])


def composite(s: Series, parts: dict[str, int], window=252, min_periods=60, out="composite") -> Series:
    """Mean of sign x z over the components that have a value on the row."""
    for i, c in enumerate(parts):
        s = rolling_z(s, c, window, min_periods, f"_z{i}")
    zs = [F.lit(sign) * F.col(f"_z{i}") for i, sign in enumerate(parts.values())]
    have = F.array_compact(F.array(*zs))
    mean = F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, v: a + v), F.size(have))
    return s.add({out: mean}, uses=[f"_z{i}" for i in range(len(parts))]).drop(*[f"_z{i}" for i in range(len(parts))])


# ---------------------------------------------------------------- volume
@indicator("obv", "pvt", lambda: 1)
def obv(s: Series, out="obv", close="close", volume="volume") -> Series:
    s = s.ready([close], 1)
    step = F.when(F.col(RN) == 0, col(volume)).otherwise(F.signum(col(close) - s.lag(close)) * col(volume))
    s = s.add(_st=step).running({out: ("sum", F.col("_st"))})
    return s.drop("_st")


@indicator("ad_line", "pvt", lambda: 0)
def ad_line(s: Series, out="ad", high="high", low="low", close="close", volume="volume") -> Series:
    h, lo, c = col(high), col(low), col(close)
    m = F.when(h > lo, ((c - lo) - (h - c)) / (h - lo)).otherwise(0.0) * col(volume)
    return s.running({out: ("sum", m)})


def session_vwap(s: Series, day: Column, price="price", volume="volume", out="vwap") -> Series:
    """Running volume-weighted price that restarts on every session date; NULL while no volume traded."""
    s = s.flat()
    inner = s.spec.with_(keys=(*s.spec.keys, "_day"))
    t = Series.of(s.df.drop("_blk", "_rn").withColumn("_day", day), inner)
    t = t.running({"_pv": ("sum", col(price) * col(volume)), "_vv": ("sum", col(volume))})
    return t.add({out: F.when(F.col("_vv") > 0, F.col("_pv") / F.col("_vv"))}).drop("_pv", "_vv", "_day")


def anchored_vwap(s: Series, anchor: Column, price="price", volume="volume", out="avwap") -> Series:
    """VWAP accumulated from the anchor row number on; NULL before it."""
    on = F.col(RN) >= anchor
    s = s.running({"_pv": ("sum", F.when(on, col(price) * col(volume))), "_vv": ("sum", F.when(on, col(volume)))})
    return s.add({out: F.when(on & (F.col("_vv") > 0), F.col("_pv") / F.col("_vv"))}).drop("_pv", "_vv")


# ---------------------------------------------------------------- volatility
def true_range_col(s: Series, high="high", low="low", close="close") -> Column:
    pc = s.lag(close)
    return F.when(pc.isNotNull(), F.greatest(col(high) - col(low), F.abs(col(high) - pc), F.abs(col(low) - pc)))


@indicator("true_range", "volatility", lambda: 1)
def true_range(s: Series, out="tr", high="high", low="low", close="close") -> Series:
    s = s.ready([high, low, close], 1)
    return s.add({out: true_range_col(s, high, low, close)}, back=1, uses=[high, low, close])


@indicator("realized_vol", "volatility", lambda n: n, {"n": (20, 2, 252)})
def realized_vol(s: Series, n=20, method="parkinson", periods=252, out="rv", o="open", h="high", l="low",  # noqa: E741
                 c="close") -> Series:
    O, H, L, C = col(o), col(h), col(l), col(c)
    s = s.ready([o, h, l, c], n)
    prev = s.lag(c)
    rs = F.log(H / C) * F.log(H / O) + F.log(L / C) * F.log(L / O)
    ln2 = math.log(2)
    one = {"close": F.pow(F.log(C / prev), 2), "parkinson": F.pow(F.log(H / L), 2) / (4 * ln2),
           "garman_klass": 0.5 * F.pow(F.log(H / L), 2) - (2 * ln2 - 1) * F.pow(F.log(C / O), 2),
           "rogers_satchell": rs}
    if method in one:
        s = s.add(_v=one[method], back=1, uses=[o, h, l, c])
        return s.add({out: F.sqrt(periods * s.mean("_v", n))}, back=n - 1, uses=["_v"]).drop("_v")
    if method != "yang_zhang":
        raise ValueError(f"unknown method {method!r}")
    s = s.add(_on=F.log(O / prev), _oc=F.log(C / O), _rs=rs, back=1, uses=[o, h, l, c])
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    w = s.rows(-n + 1)
    var = F.var_samp("_on").over(w) + k * F.var_samp("_oc").over(w) + (1 - k) * F.avg("_rs").over(w)
    return s.add({out: F.when(s.full("_on", n), F.sqrt(periods * var))}, back=n - 1, uses=["_on"]).drop(
        "_on", "_oc", "_rs")


@indicator("roll_spread", "microstructure", lambda window: window + 1, {"window": (20, 5, 252)})
def roll_spread(s: Series, x="close", window=20, out="roll") -> Series:
    """2 sqrt(-cov(dp, lag dp)) over the window, zero where the covariance is not negative."""
    s = s.ready([x], window + 1)
    s = s.add(_dp=col(x) - s.lag(x), back=1, uses=[x])
    s = s.add(_dq=s.lag("_dp"), back=1, uses=["_dp"])
    cv = F.when(s.full("_dq", window), F.covar_samp("_dp", "_dq").over(s.rows(-window + 1)))
    return s.add({out: 2 * F.sqrt(F.greatest(-cv, F.lit(0.0)))}, back=window - 1, uses=["_dq"]).add(
        {out: F.when(s.full("_dq", window), F.col(out))}).drop("_dp", "_dq")


@indicator("amihud", "microstructure", lambda window: window, {"window": (20, 5, 252)})
def amihud(s: Series, window=20, out="amihud", close="close", volume="volume") -> Series:
    s = s.ready([close, volume], window)
    s = s.add(_i=div(F.abs(F.log(col(close) / s.lag(close))), col(close) * col(volume)), back=1, uses=[close])
    return s.add({out: s.mean("_i", window) * 1e9}, back=window - 1, uses=["_i"]).drop("_i")


@indicator("rolling_beta", "statistics", lambda window: window - 1, {"window": (60, 5, 252)})
def rolling_beta(s: Series, y="y", x="x", window=60, out="beta") -> Series:
    s = s.ready([y, x], window - 1)
    w = s.rows(-window + 1)
    b = div(F.covar_samp(col(y), col(x)).over(w), F.var_samp(col(x)).over(w))
    return s.add({out: F.when(s.full(x, window), b)}, back=window - 1, uses=[y, x])


@indicator("rolling_corr", "statistics", lambda window: window - 1, {"window": (252, 5, 504)})
def rolling_corr(s: Series, y="y", x="x", window=252, out="corr") -> Series:
    s = s.ready([y, x], window - 1)
    return s.add({out: F.when(s.full(x, window), F.corr(col(y), col(x)).over(s.rows(-window + 1)))},
                 back=window - 1, uses=[y, x])


def ffd_weights(d: float, thresh: float = 1e-4) -> list[float]:
    """Fractional-difference weights, oldest first, cut at the threshold."""
    w = [1.0]
    while True:
        k = len(w)
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < thresh:
            return w[::-1]
        w.append(nxt)


@indicator("frac_diff", "normalize", lambda d: len(ffd_weights(d)) - 1, {"d": (0.4, 0.0, 1.0)})
def frac_diff(s: Series, x="close", d=0.4, thresh=1e-4, out="fd") -> Series:
    w = ffd_weights(d, thresh)
    s = s.ready([x], len(w) - 1)
    return s.add({out: weighted(s, x, w)}, back=len(w) - 1, uses=[x])


# ---------------------------------------------------------------- recurrences
def _seeded(seed: Column, at: int, a: Column | float, b: Column, n: int = 1, how: str = "mean",
            memory: int | None = None) -> Recur:
    return Recur(a, b, at, seed, n, how, memory)


def ema_terms(x, n: int, start: int = 0) -> Recur:
    alpha = 2.0 / (n + 1)
    return Recur(1 - alpha, alpha * col(x), start + n - 1, col(x), n)


def wilder_terms(x, n: int, first: int) -> Recur:
    """Wilder average of x, seeded with the mean of rows first .. first+n-1."""
    return Recur((n - 1) / n, col(x) / n, first + n - 1, col(x), n)


@indicator("ema", "direction", lambda n: n - 1, {"n": (20, 2, 200)})
def ema(s: Series, x="close", n=20, out="ema") -> Series:
    """alpha = 2/(n+1), seeded with the mean of the first n values."""
    s = s.flat()
    return affine(s, {out: ema_terms(x, n)})


def ema_many(s: Series, x="close", ns=(12, 26), prefix="ema_") -> Series:
    """Several averages in one pass over the blocks."""
    s = s.flat()
    return affine(s, {f"{prefix}{n}": ema_terms(x, n) for n in ns})


@indicator("ema_first", "direction", lambda: 0, {"n": (20, 2, 200)})
def ema_first(s: Series, x="close", n=20, out="ema", alpha: float | None = None) -> Series:
    """EMA seeded with the first value."""
    s = s.flat()
    a = 2.0 / (n + 1) if alpha is None else alpha
    return affine(s, {out: _seeded(col(x), 0, 1 - a, a * col(x))})


@indicator("rsi", "momentum", lambda n: n, {"n": (14, 2, 100)})
def rsi(s: Series, x="close", n=14, out="rsi", seed="mean") -> Series:
    """Wilder RSI; seed 'mean' of the first n changes or 'first' value (recursive from the first change)."""
    s = s.ready([x], 1)
    d = col(x) - s.lag(x)
    s = s.add(_g=F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), _l=F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))))
    s = s.flat()
    if seed == "mean":
        s = affine(s, {"_ag": wilder_terms("_g", n, 1), "_al": wilder_terms("_l", n, 1)})
    else:
        s = affine(s, {"_ag": _seeded(F.col("_g"), 1, 1 - 1 / n, F.col("_g") / n),
                       "_al": _seeded(F.col("_l"), 1, 1 - 1 / n, F.col("_l") / n)})
    v = F.when(F.col("_al") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + div(F.col("_ag"), F.col("_al"))))
    return s.add({out: F.when(F.col("_ag").isNotNull(), v)}).drop("_g", "_l", "_ag", "_al")


@indicator("atr", "volatility", lambda n: n, {"n": (14, 2, 100)})
def atr(s: Series, n=14, out="atr", high="high", low="low", close="close") -> Series:
    s = true_range(s, "_tr", high, low, close).flat()
    return affine(s, {out: wilder_terms("_tr", n, 1)}).drop("_tr")


@indicator("macd", "momentum", lambda slow, signal: slow + signal - 2,
           {"fast": (12, 2, 50), "slow": (26, 5, 100), "signal": (9, 2, 50)}, outputs=("line", "signal", "hist"))
def macd(s: Series, x="close", fast=12, slow=26, signal=9, out="macd") -> Series:
    """Both averages start on row slow-1; all outputs are NULL before slow+signal-2."""
    s = s.flat()
    s = affine(s, {"_f": ema_terms(x, fast, slow - fast), "_s": ema_terms(x, slow)})
    s = s.add(_line=F.col("_f") - F.col("_s"))
    s = affine(s, {f"{out}_signal": ema_terms("_line", signal, slow - 1)})
    on = F.col(RN) >= slow + signal - 2
    s = s.add({f"{out}_line": F.when(on, F.col("_line"))})
    return s.add({f"{out}_hist": F.col(f"{out}_line") - F.col(f"{out}_signal")}).drop("_f", "_s", "_line")


@indicator("adx", "direction", lambda n: 2 * n - 1, {"n": (14, 2, 100)}, outputs=("adx", "plus_di", "minus_di"))
def adx(s: Series, n=14, out="adx", high="high", low="low", close="close") -> Series:
    """Wilder sums of directional moves and true range; DI from row n, ADX from row 2n-1."""
    s = s.ready([high, low, close], 1)
    up, dn = col(high) - s.lag(high), s.lag(low) - col(low)
    s = s.add(_p=F.when(up.isNotNull(), F.when((up > dn) & (up > 0), up).otherwise(0.0)),
              _m=F.when(up.isNotNull(), F.when((dn > up) & (dn > 0), dn).otherwise(0.0)),
              _t=true_range_col(s, high, low, close)).flat()

    def wsum(x):
        return Recur(1 - 1 / n, F.col(x), n - 1, F.col(x), n - 1, "sum")
    s = affine(s, {"_sp": wsum("_p"), "_sm": wsum("_m"), "_st": wsum("_t")})
    on = F.col(RN) >= n
    s = s.add({f"{out}_plus": F.when(on, div(100 * F.col("_sp"), F.col("_st"))),
               f"{out}_minus": F.when(on, div(100 * F.col("_sm"), F.col("_st")))})
    p, m = F.col(f"{out}_plus"), F.col(f"{out}_minus")
    s = s.add(_dx=F.when(on, F.when(p + m > 0, 100 * F.abs(p - m) / (p + m)).otherwise(0.0)))
    return affine(s, {out: wilder_terms("_dx", n, n)}).drop("_p", "_m", "_t", "_sp", "_sm", "_st", "_dx")


@indicator("kama", "direction", lambda n: n, {"n": (10, 2, 100), "fast": (2, 2, 10), "slow": (30, 10, 100)})
def kama(s: Series, x="close", n=10, fast=2, slow=30, out="kama") -> Series:
    """Adaptive average: the smoothing constant of each row follows its efficiency ratio."""
    s = efficiency_ratio(s, x, n, "_er").flat()
    f, w = 2 / (fast + 1), 2 / (slow + 1)
    sc = F.pow(F.coalesce(F.col("_er"), F.lit(0.0)) * (f - w) + w, 2)
    s = affine(s, {out: _seeded(col(x), n - 1, 1 - sc, sc * col(x), memory=math.ceil(42 / (w * w)))})
    return s.add({out: F.when(F.col(RN) >= n, F.col(out))}).drop("_er")


def mcclellan(s: Series, advances="advances", declines="declines", out="mcclellan") -> Series:
    s = s.flat()
    net = (col(advances) - col(declines)).cast("double")
    s = affine(s, {"_f": _seeded(net, 0, 0.90, 0.10 * net), "_s": _seeded(net, 0, 0.95, 0.05 * net)})
    return s.add({out: F.col("_f") - F.col("_s")}).drop("_f", "_s")


def ewma_var(s: Series, r="ret", lam=0.94, out="ewma_var", at=1) -> Series:
    """Variance forecast for row t from returns before t, started with the first squared return."""
    s = s.ready([r], 1)
    s = s.add(_r2=s.lag(F.col(r) * F.col(r))).flat()
    prev = F.col("_r2")
    return affine(s, {out: _seeded(prev, at, lam, (1 - lam) * prev)}).drop("_r2")


@indicator("daily_vol", "volatility", lambda: 2, {"span": (50, 5, 200)})
def daily_vol(s: Series, x="close", span=50, out="vol") -> Series:
    """Exponentially weighted standard deviation of simple returns, bias corrected."""
    s = simple_returns(s, x, "_r").flat()
    a = 2.0 / (span + 1)
    r = F.col("_r")
    one = F.when(r.isNotNull(), 1.0)
    k = 1 - a
    s = affine(s, {"_w": Recur(k, one), "_w2": Recur(k * k, one), "_s1": Recur(k, r), "_s2": Recur(k, r * r)})
    w, w2, m = F.col("_w"), F.col("_w2"), F.col("_s1") / F.col("_w")
    var = (F.col("_s2") / w - m * m) * div(w * w, w * w - w2)
    return s.add({out: F.when(F.col(RN) >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))}).drop(
        "_r", "_w", "_w2", "_s1", "_s2")


@indicator("kalman_level", "filters", lambda: 0)
def kalman_level(s: Series, x="close", q=1e-5, r=1e-2, out="level") -> Series:
    """Local-level filter.  The gain does not depend on the data, so it is a plan-time list up to its limit."""
    p, gains = 1.0, []
    while len(gains) < 20_000:
        p += q
        k = p / (p + r)
        p *= 1 - k
        if gains and k == gains[-1]:
            break
        gains.append(k)
    s = s.flat()
    table = s.df.sparkSession.createDataFrame([(i, g) for i, g in enumerate(gains)], "_gi int, _k double")
    last = len(gains) - 1
    df = s.df.withColumn("_gi", F.least(F.col(RN), F.lit(last)).cast("int")).join(F.broadcast(table), "_gi").drop("_gi")
    from dataclasses import replace
    s = replace(s, df=df)
    k = F.col("_k")
    # the filter starts at the first price, so its first update changes nothing
    return affine(s, {out: _seeded(col(x), 0, 1 - k, k * col(x), memory=math.ceil(42 / min(gains)))}).drop("_k")


def differential_sharpe(s: Series, r="ret", eta=0.01, out="dsr") -> Series:
    """Increment of the exponentially weighted Sharpe ratio, from moments before the row."""
    s = s.flat()
    x = F.coalesce(col(r), F.lit(0.0))
    s = affine(s, {"_A": Recur(1 - eta, eta * x), "_B": Recur(1 - eta, eta * x * x)})
    s = s.halo(1)
    A, B = F.coalesce(s.lag("_A"), F.lit(0.0)), F.coalesce(s.lag("_B"), F.lit(0.0))
    var = B - A * A
    d = (B * (x - A) - 0.5 * A * (x * x - B)) / F.pow(var, 1.5)
    return s.add({out: F.when(var > 1e-12, d).otherwise(0.0)}).drop("_A", "_B")


# ---------------------------------------------------------------- forward values (labels and research)
@indicator("forward_returns", "labels", lambda: 0, prefix_only=False)
def forward_returns(s: Series, horizon=5, out="fwd", open_="open") -> Series:
    """Enter at the next open, leave `horizon` bars later at the open."""
    s = s.ready([open_], 0, horizon + 1)
    return s.add({out: F.log(s.lead(open_, horizon + 1) / s.lead(open_, 1))})


@indicator("overnight_intraday", "returns", lambda: 1, outputs=("overnight", "intraday"))
def overnight_intraday(s: Series, open_="open", close="close") -> Series:
    s = s.ready([open_, close], 1)
    return s.add(overnight=col(open_) / s.lag(close) - 1, intraday=col(close) / col(open_) - 1, back=1,
                 uses=[open_, close])


def har_features(s: Series, x="absret") -> Series:
    """Day, week and month means of the input and its next value."""
    s = s.ready([x], 21, 1)
    return s.add(d=col(x), w=s.mean(x, 5), m=s.mean(x, 22), target=s.lead(x, 1), back=21, uses=[x])


def crash_labels(s: Series, ret="ret", horizon=5, threshold=0.04, out="label") -> Series:
    """1 when the worst cumulative return of the next `horizon` rows is below -threshold; NULL if incomplete."""
    s = s.ready([ret], 0, horizon)
    path, worst = F.lit(0.0), None
    for k in range(1, horizon + 1):
        path = path + s.lead(ret, k)
        worst = path if worst is None else F.least(worst, path)
    return s.add({out: F.when(s.lead(ret, horizon).isNotNull(), (worst < -threshold).cast("int"))})


@indicator("ml_features", "features", lambda: 20,
           outputs=("ret5", "ret20", "vol20", "vol_ratio", "er10", "volume_z"))
def ml_features(s: Series, close="close", volume="volume") -> Series:
    """Momentum, volatility, volatility ratio, efficiency and volume z-score from one set of frames."""
    s = s.ready([close, volume], 20)
    s = s.add(_r=F.log(col(close) / s.lag(close)), back=1, uses=[close])
    s = s.add(ret5=F.log(col(close) / s.lag(close, 5)), ret20=F.log(col(close) / s.lag(close, 20)),
              vol20=s.std("_r", 20), vol_ratio=div(s.std("_r", 5), s.std("_r", 20)),
              volume_z=div(col(volume) - s.mean(volume, 20), s.std(volume, 20)), back=20, uses=[close, volume])
    return efficiency_ratio(s, close, 10, "er10").drop("_r")


@indicator("momentum_side", "features", lambda lookback: lookback, {"lookback": (20, 2, 252)})
def momentum_side(s: Series, x="close", lookback=20, out="side") -> Series:
    s = s.ready([x], lookback)
    return s.add({out: F.coalesce(F.signum(F.log(col(x) / s.lag(x, lookback))), F.lit(0.0))}, back=lookback, uses=[x])


def direction_dataset(s: Series, x="close", n_lags=5) -> Series:
    """Lagged log returns, the next return and its direction; incomplete rows are for the caller to drop."""
    s = s.ready([x], n_lags, 1)
    s = s.add(_r=F.log(col(x) / s.lag(x)), back=1, uses=[x])
    s = s.add({f"lag{k}": s.lag("_r", k) if k else F.col("_r") for k in range(n_lags)})
    s = s.add(fwd=s.lead("_r", 1))
    return s.add(y=(F.col("fwd") > 0).cast("int")).drop("_r")


# ---------------------------------------------------------------- named extensions of the same shapes
@indicator("keltner", "volatility", lambda n: n, {"n": (20, 2, 100), "mult": (2.0, 0.5, 5.0)},
           outputs=("upper", "middle", "lower"))
def keltner(s: Series, n=20, mult=2.0, out="kc") -> Series:
    s = true_range(s, "_tr").flat()
    s = affine(s, {"_e": ema_terms("close", n), "_a": wilder_terms("_tr", n, 1)})
    return s.add({f"{out}_upper": F.col("_e") + mult * F.col("_a"), f"{out}_middle": F.col("_e"),
                  f"{out}_lower": F.col("_e") - mult * F.col("_a")}).drop("_tr", "_e", "_a")


@indicator("bb_percent", "volatility", lambda n: n - 1, {"n": (20, 2, 200), "k": (2.0, 0.5, 4.0)},
           outputs=("pct_b", "bandwidth"))
def bb_percent(s: Series, x="close", n=20, k=2.0) -> Series:
    s = bbands(s, x, n, k, "_bb")
    u, m, lo = F.col("_bb_upper"), F.col("_bb_middle"), F.col("_bb_lower")
    return s.add(pct_b=div(col(x) - lo, u - lo), bandwidth=div(u - lo, m), uses=["_bb_middle"]).drop(
        "_bb_upper", "_bb_middle", "_bb_lower")


@indicator("choppiness", "volatility", lambda n: n, {"n": (14, 2, 100)})
def choppiness(s: Series, n=14, out="chop") -> Series:
    s = s.ready(["high", "low", "close"], n)
    s = true_range(s, "_tr")
    rng = s.max("high", n) - s.min("low", n)
    v = 100 * F.log10(div(s.sum("_tr", n), rng)) / math.log10(n)
    return s.add({out: v}, back=n - 1, uses=["_tr"]).drop("_tr")


@indicator("hull", "direction", lambda n: n - 1 + int(math.sqrt(n)) - 1, {"n": (16, 4, 200)})
def hull(s: Series, x="close", n=16, out="hull") -> Series:
    r = int(math.sqrt(n))
    s = s.ready([x], n + r)
    s = wma(wma(s, x, n // 2, "_h"), x, n, "_f")
    s = s.add(_d=2 * F.col("_h") - F.col("_f"), uses=["_h", "_f"])
    return wma(s, "_d", r, out).drop("_h", "_f", "_d")


@indicator("linreg_slope", "direction", lambda n: n - 1, {"n": (20, 3, 200)})
def linreg_slope(s: Series, x="close", n=20, out="slope") -> Series:
    s = s.ready([x], n - 1)
    return s.add({out: F.when(s.full(x, n), F.regr_slope(col(x), F.col(RN)).over(s.rows(-n + 1)))},
                 back=n - 1, uses=[x])


@indicator("dema", "direction", lambda n: 2 * n - 2, {"n": (20, 2, 200)})
def dema(s: Series, x="close", n=20, out="dema") -> Series:
    s = ema(s, x, n, "_e1")
    s = affine(s, {"_e2": ema_terms("_e1", n, n - 1)})
    return s.add({out: 2 * F.col("_e1") - F.col("_e2")}).drop("_e1", "_e2")


@indicator("tema", "direction", lambda n: 3 * n - 3, {"n": (20, 2, 200)})
def tema(s: Series, x="close", n=20, out="tema") -> Series:
    s = ema(s, x, n, "_e1")
    s = affine(s, {"_e2": ema_terms("_e1", n, n - 1)})
    s = affine(s, {"_e3": ema_terms("_e2", n, 2 * n - 2)})
    return s.add({out: 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")}).drop("_e1", "_e2", "_e3")


@indicator("aroon", "momentum", lambda n: n, {"n": (25, 2, 100)}, outputs=("up", "down"))
def aroon(s: Series, n=25, out="aroon") -> Series:
    """100 (n - rows since the extreme) / n over n+1 rows; the latest extreme counts."""
    s = s.ready(["high", "low"], n)
    w = s.rows(-n)
    hi = F.max(F.struct("high", RN)).over(w)[RN]
    lo = F.min(F.struct(F.col("low"), (-F.col(RN)).alias("neg"))).over(w)["neg"]
    full = F.count("high").over(w) == n + 1
    return s.add({f"{out}_up": F.when(full, 100.0 * (n - (F.col(RN) - hi)) / n),
                  f"{out}_down": F.when(full, 100.0 * (n - (F.col(RN) + lo)) / n)}, back=n, uses=["high", "low"])


@indicator("ichimoku", "direction", lambda: 78, outputs=("tenkan", "kijun", "span_a", "span_b"))
def ichimoku(s: Series, a=9, b=26, c=52) -> Series:
    """Frame midpoints; the leading spans are shown on the row where they are known (shifted by lag, never lead)."""
    s = s.ready(["high", "low"], c + b)

    def mid(n):
        return (s.max("high", n) + s.min("low", n)) / 2
    s = s.add(tenkan=mid(a), kijun=mid(b), _sb=mid(c), back=c - 1, uses=["high", "low"])
    s = s.add(span_a=s.lag((F.col("tenkan") + F.col("kijun")) / 2, b), span_b=s.lag("_sb", b), back=b, uses=["_sb"])
    return s.drop("_sb")


@indicator("cmf", "pvt", lambda n: n - 1, {"n": (20, 2, 100)})
def cmf(s: Series, n=20, out="cmf") -> Series:
    s = s.ready(["high", "low", "close", "volume"], n - 1)
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    s = s.add(_mf=F.when(h > lo, ((c - lo) - (h - c)) / (h - lo)).otherwise(0.0) * F.col("volume"),
              uses=["high", "low", "close", "volume"])
    return s.add({out: div(s.sum("_mf", n), s.sum("volume", n))}, back=n - 1, uses=["_mf"]).drop("_mf")


@indicator("tsi", "momentum", lambda slow, fast: slow + fast, {"slow": (25, 2, 100), "fast": (13, 2, 50)})
def tsi(s: Series, x="close", slow=25, fast=13, out="tsi") -> Series:
    """Double-smoothed change over double-smoothed absolute change (first-value seeds)."""
    s = s.ready([x], 1)
    s = s.add(_d=col(x) - s.lag(x)).flat()
    a, b = 2 / (slow + 1), 2 / (fast + 1)
    d, ad = F.col("_d"), F.abs(F.col("_d"))
    s = affine(s, {"_m1": _seeded(d, 1, 1 - a, a * d), "_v1": _seeded(ad, 1, 1 - a, a * ad)})
    m, v = F.col("_m1"), F.col("_v1")
    s = affine(s, {"_m2": _seeded(m, 1, 1 - b, b * m), "_v2": _seeded(v, 1, 1 - b, b * v)})
    return s.add({out: div(100 * F.col("_m2"), F.col("_v2"))}).drop("_d", "_m1", "_v1", "_m2", "_v2")


@indicator("stoch_rsi", "momentum", lambda n: 2 * n, {"n": (14, 2, 100)})
def stoch_rsi(s: Series, x="close", n=14, out="stoch_rsi") -> Series:
    s = rsi(s, x, n, "_rsi").halo(n)
    lo, hi = s.min("_rsi", n), s.max("_rsi", n)
    v = F.when(hi > lo, (F.col("_rsi") - lo) / (hi - lo)).otherwise(0.0)
    return s.add({out: F.when(s.full("_rsi", n), v)}).drop("_rsi")


@indicator("fisher", "momentum", lambda n: n - 1, {"n": (9, 2, 100)})
def fisher(s: Series, n=9, out="fisher", high="high", low="low") -> Series:
    """Fisher transform of the smoothed position of the midprice in its range (two first-order recurrences)."""
    s = s.ready([high, low], n - 1)
    mid = (col(high) + col(low)) / 2
    s = s.add(_mid=mid, uses=[high, low])
    lo, hi = s.min("_mid", n), s.max("_mid", n)
    pos = F.when(hi > lo, (F.col("_mid") - lo) / (hi - lo) - 0.5).otherwise(0.0)
    s = s.add(_pos=F.when(s.full("_mid", n), pos)).flat()
    s = affine(s, {"_v": Recur(0.67, 0.66 * F.col("_pos"))})
    v = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("_v")))
    s = s.add(_ln=0.5 * F.log((1 + v) / (1 - v)))
    return affine(s, {out: Recur(0.5, F.col("_ln"))}).drop("_mid", "_pos", "_v", "_ln")


@indicator("average_range", "levels", lambda n: n - 1, {"n": (14, 2, 100)})
def average_range(s: Series, n=14, out="adr") -> Series:
    s = s.ready(["high", "low"], n - 1)
    return s.add({out: s.mean(F.col("high") - F.col("low"), n)}, back=n - 1, uses=["high", "low"])


@indicator("cot_index", "sentiment", lambda n: n - 1, {"n": (156, 10, 260)})
def cot_index(s: Series, x="net", n=156, out="cot_index") -> Series:
    s = s.ready([x], n - 1)
    lo, hi = s.min(x, n), s.max(x, n)
    return s.add({out: div(100.0 * (col(x) - lo), hi - lo)}, back=n - 1, uses=[x])
