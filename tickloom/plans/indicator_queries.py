"""Indicator, candle, level and position queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import strategies as P
from ..operators.registry import compute
from ..series import RN, Series
from .base import BARS_SPEC, BARS_SQL, decay_sql, query, sel, walk_sql

W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def bars(t, back=0, ahead=0) -> Series:
    return Series.of(t.bars(), BARS_SPEC, back, ahead)


def show(s: Series, *cols: str):
    return s.done().select("symbol", "ts", *cols)


def win(expr: str, spec: str, more: str = "") -> str:
    """Oracle of a one-window expression list over the bars."""
    return f"WITH {BARS_SQL}{more} {sel('symbol s, ts t, ' + spec, f'(SELECT *, {expr} FROM b {W})')}"


def gate(e: str, n: int, x: str = "close") -> str:
    f = f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {f} = {n} THEN {e.replace('@', 'OVER ' + f)} END"


@query("log_returns", win("ln(close / lag(close) OVER w) AS log_ret", "log_ret f"))
def _(t):
    return show(I.log_returns(bars(t, 1)), "log_ret")


@query("simple_returns", win("close / lag(close) OVER w - 1 AS ret", "ret f"))
def _(t):
    return show(I.simple_returns(bars(t, 1)), "ret")


@query("rank_pct", f"""WITH {BARS_SQL} {sel('symbol s, ts t, rank_pct f', '''(SELECT a.symbol, a.ts,
 CASE WHEN a.rn >= 19 THEN count(*) FILTER (WHERE p.close <= a.close) / 20.0 END AS rank_pct FROM b a JOIN b p
 ON p.symbol = a.symbol AND p.rn BETWEEN a.rn - 19 AND a.rn GROUP BY a.symbol, a.ts, a.rn)''')}""")
def _(t):
    return show(I.rank_pct(bars(t, 19), n=20), "rank_pct")


@query("sma", win(gate("avg(close) @", 20) + " AS sma", "sma f"))
def _(t):
    return show(I.sma(bars(t, 19), n=20), "sma")


@query("bbands", win(f"{gate('avg(close) @', 20)} AS bb_middle, {gate('avg(close) @ + 2 * stddev_pop(close) @', 20)} AS bb_upper, "
                     f"{gate('avg(close) @ - 2 * stddev_pop(close) @', 20)} AS bb_lower",
                     "bb_upper f, bb_middle f, bb_lower f"))
def _(t):
    return show(I.bbands(bars(t, 19)), "bb_upper", "bb_middle", "bb_lower")


def _fast():
    f = "(w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN rn >= 13 THEN CASE WHEN max(high) OVER {f} > min(low) OVER {f} THEN 100 * (close - min(low) OVER {f})"
            f" / (max(high) OVER {f} - min(low) OVER {f}) ELSE 0 END END AS fast")


@query("stoch", f"""WITH {BARS_SQL}, f AS (SELECT *, {_fast()} FROM b {W}),
 k AS (SELECT *, {gate('avg(fast) @', 3, 'fast')} AS sk FROM f {W}),
 d AS (SELECT *, {gate('avg(sk) @', 3, 'sk')} AS stoch_d, CASE WHEN rn >= 17 THEN sk END AS stoch_k FROM k {W})
 {sel('symbol s, ts t, stoch_k f, stoch_d f', 'd')}""")
def _(t):
    return show(I.stoch(bars(t, 17)), "stoch_k", "stoch_d")


@query("willr", win(gate("CASE WHEN max(high) @ > min(low) @ THEN -100 * (max(high) @ - close) / (max(high) @ - min(low) @) ELSE 0 END", 14)
                    + " AS willr", "willr f"))
def _(t):
    return show(I.willr(bars(t, 13)), "willr")


@query("obv", f"""WITH {BARS_SQL}, st AS (SELECT *, CASE WHEN rn = 0 THEN volume ELSE sign(close - lag(close) OVER w) * volume END AS st
 FROM b {W}) {sel('symbol s, ts t, obv f', f'(SELECT symbol, ts, sum(st) OVER w AS obv FROM st {W})')}""")
def _(t):
    return show(I.obv(bars(t, 1)), "obv")


@query("ad_line", f"""WITH {BARS_SQL}, st AS (SELECT *, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END
 * volume AS st FROM b) {sel('symbol s, ts t, ad f', f'(SELECT symbol, ts, sum(st) OVER w AS ad FROM st {W})')}""")
def _(t):
    return show(I.ad_line(bars(t)), "ad")


TR = "CASE WHEN rn > 0 THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"


@query("true_range", win(f"{TR} AS tr", "tr f"))
def _(t):
    return show(I.true_range(bars(t, 1)), "tr")


@query("realized_vol", f"""WITH {BARS_SQL}, v AS (SELECT *, ln(close / lag(close) OVER w) AS r, ln(high / low) AS hl, ln(close / open) AS oc,
 ln(open / lag(close) OVER w) AS ov, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM b {W})
 {sel('symbol s, ts t, rv_close f, rv_park f, rv_gk f, rv_rs f, rv_yz f', f'''(SELECT symbol, ts,
 {gate('sqrt(252 * avg(r * r) @)', 20, 'r')} AS rv_close, {gate('sqrt(252 * avg(hl * hl / (4 * ln(2))) @)', 20)} AS rv_park,
 {gate('sqrt(252 * avg(0.5 * hl * hl - (2 * ln(2) - 1) * oc * oc) @)', 20)} AS rv_gk,
 {gate('sqrt(252 * avg(rs) @)', 20)} AS rv_rs,
 {gate('sqrt(252 * (var_samp(ov) @ + 0.34 / (1.34 + 21.0 / 19) * var_samp(oc) @ + (1 - 0.34 / (1.34 + 21.0 / 19)) * avg(rs) @))', 20, 'ov')} AS rv_yz
 FROM v {W})''')}""")
def _(t):
    s = bars(t, 20)
    for m, o in (("close", "rv_close"), ("parkinson", "rv_park"), ("garman_klass", "rv_gk"),
                 ("rogers_satchell", "rv_rs"), ("yang_zhang", "rv_yz")):
        s = I.realized_vol(s, 20, m, out=o)
    return show(s, "rv_close", "rv_park", "rv_gk", "rv_rs", "rv_yz")


@query("cci", f"""WITH {BARS_SQL}, p AS (SELECT *, (high + low + close) / 3 AS tp FROM b), m AS (SELECT *, avg(tp) OVER (w ROWS BETWEEN 19
 PRECEDING AND CURRENT ROW) AS m FROM p {W}), d AS (SELECT a.symbol, a.ts, a.rn, a.tp, a.m, avg(abs(q.tp - a.m)) AS md FROM m a JOIN p q
 ON q.symbol = a.symbol AND q.rn BETWEEN a.rn - 19 AND a.rn GROUP BY ALL)
 {sel('symbol s, ts t, cci f', '(SELECT symbol, ts, CASE WHEN rn >= 19 THEN CASE WHEN md > 0 THEN (tp - m) / (0.015 * md) ELSE 0 END END AS cci FROM d)')}""")
def _(t):
    return show(I.cci(bars(t, 19)), "cci")


@query("roc", win("100 * (close / lag(close, 10) OVER w - 1) AS roc", "roc f"))
def _(t):
    return show(I.roc(bars(t, 10)), "roc")


@query("mfi", f"""WITH {BARS_SQL}, p AS (SELECT *, (high + low + close) / 3 AS tp FROM b), q AS (SELECT *,
 CASE WHEN rn > 0 THEN CASE WHEN tp > lag(tp) OVER w THEN tp * volume ELSE 0 END END AS pos,
 CASE WHEN rn > 0 THEN CASE WHEN tp < lag(tp) OVER w THEN tp * volume ELSE 0 END END AS neg FROM p {W})
 {sel('symbol s, ts t, mfi f', '(SELECT symbol, ts, ' + gate('CASE WHEN sum(pos) @ + sum(neg) @ > 0 THEN 100 * sum(pos) @ / (sum(pos) @ + sum(neg) @) ELSE 0 END', 14, 'pos') + f' AS mfi FROM q {W})')}""")
def _(t):
    return show(I.mfi(bars(t, 14)), "mfi")


@query("efficiency_ratio", f"""WITH {BARS_SQL}, p AS (SELECT *, abs(close - lag(close) OVER w) AS ad FROM b {W})
 {sel('symbol s, ts t, er f', '(SELECT symbol, ts, ' + gate('CASE WHEN sum(ad) @ > 0 THEN abs(close - lag(close, 10) OVER w) / sum(ad) @ ELSE 0 END', 10, 'ad') + f' AS er FROM p {W})')}""")
def _(t):
    return show(I.efficiency_ratio(bars(t, 10)), "er")


@query("rolling_zscore", win(gate("(close - avg(close) @) / stddev_pop(close) @", 20) + " AS z_pop, "
                             + gate("(close - avg(close) @) / stddev_samp(close) @", 60) + " AS z_samp", "z_pop f, z_samp f"))
def _(t):
    s = I.zscore(bars(t, 59), n=20, out="z_pop")
    return show(I.zscore(s, n=60, out="z_samp", sample=True), "z_pop", "z_samp")


_RZ = ("CASE WHEN count({x}) OVER f >= 60 AND stddev_samp({x}) OVER f > 0 THEN ({x} - avg({x}) OVER f) / stddev_samp({x}) OVER f END")


@query("composite_z", f"""WITH {BARS_SQL}, z AS (SELECT symbol, ts, {_RZ.format(x='close')} AS z1, {_RZ.format(x='volume')} AS z2 FROM b
 WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
 {sel('symbol s, ts t, composite f', '''(SELECT symbol, ts, (coalesce(z1, 0) - coalesce(z2, 0)) / nullif((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT, 0)
 AS composite FROM z)''')}""")
def _(t):
    return show(I.composite(bars(t, 251), {"close": 1, "volume": -1}), "composite")


@query("early_warning", win("CASE WHEN count(close) OVER p = 250 THEN (close - avg(close) OVER p) / stddev_samp(close) OVER p END AS z", "z f")
       .replace(W, W + ", p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)"))
def _(t):
    return show(I.early_warning_z(bars(t, 250)), "z")


@query("roll_spread", f"""WITH {BARS_SQL}, p AS (SELECT *, close - lag(close) OVER w AS dp FROM b {W}), q AS (SELECT *, lag(dp) OVER w AS dq FROM p {W})
 {sel('symbol s, ts t, roll f', '(SELECT symbol, ts, ' + gate('2 * sqrt(greatest(-covar_samp(dp, dq) @, 0))', 20, 'dq') + f' AS roll FROM q {W})')}""")
def _(t):
    return show(I.roll_spread(bars(t, 21)), "roll")


@query("amihud", f"""WITH {BARS_SQL}, p AS (SELECT *, abs(ln(close / lag(close) OVER w)) / (close * volume * 1e6) AS i FROM b {W})
 {sel('symbol s, ts t, amihud f', '(SELECT symbol, ts, ' + gate('avg(i) @ * 1e9', 20, 'i') + f' AS amihud FROM p {W})')}""")
def _(t):
    return show(I.amihud(bars(t, 20).add(volume=F.col("volume") * 1e6)), "amihud")


@query("rolling_beta", win(gate("regr_slope(close, open) @", 60) + " AS beta, " + gate("corr(close, open) @", 60) + " AS corr", "beta f, corr f"))
def _(t):
    s = I.rolling_beta(bars(t, 59), "close", "open", 60)
    return show(I.rolling_corr(s, "close", "open", 60), "beta", "corr")


@query("frac_diff", f"""WITH {BARS_SQL}, wt AS (SELECT * FROM (VALUES {', '.join(f'({i}, {w!r})' for i, w in enumerate(reversed(I.ffd_weights(0.4, 1e-3))))}) v(k, wk))
 {sel('symbol s, ts t, fd f', f'''(SELECT a.symbol, a.ts, CASE WHEN a.rn >= {len(I.ffd_weights(0.4, 1e-3)) - 1} THEN sum(wk * ln(p.close)) END AS fd FROM b a
 CROSS JOIN wt LEFT JOIN b p ON p.symbol = a.symbol AND p.rn = a.rn - k GROUP BY a.symbol, a.ts, a.rn)''')}""")
def _(t):
    s = bars(t, len(I.ffd_weights(0.4, 1e-3)) - 1)
    s = s.add(_lc=F.log("close"))
    return show(I.frac_diff(s, "_lc", 0.4, 1e-3), "fd")


@query("iv_rank_percentile", f"""WITH {BARS_SQL} {sel('symbol s, ts t, iv_rank f, iv_pct f', '''(SELECT a.symbol, a.ts,
 CASE WHEN a.rn >= 99 THEN CASE WHEN max(p.close) = min(p.close) THEN 50 ELSE 100 * (a.close - min(p.close)) / (max(p.close) - min(p.close)) END END AS iv_rank,
 CASE WHEN a.rn >= 99 THEN 100.0 * count(*) FILTER (WHERE p.rn < a.rn AND p.close < a.close) / 99 END AS iv_pct
 FROM b a JOIN b p ON p.symbol = a.symbol AND p.rn BETWEEN a.rn - 99 AND a.rn GROUP BY a.symbol, a.ts, a.rn, a.close)''')}""")
def _(t):
    s = I.iv_rank(bars(t, 99), window=100)
    return show(I.iv_percentile(s, window=100), "iv_rank", "iv_pct")


# ---------------------------------------------------------------- recurrences
def seed(x: str, n: int) -> str:
    return f"avg({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def shown(cols: str, src: str, expr: str) -> str:
    return sel(f"symbol s, ts t, {cols}", f"(SELECT b.symbol, b.ts, {expr} FROM b {src})")


@query("ema", f"""WITH {BARS_SQL}, s0 AS (SELECT *, {seed('close', 20)} AS sd0 FROM b), {decay_sql('e', 's0', '(1 - 2.0/21)', '2.0/21 * close', 19, 'sd0')}
 {shown('ema f', 'LEFT JOIN e USING (symbol, rn)', 'e.y AS ema')}""")
def _(t):
    return show(I.ema(bars(t)), "ema")


@query("ema_first", f"""WITH {BARS_SQL}, {decay_sql('e', 'b', '(1 - 2.0/21)', '2.0/21 * close', 0, 'close')}
 {shown('ema f', 'LEFT JOIN e USING (symbol, rn)', 'e.y AS ema')}""")
def _(t):
    return show(I.ema_first(bars(t)), "ema")


_GL = f"g0 AS (SELECT *, greatest(close - lag(close) OVER w, 0) AS g, greatest(lag(close) OVER w - close, 0) AS l FROM b {W})"


@query("rsi", f"""WITH {BARS_SQL}, {_GL}, g1 AS (SELECT *, {seed('g', 14)} AS sg, {seed('l', 14)} AS sl FROM g0),
 {decay_sql('ag', 'g1', '(13.0/14)', 'g / 14', 14, 'sg')}, {decay_sql('al', 'g1', '(13.0/14)', 'l / 14', 14, 'sl')}
 {shown('rsi f', 'LEFT JOIN ag USING (symbol, rn) LEFT JOIN al USING (symbol, rn)',
        'CASE WHEN al.y = 0 THEN 100 ELSE 100 - 100 / (1 + ag.y / al.y) END AS rsi')}""")
def _(t):
    return show(I.rsi(bars(t, 1)), "rsi")


@query("atr", f"""WITH {BARS_SQL}, t0 AS (SELECT *, {TR} AS tr FROM b {W}), t1 AS (SELECT *, {seed('tr', 14)} AS sd0 FROM t0),
 {decay_sql('e', 't1', '(13.0/14)', 'tr / 14', 14, 'sd0')} {shown('atr f', 'LEFT JOIN e USING (symbol, rn)', 'e.y AS atr')}""")
def _(t):
    return show(I.atr(bars(t, 1)), "atr")


@query("macd", f"""WITH {BARS_SQL}, s0 AS (SELECT *, {seed('close', 12)} AS sf, {seed('close', 26)} AS ss FROM b),
 {decay_sql('ef', 's0', '(1 - 2.0/13)', '2.0/13 * close', 25, 'sf')}, {decay_sql('es', 's0', '(1 - 2.0/27)', '2.0/27 * close', 25, 'ss')},
 ln AS (SELECT s0.symbol, s0.ts, s0.rn, ef.y - es.y AS line FROM s0 JOIN ef USING (symbol, rn) JOIN es USING (symbol, rn)),
 l1 AS (SELECT *, {seed('line', 9)} AS sd1 FROM ln), {decay_sql('sg', 'l1', '0.8', '0.2 * line', 33, 'sd1')}
 {shown('macd_line f, macd_signal f, macd_hist f', 'LEFT JOIN ln USING (symbol, rn) LEFT JOIN sg USING (symbol, rn)',
        'CASE WHEN b.rn >= 33 THEN ln.line END AS macd_line, sg.y AS macd_signal, CASE WHEN b.rn >= 33 THEN ln.line - sg.y END AS macd_hist')}""")
def _(t):
    return show(I.macd(bars(t)), "macd_line", "macd_signal", "macd_hist")


def _sum13(x):
    return f"sum({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)"


ADX_SQL = f"""d0 AS (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn, {TR} AS tr FROM b {W}),
 d1 AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM d0),
 d2 AS (SELECT *, {_sum13('pdm')} AS s1, {_sum13('mdm')} AS s2, {_sum13('tr')} AS s3 FROM d1),
 {decay_sql('w1', 'd2', '(1 - 1.0/14)', 'pdm', 13, 's1')}, {decay_sql('w2', 'd2', '(1 - 1.0/14)', 'mdm', 13, 's2')},
 {decay_sql('w3', 'd2', '(1 - 1.0/14)', 'tr', 13, 's3')},
 di AS (SELECT d2.symbol, d2.ts, d2.rn, 100 * w1.y / w3.y AS p, 100 * w2.y / w3.y AS m FROM d2 JOIN w1 USING (symbol, rn)
 JOIN w2 USING (symbol, rn) JOIN w3 USING (symbol, rn) WHERE d2.rn >= 14),
 dx AS (SELECT *, CASE WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END AS dx FROM di), dy AS (SELECT *, {seed('dx', 14)} AS sd1 FROM dx),
 {decay_sql('ax', 'dy', '(13.0/14)', 'dx / 14', 27, 'sd1')}"""


@query("adx", f"""WITH {BARS_SQL}, {ADX_SQL} {shown('adx f, adx_plus f, adx_minus f', 'LEFT JOIN di USING (symbol, rn) LEFT JOIN ax USING (symbol, rn)',
        'ax.y AS adx, di.p AS adx_plus, di.m AS adx_minus')}""")
def _(t):
    return show(I.adx(bars(t, 1)), "adx", "adx_plus", "adx_minus")


@query("kama", walk_sql(f"""{BARS_SQL}, a0 AS (SELECT *, abs(close - lag(close) OVER w) AS ad FROM b {W}), a1 AS (SELECT *, abs(close - lag(close, 10) OVER w)
 / nullif(sum(ad) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS er FROM a0 {W}),
 a2 AS (SELECT *, pow(coalesce(er, 0) * (2.0/3 - 2.0/31) + 2.0/31, 2) AS sc FROM a1)""", "a2",
    {"k": ("s.close", "CASE WHEN s.rn <= 9 THEN s.close ELSE p.k + s.sc * (s.close - p.k) END"),
     "kama": ("CAST(NULL AS DOUBLE)", "CASE WHEN s.rn >= 10 THEN p.k + s.sc * (s.close - p.k) END")}, "symbol s, ts t, kama f"))
def _(t):
    return show(I.kama(bars(t, 10)), "kama")


@query("mcclellan", f"""WITH {BARS_SQL}, n0 AS (SELECT ts, sum(sign(d)) AS net FROM (SELECT symbol, ts, close - lag(close) OVER w AS d FROM b {W}) GROUP BY ts),
 n1 AS (SELECT 'all' AS symbol, ts, coalesce(net, 0) AS net, row_number() OVER (ORDER BY ts) - 1 AS rn FROM n0),
 {decay_sql('f', 'n1', '0.9', '0.1 * net', 0, 'net')}, {decay_sql('g', 'n1', '0.95', '0.05 * net', 0, 'net')}
 {sel('ts t, mcclellan f', '(SELECT n1.ts, f.y - g.y AS mcclellan FROM n1 JOIN f USING (rn) JOIN g USING (rn))')}""")
def _(t):
    s = bars(t, 1)
    d = s.add(_d=F.signum(F.col("close") - s.lag("close"))).done()
    net = d.groupBy("ts").agg(F.count(F.when(F.col("_d") > 0, 1)).alias("advances"),
                              F.count(F.when(F.col("_d") < 0, 1)).alias("declines"))
    return I.mcclellan(Series.of(net, BARS_SPEC.with_(keys=()))).done().select("ts", "mcclellan")


@query("ewma_var", f"""WITH {BARS_SQL}, r0 AS (SELECT *, close / lag(close) OVER w - 1 AS r FROM b {W}), r1 AS (SELECT *, lag(r * r) OVER w AS q FROM r0 {W}),
 {decay_sql('e', 'r1', '0.94', '0.06 * q', 2, 'q')} {shown('ewma_var f', 'LEFT JOIN e USING (symbol, rn)', 'e.y AS ewma_var')}""")
def _(t):
    s = I.simple_returns(bars(t, 2))
    return show(I.ewma_var(s, "ret", at=2), "ewma_var")


@query("daily_vol", f"""WITH {BARS_SQL}, r0 AS (SELECT *, close / lag(close) OVER w - 1 AS r, 1.0 AS one FROM b {W}),
 {decay_sql('w1', 'r0', '(1 - 2.0/51)', 'one', 1, 'one')}, {decay_sql('w2', 'r0', '((1 - 2.0/51) * (1 - 2.0/51))', 'one', 1, 'one')},
 {decay_sql('m1', 'r0', '(1 - 2.0/51)', 'r', 1, 'r')}, {decay_sql('m2', 'r0', '(1 - 2.0/51)', 'r * r', 1, 'r * r')}
 {shown('vol f', 'LEFT JOIN w1 USING (symbol, rn) LEFT JOIN w2 USING (symbol, rn) LEFT JOIN m1 USING (symbol, rn) LEFT JOIN m2 USING (symbol, rn)',
        'CASE WHEN b.rn >= 2 THEN sqrt((m2.y / w1.y - m1.y / w1.y * m1.y / w1.y) * w1.y * w1.y / (w1.y * w1.y - w2.y)) END AS vol')}""")
def _(t):
    return show(I.daily_vol(bars(t, 1)), "vol")


@query("kalman_level", walk_sql(BARS_SQL, "b",
       {"p": ("(1 + 1e-5) * (1 - (1 + 1e-5) / (1 + 1e-5 + 1e-2))", "(p.p + 1e-5) * (1 - (p.p + 1e-5) / (p.p + 1e-5 + 1e-2))"),
        "level": ("s.close", "p.level + (p.p + 1e-5) / (p.p + 1e-5 + 1e-2) * (s.close - p.level)")}, "symbol s, ts t, level f"))
def _(t):
    return show(I.kalman_level(bars(t)), "level")


@query("differential_sharpe", f"""WITH {BARS_SQL}, r0 AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS x FROM b {W}),
 {decay_sql('ea', 'r0', '0.99', '0.01 * x', 0, '0.01 * x')}, {decay_sql('eb', 'r0', '0.99', '0.01 * x * x', 0, '0.01 * x * x')},
 z AS (SELECT r0.*, coalesce(lag(ea.y) OVER w, 0) AS a, coalesce(lag(eb.y) OVER w, 0) AS c FROM r0 JOIN ea USING (symbol, rn) JOIN eb USING (symbol, rn)
 WINDOW w AS (PARTITION BY r0.symbol ORDER BY r0.rn))
 {sel('symbol s, ts t, dsr f', '''(SELECT symbol, ts, CASE WHEN c - a * a > 1e-12 THEN (c * (x - a) - 0.5 * a * (x * x - c)) / pow(c - a * a, 1.5)
 ELSE 0 END AS dsr FROM z)''')}""")
def _(t):
    return show(I.differential_sharpe(I.simple_returns(bars(t, 1))), "dsr")


@query("indicator_set", None)
def _(t):
    return compute(t.bars(), BARS_SPEC, "sma", "bbands", "stoch", "willr", "cci", "roc", "mfi", ("zscore", {"n": 60}),
                   "rsi", "atr").drop("open", "high", "low", "close", "volume")


# ---------------------------------------------------------------- forward values
@query("forward_returns", win("ln(lead(open, 6) OVER w / lead(open, 1) OVER w) AS fwd", "fwd f"))
def _(t):
    return show(I.forward_returns(bars(t, 0, 6), 5), "fwd")


@query("overnight_intraday", win("open / lag(close) OVER w - 1 AS overnight, close / open - 1 AS intraday", "overnight f, intraday f"))
def _(t):
    return show(I.overnight_intraday(bars(t, 1)), "overnight", "intraday")


@query("har_features", f"""WITH {BARS_SQL}, r AS (SELECT *, abs(ln(close / open)) AS ar FROM b) {sel('symbol s, ts t, d f, w f, m f, target f',
 f'(SELECT symbol, ts, ar AS d, {gate("avg(ar) @", 5)} AS w, {gate("avg(ar) @", 22)} AS m, lead(ar) OVER w AS target FROM r {W})', 'm IS NOT NULL AND target IS NOT NULL')}""")
def _(t):
    s = bars(t, 21, 1).add(absret=F.abs(F.log(F.col("close") / F.col("open"))))
    return show(I.har_features(s), "d", "w", "m", "target").dropna(subset=["m", "target"])


@query("crash_labels", f"""WITH {BARS_SQL}, r AS (SELECT *, ln(close / open) AS r FROM b) {sel('symbol s, ts t, label i', f'''(SELECT symbol, ts,
 CASE WHEN lead(r, 5) OVER w IS NOT NULL THEN CASE WHEN least(lead(r, 1) OVER w, sum(r) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING),
 sum(r) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), sum(r) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING),
 sum(r) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) < -0.5 THEN 1 ELSE 0 END END AS label FROM r {W})''')}""")
def _(t):
    s = bars(t, 0, 5).add(ret=F.log(F.col("close") / F.col("open")))
    return show(I.crash_labels(s, threshold=0.5), "label")


@query("ml_features", f"""WITH {BARS_SQL}, r AS (SELECT *, ln(close / lag(close) OVER w) AS r, abs(close - lag(close) OVER w) AS ad FROM b {W})
 {sel('symbol s, ts t, ret5 f, ret20 f, vol20 f, vol_ratio f, volume_z f, er10 f', f'''(SELECT symbol, ts, ln(close / lag(close, 5) OVER w) AS ret5,
 ln(close / lag(close, 20) OVER w) AS ret20, {gate("stddev_samp(r) @", 20, "r")} AS vol20,
 {gate("stddev_samp(r) @", 5, "r")} / {gate("stddev_samp(r) @", 20, "r")} AS vol_ratio,
 {gate("(volume - avg(volume) @) / nullif(stddev_samp(volume) @, 0)", 20)} AS volume_z,
 {gate("CASE WHEN sum(ad) @ > 0 THEN abs(close - lag(close, 10) OVER w) / sum(ad) @ ELSE 0 END", 10, "ad")} AS er10 FROM r {W})''')}""")
def _(t):
    return show(I.ml_features(bars(t, 20)), "ret5", "ret20", "vol20", "vol_ratio", "volume_z", "er10")


@query("momentum_side", win("coalesce(sign(ln(close / lag(close, 20) OVER w)), 0) AS side", "side f"))
def _(t):
    return show(I.momentum_side(bars(t, 20)), "side")


@query("direction_dataset", f"""WITH {BARS_SQL}, r AS (SELECT *, ln(close / lag(close) OVER w) AS r FROM b {W})
 {sel('symbol s, ts t, lag0 f, lag1 f, lag2 f, lag3 f, lag4 f, fwd f, y i', f'''(SELECT symbol, ts, r AS lag0, lag(r) OVER w AS lag1, lag(r, 2) OVER w AS lag2,
 lag(r, 3) OVER w AS lag3, lag(r, 4) OVER w AS lag4, lead(r) OVER w AS fwd, (lead(r) OVER w > 0)::INT AS y FROM r {W})''', 'lag4 IS NOT NULL AND fwd IS NOT NULL')}""")
def _(t):
    d = show(I.direction_dataset(bars(t, 5, 1)), "lag0", "lag1", "lag2", "lag3", "lag4", "fwd", "y")
    return d.dropna(subset=["lag4", "fwd"])


# ---------------------------------------------------------------- named extensions
@query("bands_extra", f"""WITH {BARS_SQL}, t0 AS (SELECT *, {TR} AS tr FROM b {W}), t1 AS (SELECT *, {seed('tr', 20)} AS st, {seed('close', 20)} AS sc FROM t0),
 {decay_sql('ea', 't1', '(19.0/20)', 'tr / 20', 20, 'st')}, {decay_sql('ec', 't1', '(1 - 2.0/21)', '2.0/21 * close', 19, 'sc')},
 z AS (SELECT symbol, rn, {gate('avg(close) @', 20)} AS m, {gate('stddev_pop(close) @', 20)} AS sd,
 {gate('100 * log10(sum(tr) @ / (max(high) @ - min(low) @)) / log10(14)', 14, 'tr')} AS chop FROM t1 {W})
 {shown('kc_upper f, kc_middle f, kc_lower f, pct_b f, bandwidth f, chop f', 'LEFT JOIN ea USING (symbol, rn) LEFT JOIN ec USING (symbol, rn) LEFT JOIN z USING (symbol, rn)',
  'ec.y + 2 * ea.y AS kc_upper, ec.y AS kc_middle, ec.y - 2 * ea.y AS kc_lower, (b.close - m + 2 * sd) / (4 * sd) AS pct_b, 4 * sd / m AS bandwidth, chop')}""")
def _(t):
    s = I.choppiness(I.bb_percent(bars(t, 19)))
    return show(I.keltner(s), "kc_upper", "kc_middle", "kc_lower", "pct_b", "bandwidth", "chop")


@query("averages_extra", f"""WITH {BARS_SQL}, w0 AS (SELECT a.symbol, a.rn, sum(CASE WHEN a.rn - p.rn < 16 THEN (16 - (a.rn - p.rn)) * p.close END) / 136.0 AS w16,
 sum(CASE WHEN a.rn - p.rn < 8 THEN (8 - (a.rn - p.rn)) * p.close END) / 36.0 AS w8 FROM b a JOIN b p ON p.symbol = a.symbol AND p.rn BETWEEN a.rn - 15 AND a.rn
 GROUP BY a.symbol, a.rn), h0 AS (SELECT symbol, rn, CASE WHEN rn >= 15 THEN w16 END AS wma, CASE WHEN rn >= 15 THEN 2 * w8 - w16 END AS d FROM w0),
 h1 AS (SELECT a.symbol, a.rn, sum((4 - (a.rn - p.rn)) * p.d) / 10.0 AS hull FROM h0 a JOIN h0 p ON p.symbol = a.symbol AND p.rn BETWEEN a.rn - 3 AND a.rn GROUP BY a.symbol, a.rn),
 z AS (SELECT symbol, rn, {gate('regr_slope(close, rn) @', 20)} AS slope, {gate('max(high) @', 20)} AS dc_upper, {gate('min(low) @', 20)} AS dc_lower FROM b {W})
 {shown('wma f, hull f, slope f, dc_upper f, dc_lower f', 'JOIN h0 USING (symbol, rn) JOIN h1 USING (symbol, rn) JOIN z USING (symbol, rn)',
  'wma, CASE WHEN b.rn >= 18 THEN hull END AS hull, slope, dc_upper, dc_lower')}""")
def _(t):
    s = I.linreg_slope(I.donchian(I.hull(I.wma(bars(t, 20), n=16), n=16)))
    return show(s, "wma", "hull", "slope", "dc_upper", "dc_lower")


@query("dema_tema", f"""WITH {BARS_SQL}, s0 AS (SELECT *, {seed('close', 10)} AS sd0 FROM b), {decay_sql('e1', 's0', '(1 - 2.0/11)', '2.0/11 * close', 9, 'sd0')},
 s1 AS (SELECT *, {seed('y', 10).replace('ORDER BY ts', 'ORDER BY rn')} AS sd1 FROM e1), {decay_sql('e2', 's1', '(1 - 2.0/11)', '2.0/11 * y', 18, 'sd1')},
 s2 AS (SELECT *, {seed('y', 10).replace('ORDER BY ts', 'ORDER BY rn')} AS sd2 FROM e2), {decay_sql('e3', 's2', '(1 - 2.0/11)', '2.0/11 * y', 27, 'sd2')}
 {shown('dema f, tema f', 'LEFT JOIN e1 USING (symbol, rn) LEFT JOIN e2 USING (symbol, rn) LEFT JOIN e3 USING (symbol, rn)',
  '2 * e1.y - e2.y AS dema, 3 * e1.y - 3 * e2.y + e3.y AS tema')}""")
def _(t):
    return show(I.tema(I.dema(bars(t), n=10), n=10), "dema", "tema")


@query("aroon", f"""WITH {BARS_SQL} {sel('symbol s, ts t, aroon_up f, aroon_down f', '''(SELECT a.symbol, a.ts,
 CASE WHEN a.rn >= 25 THEN 100.0 * (25 - (a.rn - arg_max(p.rn, p.high * 1e6 + p.rn * 1e-3))) / 25 END AS aroon_up,
 CASE WHEN a.rn >= 25 THEN 100.0 * (25 - (a.rn - arg_min(p.rn, p.low * 1e6 - p.rn * 1e-3))) / 25 END AS aroon_down
 FROM b a JOIN b p ON p.symbol = a.symbol AND p.rn BETWEEN a.rn - 25 AND a.rn GROUP BY a.symbol, a.ts, a.rn)''')}""")
def _(t):
    return show(I.aroon(bars(t, 25)), "aroon_up", "aroon_down")


def _mid(n):
    return gate("(max(high) @ + min(low) @) / 2", n)


@query("ichimoku", f"""WITH {BARS_SQL}, m AS (SELECT *, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS sb FROM b {W})
 {sel('symbol s, ts t, tenkan f, kijun f, span_a f, span_b f', f'''(SELECT symbol, ts, tenkan, kijun, lag((tenkan + kijun) / 2, 26) OVER w AS span_a,
 lag(sb, 26) OVER w AS span_b FROM m {W})''')}""")
def _(t):
    return show(I.ichimoku(bars(t, 78)), "tenkan", "kijun", "span_a", "span_b")


@query("cmf", f"""WITH {BARS_SQL}, m AS (SELECT *, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS mf FROM b)
 {sel('symbol s, ts t, cmf f, adr f', f"(SELECT symbol, ts, {gate('sum(mf) @ / sum(volume) @', 20)} AS cmf, {gate('avg(high - low) @', 14)} AS adr FROM m {W})")}""")
def _(t):
    return show(I.average_range(I.cmf(bars(t, 19))), "cmf", "adr")


@query("oscillators_extra", None)
def _(t):
    s = I.stoch_rsi(I.tsi(I.fisher(bars(t, 9))))
    return show(s, "fisher", "tsi", "stoch_rsi")


@query("cot_index", win(gate("100.0 * (volume - min(volume) @) / nullif(max(volume) @ - min(volume) @, 0)", 50) + " AS cot_index", "cot_index f"))
def _(t):
    return show(I.cot_index(bars(t, 49), "volume", 50), "cot_index")


# ---------------------------------------------------------------- positions
@query("hysteresis", walk_sql(f"{BARS_SQL}, z AS (SELECT *, {gate('(close - avg(close) @) / stddev_pop(close) @', 20)} AS z FROM b {W})", "z",
       {"regime": ("0", "CASE WHEN s.z IS NULL THEN p.regime WHEN p.regime = -1 AND s.z <= -0.5 THEN -1 WHEN p.regime = 1 AND s.z >= 0.5 THEN 1 "
                   "WHEN s.z <= -1 THEN -1 WHEN s.z >= 1 THEN 1 ELSE 0 END")}, "symbol s, ts t, regime i"))
def _(t):
    return show(P.regime_with_hysteresis(I.zscore(bars(t, 19)), "z"), "regime")


_CH = "{f}({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query("donchian_breakout", walk_sql(f"""{BARS_SQL}, c AS (SELECT *, {_CH.format(f='max', c='high', n=20)} AS u, {_CH.format(f='min', c='low', n=20)} AS d,
 {_CH.format(f='min', c='low', n=10)} AS xl, {_CH.format(f='max', c='high', n=10)} AS xs FROM b)""", "c",
       {"pos": ("0", "CASE WHEN s.rn < 20 THEN 0 WHEN p.pos = 0 THEN CASE WHEN s.close > s.u THEN 1 WHEN s.close < s.d THEN -1 ELSE 0 END "
                "WHEN p.pos = 1 THEN CASE WHEN s.close < s.xl THEN 0 ELSE 1 END ELSE CASE WHEN s.close > s.xs THEN 0 ELSE -1 END END")},
       "symbol s, ts t, pos i"))
def _(t):
    return show(P.donchian_breakout(bars(t, 20)), "pos")


_R2 = f"""{BARS_SQL}, {_GL}, g1 AS (SELECT *, {seed('g', 2)} AS sg, {seed('l', 2)} AS sl, {gate('avg(close) @', 50)} AS m FROM g0 {W}),
 {decay_sql('ag', 'g1', '0.5', 'g / 2', 2, 'sg')}, {decay_sql('al', 'g1', '0.5', 'l / 2', 2, 'sl')},
 rs AS (SELECT g1.*, CASE WHEN al.y = 0 THEN 100 ELSE 100 - 100 / (1 + ag.y / al.y) END AS r FROM g1 LEFT JOIN ag USING (symbol, rn) LEFT JOIN al USING (symbol, rn))"""


@query("rsi2_reversion", walk_sql(_R2, "rs",
       {"pos": ("0", "CASE WHEN p.pos = 0 THEN CASE WHEN s.r < 10 AND s.close > s.m THEN 1 ELSE 0 END ELSE CASE WHEN s.r > 70 THEN 0 ELSE 1 END END")},
       "symbol s, ts t, pos i"))
def _(t):
    return show(P.rsi2_reversion(bars(t, 49), trend_n=50), "pos")


@query("rsi2_time_stop", walk_sql(_R2, "rs",
       {"pos": ("0", "CASE WHEN p.pos = 0 THEN CASE WHEN s.r < 10 AND s.close > s.m THEN 1 ELSE 0 END WHEN s.r > 70 OR p.held + 1 > 5 THEN 0 ELSE 1 END"),
        "held": ("0", "CASE WHEN p.pos = 0 THEN CASE WHEN s.r < 10 AND s.close > s.m THEN 1 ELSE 0 END ELSE p.held + 1 END")},
       "symbol s, ts t, pos i"))
def _(t):
    return show(P.rsi2_reversion(bars(t, 49), trend_n=50, max_hold=5), "pos")


_Z20 = f"{BARS_SQL}, z AS (SELECT *, {gate('(close - avg(close) @) / nullif(stddev_pop(close) @, 0)', 20)} AS z FROM b {W})"


@query("zscore_reversion", walk_sql(_Z20, "z",
       {"pos": ("0", "CASE WHEN s.z IS NULL THEN 0 WHEN p.pos = 0 THEN CASE WHEN s.z < -2 THEN 1 WHEN s.z > 2 THEN -1 ELSE 0 END "
                "WHEN abs(s.z) < 0.5 OR p.held + 1 > 10 THEN 0 ELSE p.pos END"),
        "held": ("0", "CASE WHEN p.pos = 0 THEN 1 ELSE p.held + 1 END")}, "symbol s, ts t, pos i"))
def _(t):
    return show(P.zscore_reversion(bars(t, 19)), "pos")


@query("bollinger_fade", walk_sql(f"""{BARS_SQL}, {ADX_SQL}, bb AS (SELECT b.*, ax.y AS a, {gate('avg(close) @', 20)} AS mid, {gate('stddev_pop(close) @', 20)} AS sd
 FROM b LEFT JOIN ax USING (symbol, rn) {W})""", "bb",
       {"pos": ("0", "CASE WHEN s.a IS NULL OR s.mid IS NULL THEN 0 WHEN p.pos = 0 THEN CASE WHEN s.a < 12 AND s.close < s.mid - 2 * s.sd THEN 1 "
                "WHEN s.a < 12 AND s.close > s.mid + 2 * s.sd THEN -1 ELSE 0 END WHEN s.a >= 12 THEN 0 "
                "WHEN p.pos = 1 THEN CASE WHEN s.close >= s.mid THEN 0 ELSE 1 END ELSE CASE WHEN s.close <= s.mid THEN 0 ELSE -1 END END")},
       "symbol s, ts t, pos i"))
def _(t):
    return show(P.bollinger_fade(bars(t, 19), adx_max=12.0), "pos")


@query("rolling_pair_positions", walk_sql(f"""{BARS_SQL}, m AS (SELECT *, count(*) OVER f AS cn, regr_slope(ln(close), ln(open)) OVER f AS beta, avg(ln(close)) OVER f AS my,
 avg(ln(open)) OVER f AS mx, var_pop(ln(close)) OVER f AS vy, var_pop(ln(open)) OVER f AS vx, covar_pop(ln(close), ln(open)) OVER f AS cv FROM b
 WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 zz AS (SELECT *, CASE WHEN cn = 60 THEN (ln(close) - beta * ln(open) - (my - beta * mx)) / sqrt(vy - 2 * beta * cv + beta * beta * vx) END AS z FROM m)""", "zz",
       {"pos": ("0", "CASE WHEN s.z IS NULL THEN 0 WHEN p.pos = 0 THEN CASE WHEN s.z < -2 THEN 1 WHEN s.z > 2 THEN -1 ELSE 0 END WHEN abs(s.z) < 0.5 THEN 0 ELSE p.pos END"),
        "z": ("CAST(NULL AS DOUBLE)", "s.z")}, "symbol s, ts t, z f, pos i"))
def _(t):
    s = bars(t, 60).add(y=F.log("close"), x=F.log("open"))
    return show(P.rolling_pair_positions(s), "z", "pos")


@query("s_score_positions", walk_sql(_Z20, "z",
       {"pos": ("CASE WHEN s.z < -1.25 THEN 1 WHEN s.z > 1.25 THEN -1 ELSE 0 END", "CASE WHEN s.z IS NULL THEN 0 WHEN p.pos = 0 THEN CASE WHEN s.z < -1.25 THEN 1 WHEN s.z > 1.25 THEN -1 ELSE 0 END "
                "WHEN p.pos = 1 THEN CASE WHEN s.z > -0.5 THEN 0 ELSE 1 END ELSE CASE WHEN s.z < 0.75 THEN 0 ELSE -1 END END")}, "symbol s, ts t, pos i"))
def _(t):
    return show(P.s_score_states(I.zscore(bars(t, 19)), "z"), "pos")


@query("tsmom", f"""WITH {BARS_SQL}, r AS (SELECT *, ln(close / lag(close) OVER w) AS r FROM b {W}) {sel('symbol s, ts t, weight f', f'''(SELECT symbol, ts,
 CASE WHEN lag(close, 100) OVER w IS NOT NULL THEN {gate("greatest(-2, least(2, sign(close / lag(close, 100) OVER w - 1) * 0.1 / (stddev_samp(r) @ * sqrt(252))))", 60, "r")} END
 AS weight FROM r {W})''')}""")
def _(t):
    return show(P.tsmom(bars(t, 100), 100), "weight")


@query("vol_target_overlay", f"""WITH {BARS_SQL}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r, sign(close - open) AS p FROM b {W})
 {sel('symbol s, ts t, scaled f', f'(SELECT symbol, ts, p * coalesce({gate("least(0.1 / (stddev_samp(r) @ * sqrt(252)), 2)", 20, "r")}, 0) AS scaled FROM r {W})')}""")
def _(t):
    s = I.simple_returns(bars(t, 20)).add(pos=F.signum(F.col("close") - F.col("open")))
    return show(P.vol_target_overlay(s), "scaled")


@query("overlays", f"""WITH {BARS_SQL}, r AS (SELECT *, ln(close / open) AS r, open / close AS p FROM b) {sel('symbol s, ts t, reduced f, overlay f, ratio f, inverted b', f'''(SELECT symbol, ts,
 CASE WHEN open / close > 1 THEN r * 0.5 ELSE r END AS reduced, r * CASE WHEN coalesce(lag(p) OVER w > 1.1, FALSE) THEN 0.5 ELSE 1 END AS overlay,
 open / close AS ratio, open / close > 1 AS inverted FROM r {W})''')}""")
def _(t):
    s = bars(t, 1).add(ret=F.log(F.col("close") / F.col("open")), prob=F.col("open") / F.col("close"))
    s = P.risk_off_returns(s, threshold=1.1)
    s = s.add(reduced=P.inverted_overlay("ret", "open", "close"), ratio=F.col("prob"), inverted=F.col("prob") > 1)
    return show(s, "reduced", "overlay", "ratio", "inverted")


_QE = f"""d AS (SELECT *, sign(close - open) AS dec FROM b), q AS (SELECT *, coalesce(lag(dec) OVER w, 0) AS pos, coalesce(lag(dec, 2) OVER w, 0) AS pp,
 coalesce(lead(open) OVER w / open - 1, 0) AS ret FROM d {W}), pn AS (SELECT *, abs(pos - pp) AS turnover, 0.001 * pos * ret - abs(pos - pp) * 2e-4 AS pnl FROM q),
 eq AS (SELECT *, exp(sum(ln(1 + pnl)) OVER w) AS equity FROM pn {W}), dd AS (SELECT *, max(equity) OVER w AS peak FROM eq {W})"""


def _decided(t):
    # a small position, so that the path of this volatile series stays above zero
    s = bars(t, 2, 1).add(decided=F.signum(F.col("close") - F.col("open")))
    s = P.next_bar_pnl(s)
    return s.add(pnl=0.001 * F.col("pos") * F.col("ret") - F.col("turnover") * 2e-4)


@query("next_bar_pnl", f"WITH {BARS_SQL}, {_QE} {sel('symbol s, ts t, pos f, ret f, turnover f, pnl f', 'pn')}")
def _(t):
    return show(_decided(t), "pos", "ret", "turnover", "pnl")


@query("equity_curve", f"WITH {BARS_SQL}, {_QE} {sel('symbol s, ts t, equity f, drawdown f', '(SELECT *, equity / peak - 1 AS drawdown FROM dd)')}")
def _(t):
    return show(P.equity_curve(_decided(t)), "equity", "drawdown")


@query("quick_eval", f"""WITH {BARS_SQL}, {_QE.replace('0.001 * pos * ret', 'pos * ret').replace('sign(close - open) AS dec', '0.001 * sign(close - open) AS dec')}
 {sel('symbol s, cagr f, sharpe f, max_dd f, exposure f, turnover f', '''(SELECT symbol, pow(exp(sum(ln(1 + pnl))), 252.0 / count(*)) - 1 AS cagr,
 avg(pnl) / stddev_pop(pnl) * sqrt(252) AS sharpe, min(equity / peak - 1) AS max_dd, avg((pos <> 0)::INT) AS exposure, sum(turnover) / count(*) * 252 AS turnover
 FROM dd GROUP BY symbol)''')}""")
def _(t):
    s = bars(t, 2, 1).add(decided=0.001 * F.signum(F.col("close") - F.col("open")))
    return P.quick_eval(s)
