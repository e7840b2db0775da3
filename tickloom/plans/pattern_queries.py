"""Candles, levels, swings, chart patterns, actions and rule trees."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import patterns as P
from ..operators.conditions import Condition, build_condition
from ..series import RN, Series
from .base import BARS_SPEC, BARS_SQL, query, sel, walk_sql
from .indicator_queries import TR, W, bars, decay_sql, gate, seed, show, shown, win


@query("candle_anatomy", win("abs(close - open) AS body, high - low AS range, high - greatest(open, close) AS upper, least(open, close) - low AS lower, "
                             "CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END AS body_pct, "
                             "CASE WHEN high > low AND abs(close - open) <= 0.1 * (high - low) THEN 1 ELSE 0 END AS doji",
                             "body f, range f, upper f, lower f, body_pct f, doji i"))
def _(t):
    s = P.doji(bars(t)).add(P.anatomy())
    return show(s, "body", "range", "upper", "lower", "body_pct", "doji")


_L = ("SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc, lag(open, 2) OVER w AS o1, lag(close, 2) OVER w AS c1, lag(bp) OVER w AS bp1, lag(bp, 2) OVER w AS bp2, "
      "avg(close) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(high, 2) OVER w AS ph2, lag(low, 2) OVER w AS pl2 "
      f"FROM (SELECT *, CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END AS bp FROM b) {W}")


@query("candles", f"""WITH {BARS_SQL}, l AS ({_L}) {sel('symbol s, ts t, engulfing i, hammer i, star i', '''(SELECT symbol, ts,
 CASE WHEN pc < po AND close > open AND ((close >= po AND open < pc) OR (close > po AND open <= pc)) THEN 1
      WHEN pc > po AND close < open AND ((open >= pc AND close < po) OR (open > pc AND close <= po)) THEN -1 ELSE 0 END AS engulfing,
 CASE WHEN rn >= 10 AND close <> open AND least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= 0.1 * (high - low) AND pc < m THEN 1 ELSE 0 END AS hammer,
 CASE WHEN bp2 >= 0.6 AND bp1 <= 0.3 AND c1 < o1 AND greatest(po, pc) < c1 AND close > open AND close > (o1 + c1) / 2 THEN 1
      WHEN bp2 >= 0.6 AND bp1 <= 0.3 AND c1 > o1 AND least(po, pc) > c1 AND close < open AND close < (o1 + c1) / 2 THEN -1 ELSE 0 END AS star FROM l)''')}""")
def _(t):
    s = P.morning_evening_star(P.hammer(P.engulfing(bars(t, 10))))
    return show(s, "engulfing", "hammer", "star")


_IN = "greatest(open, close) < greatest(po, pc) AND least(open, close) > least(po, pc)"
_IN1 = "greatest(po, pc) < greatest(o1, c1) AND least(po, pc) > least(o1, c1)"
_OUT1 = "greatest(po, pc) > greatest(o1, c1) AND least(po, pc) < least(o1, c1)"


def _two(name, up, dn="FALSE"):
    return f"CASE WHEN {up} THEN 1 WHEN {dn} THEN -1 ELSE 0 END AS {name}"


_MORE = {
    "harami": (f"pc < po AND close > open AND {_IN}", f"pc > po AND close < open AND {_IN}"),
    "piercing": ("pc < po AND close > open AND open < pl AND close > (po + pc) / 2 AND close < po", "pc > po AND close < open AND open > ph AND close < (po + pc) / 2 AND close > po"),
    "three_line": ("close > open AND pc > po AND c1 > o1 AND close > pc AND pc > c1", "close < open AND pc < po AND c1 < o1 AND close < pc AND pc < c1"),
    "tweezer": ("pc < po AND close > open AND low = pl", "pc > po AND close < open AND high = ph"),
    "marubozu": ("bp >= 0.95 AND close > open", "bp >= 0.95 AND close < open"),
    "spinning_top": ("bp > 0.1 AND bp <= 0.3", "FALSE"),
    "kicker": ("pc < po AND close > open AND open >= po", "pc > po AND close < open AND open <= po"),
    "inside_three": (f"c1 < o1 AND pc > po AND {_IN1} AND close > open AND close > o1", f"c1 > o1 AND pc < po AND {_IN1} AND close < open AND close < o1"),
    "outside_three": (f"c1 < o1 AND pc > po AND {_OUT1} AND close > pc", f"c1 > o1 AND pc < po AND {_OUT1} AND close < pc"),
    "abandoned_baby": ("c1 < o1 AND bp1 <= 0.1 AND ph < pl2 AND close > open AND low > ph", "c1 > o1 AND bp1 <= 0.1 AND pl > ph2 AND close < open AND high < pl"),
}


@query("more_candles", f"WITH {BARS_SQL}, l AS ({_L}) {sel('symbol s, ts t, ' + ', '.join(f'{k} i' for k in _MORE), '(SELECT symbol, ts, ' + ', '.join(_two(k, *v) for k, v in _MORE.items()) + ' FROM l)')}")
def _(t):
    return show(P.more_candles(bars(t, 2)), *_MORE)


_PV = {"classic": {"P": "p", "R1": "2*p-l", "S1": "2*p-h", "R2": "p+r", "S2": "p-r"},
       "fibonacci": {"P": "p", "R1": "p+0.382*r", "S1": "p-0.382*r", "R2": "p+0.618*r", "S2": "p-0.618*r", "R3": "p+r", "S3": "p-r"},
       "camarilla": {"P": "p", **{f"{x}{i}": f"c{sg}r*1.1/{d}" for i, d in enumerate((12, 6, 4, 2), 1) for x, sg in (("R", "+"), ("S", "-"))}},
       "woodie": {"P": "(h+l+2*c)/4", "R1": "(h+l+2*c)/2-l", "S1": "(h+l+2*c)/2-h"}}
def _pivot_sql(cols):
    body = ", ".join(f"round(({e})::DOUBLE, 6) + 0.0 AS {k}" for k, e in cols.items())
    return f"""WITH {BARS_SQL}, l AS (SELECT *, (h+l+c)/3 AS p, h-l AS r FROM (SELECT symbol, ts, lag(high) OVER w AS h, lag(low) OVER w AS l, lag(close) OVER w AS c
     FROM b {W})) SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, {body} FROM l"""


for _m, _cols in _PV.items():
    @query(f"pivot_points_{_m}", _pivot_sql(_cols))
    def _(t, m=_m, cols=_cols):
        return show(P.pivot_points(bars(t, 1), m), *cols)


@query("fractals", f"""WITH {BARS_SQL}, x AS (SELECT *, max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS h1, max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS h2,
 min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l1, min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS l2, count(*) OVER (PARTITION BY symbol) AS n FROM b {W})
 {sel('symbol s, idx i, confirm_idx i, price f, kind i', '''(SELECT symbol, rn AS idx, rn + 2 AS confirm_idx, low AS price, -1 AS kind FROM x WHERE rn BETWEEN 2 AND n - 3 AND low < l1 AND low < l2
 UNION ALL SELECT symbol, rn, rn + 2, high, 1 FROM x WHERE rn BETWEEN 2 AND n - 3 AND high > h1 AND high > h2)''')}""")
def _(t):
    return P.fractals(bars(t, 2, 2), 2)


_ZZ = {"trend": ("0", "CASE WHEN {dn} THEN -1 WHEN {up} THEN 1 ELSE p.trend END"),
       "hi_i": ("0::BIGINT", "CASE WHEN {dn} THEN {hi_i} WHEN {up} THEN s.rn ELSE {hi_i} END"),
       "hi": ("s.high", "CASE WHEN {dn} THEN {hi} WHEN {up} THEN s.high ELSE {hi} END"),
       "lo_i": ("0::BIGINT", "CASE WHEN {dn} THEN s.rn ELSE {lo_i} END"),
       "lo": ("s.low", "CASE WHEN {dn} THEN s.low ELSE {lo} END"),
       "pidx": ("NULL::BIGINT", "CASE WHEN {dn} THEN {hi_i} WHEN {up} THEN {lo_i} END"),
       "price": ("NULL::DOUBLE", "CASE WHEN {dn} THEN {hi} WHEN {up} THEN {lo} END"),
       "kind": ("NULL::INT", "CASE WHEN {dn} THEN 1 WHEN {up} THEN -1 END")}


def _zz(pct: float):
    hi = "(CASE WHEN p.trend >= 0 AND s.high >= p.hi THEN s.high ELSE p.hi END)"
    hi_i = "(CASE WHEN p.trend >= 0 AND s.high >= p.hi THEN s.rn ELSE p.hi_i END)"
    lo = "(CASE WHEN p.trend <= 0 AND s.low <= p.lo THEN s.low ELSE p.lo END)"
    lo_i = "(CASE WHEN p.trend <= 0 AND s.low <= p.lo THEN s.rn ELSE p.lo_i END)"
    m = {"hi": hi, "hi_i": hi_i, "lo": lo, "lo_i": lo_i, "dn": f"(p.trend >= 0 AND s.low <= {hi} * (1 - {pct}))",
         "up": f"(p.trend <= 0 AND s.high >= {lo} * (1 + {pct}))"}
    return {k: (a, b.format(**m)) for k, (a, b) in _ZZ.items()}


PIV_SPEC = "symbol s, idx i, confirm_idx i, price f, kind i"
ZZ_SQL = walk_sql(BARS_SQL, "b", _zz(0.5), "symbol s", "").rsplit("SELECT", 1)[0]
PIVOTS = "(SELECT symbol, pidx AS idx, rn AS confirm_idx, price, kind FROM walk WHERE pidx IS NOT NULL)"


@query("zigzag", f"{ZZ_SQL} {sel(PIV_SPEC, PIVOTS)}")
def _(t):
    return P.zigzag(bars(t), 0.5)


_PW = "WINDOW w AS (PARTITION BY symbol ORDER BY confirm_idx, idx, kind)"
_DT = f"""dt AS (SELECT symbol, CASE WHEN kind = 1 THEN 'double_top' ELSE 'double_bottom' END AS pk, i1 AS first_idx, idx AS second_idx, n AS neckline, 0::DOUBLE AS slope, idx AS neck_idx,
 confirm_idx AS known_from FROM (SELECT *, lag(idx, 2) OVER w AS i1, lag(price, 2) OVER w AS p1, lag(price) OVER w AS n, lag(kind, 2) OVER w AS k1, lag(kind) OVER w AS k2 FROM pv {_PW})
 WHERE k1 = kind AND k2 = -kind AND idx - i1 >= 5 AND abs(p1 - price) <= TOL)"""
_HS = f"""hs AS (SELECT symbol, CASE WHEN k0 = 1 THEN 'head_shoulders' ELSE 'inverse_head_shoulders' END AS pk, x2 AS first_idx, idx AS second_idx, p1 AS neckline,
 (p3 - p1) / (x3 - x1) AS slope, x1 AS neck_idx, confirm_idx AS known_from FROM (SELECT *, {', '.join(f'lag({c}, {4 - i}) OVER w AS {a}{i}' for c, a in (('kind', 'k'), ('price', 'p'), ('idx', 'x')) for i in range(4))} FROM pv {_PW})
 WHERE k1 = -k0 AND k2 = k0 AND k3 = -k0 AND kind = k0 AND ((k0 = 1 AND p2 > greatest(p0, price)) OR (k0 = -1 AND p2 < least(p0, price))) AND abs(p0 - price) <= TOL)"""


@query("double_tops_bottoms", f"{ZZ_SQL.rstrip()}, pv AS {PIVOTS}, {_DT.replace('TOL', '40')} {sel('symbol s, kind s, first_idx i, second_idx i, neckline f, known_from i', '(SELECT *, pk AS kind FROM dt)')}")
def _(t):
    return P.double_tops_bottoms(P.zigzag(bars(t), 0.5), ["symbol"], 40.0, 5).drop("slope", "neck_idx")


@query("head_shoulders", f"{ZZ_SQL.rstrip()}, pv AS {PIVOTS}, {_HS.replace('TOL', '40')} {sel('symbol s, kind s, first_idx i, second_idx i, neckline f, slope f, known_from i', '(SELECT *, pk AS kind FROM hs)')}")
def _(t):
    return P.head_shoulders(P.zigzag(bars(t), 0.5), ["symbol"], 40.0).drop("neck_idx")


@query("pattern_scan", f"""{ZZ_SQL.rstrip()}, t0 AS (SELECT *, {TR} AS tr FROM b {W}), t1 AS (SELECT *, {seed('tr', 14)} AS sd0 FROM t0), {decay_sql('e', 't1', '(13.0/14)', 'tr / 14', 14, 'sd0')},
 pv AS (SELECT q.*, coalesce(0.5 * e.y, 0) AS tol FROM {PIVOTS} q LEFT JOIN e ON e.symbol = q.symbol AND e.rn = q.confirm_idx), {_DT.replace('TOL', 'tol')}, {_HS.replace('TOL', 'tol')},
 al AS (SELECT * FROM dt UNION ALL SELECT * FROM hs), hit AS (SELECT al.*, b.rn, neckline + slope * (b.rn - neck_idx) AS level, row_number() OVER (PARTITION BY al.symbol, pk, known_from, second_idx ORDER BY b.rn) AS k
 FROM al JOIN b ON b.symbol = al.symbol AND b.rn BETWEEN known_from AND known_from + 20 WHERE CASE WHEN pk IN ('double_top', 'head_shoulders') THEN close < neckline + slope * (b.rn - neck_idx)
 ELSE close > neckline + slope * (b.rn - neck_idx) END) {sel('symbol s, kind s, known_from i, signal_idx i, level f', '(SELECT *, pk AS kind, rn AS signal_idx FROM hit WHERE k = 1)')}""")
def _(t):
    return P.scan_patterns(bars(t), 0.5, 0.5)


@query("swing_low_trades", f"""{ZZ_SQL.rstrip()}, pv AS {PIVOTS}, f AS (SELECT symbol, rn, lead(open, 11) OVER w / lead(open, 1) OVER w - 1 AS fwd FROM b {W})
 {sel('symbol s, idx i, confirm_idx i, fwd f', '(SELECT pv.*, fwd FROM pv JOIN f ON f.symbol = pv.symbol AND f.rn = pv.confirm_idx WHERE kind = -1 AND fwd IS NOT NULL)')}""")
def _(t):
    return P.swing_low_trades(P.zigzag(bars(t), 0.5), bars(t, 0, 11), ["symbol"])


@query("trend_shapes", None)
def _(t):
    return P.trend_shapes(P.zigzag(bars(t), 0.5), ["symbol"], 0.05)


@query("fibonacci_levels", f"""{ZZ_SQL.rstrip()}, pv AS {PIVOTS} {sel('symbol s, idx i, known_from i, r236 f, r382 f, r500 f, r618 f, r786 f', f'''(SELECT symbol, idx, confirm_idx AS known_from,
 {', '.join(f'price - {f} * (price - p0) AS r{int(f * 1000)}' for f in (0.236, 0.382, 0.5, 0.618, 0.786))} FROM (SELECT *, lag(price) OVER w AS p0 FROM pv {_PW}) WHERE p0 IS NOT NULL)''')}""")
def _(t):
    return P.fibonacci_levels(P.zigzag(bars(t), 0.5), ["symbol"])


@query("kde_levels", f"""{ZZ_SQL.rstrip()}, pv AS {PIVOTS}, sp AS (SELECT symbol, min(price) - 30 AS lo, max(price) + 30 AS hi FROM pv GROUP BY symbol),
 g AS (SELECT sp.symbol, k, lo + (hi - lo) * k / 511 AS x FROM sp, range(512) r(k)), d AS (SELECT g.symbol, k, x, sum(exp(-0.5 * pow((x - price) / 10, 2))) AS d FROM g JOIN pv USING (symbol) GROUP BY ALL),
 pk AS (SELECT *, lag(d) OVER w AS a, lead(d) OVER w AS z FROM d WINDOW w AS (PARTITION BY symbol ORDER BY k)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC, k) AS rank FROM pk WHERE d > a AND d > z) {sel('symbol s, rank i, level f, density f', '(SELECT symbol, rank, x AS level, d AS density FROM rk WHERE rank <= 3)')}""")
def _(t):
    return P.kde_levels(P.zigzag(bars(t), 0.5), ["symbol"], "price", 10.0, 3, 512)


_ST = f"""{BARS_SQL}, t0 AS (SELECT *, {TR} AS tr FROM b {W}), t1 AS (SELECT *, {seed('tr', 10)} AS sd0 FROM t0), {decay_sql('e', 't1', '0.9', 'tr / 10', 10, 'sd0')},
 a AS (SELECT b.*, (high + low) / 2 + 3 * e.y AS ub, (high + low) / 2 - 3 * e.y AS lb FROM b LEFT JOIN e USING (symbol, rn))"""


@query("supertrend", walk_sql(_ST, "a", {
    "fu": ("NULL::DOUBLE", "CASE WHEN s.rn <= 10 THEN s.ub WHEN s.ub < p.fu OR p.pc > p.fu THEN s.ub ELSE p.fu END"),
    "fl": ("NULL::DOUBLE", "CASE WHEN s.rn <= 10 THEN s.lb WHEN s.lb > p.fl OR p.pc < p.fl THEN s.lb ELSE p.fl END"),
    "pc": ("s.close", "s.close"),
    "d": ("0", "CASE WHEN s.rn <= 10 THEN 0 WHEN s.close > p.fu THEN 1 WHEN s.close < p.fl THEN -1 WHEN p.d <> 0 THEN p.d ELSE 1 END")},
    "symbol s, ts t, st_line f, st_dir f").replace("FROM walk", "FROM (SELECT *, CASE WHEN rn > 10 THEN CASE WHEN d = 1 THEN fl ELSE fu END END AS st_line, d AS st_dir FROM walk) x")
    .replace("FROM (SELECT *, CASE WHEN rn > 10 THEN CASE WHEN d = 1 THEN fl ELSE fu END END AS st_line, d AS st_dir FROM walk) x p JOIN", "FROM walk p JOIN"))
def _(t):
    return show(P.supertrend(bars(t, 1)), "st_line", "st_dir")


_STEP = "(p.sar + p.af * (p.ep - p.sar))"
_LINE = f"(CASE WHEN p.d > 0 THEN least({_STEP}, p.pl, p.ppl) ELSE greatest({_STEP}, p.ph, p.pph) END)"
_FLIP = f"((p.d > 0 AND s.low < {_LINE}) OR (p.d < 0 AND s.high > {_LINE}))"
_FURTHER = "((p.d > 0 AND s.high > p.ep) OR (p.d < 0 AND s.low < p.ep))"
_SAR = f"CASE WHEN {_FLIP} THEN p.ep ELSE {_LINE} END"


@query("parabolic_sar", walk_sql(BARS_SQL, "b", {
    "d": ("1", f"CASE WHEN {_FLIP} THEN -p.d ELSE p.d END"), "sar": ("s.low", _SAR), "psar": ("NULL::DOUBLE", _SAR),
    "ep": ("s.high", f"CASE WHEN {_FLIP} = (p.d > 0) THEN CASE WHEN {_FLIP} OR s.low < p.ep THEN s.low ELSE p.ep END ELSE CASE WHEN {_FLIP} OR s.high > p.ep THEN s.high ELSE p.ep END END"),
    "af": ("0.02::DOUBLE", f"CASE WHEN {_FLIP} THEN 0.02 WHEN {_FURTHER} THEN least(p.af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE p.af END"),
    "ph": ("s.high", "s.high"), "pl": ("s.low", "s.low"), "pph": ("s.high", "p.ph"), "ppl": ("s.low", "p.pl")}, "symbol s, ts t, psar f"))
def _(t):
    return show(P.parabolic_sar(bars(t)), "psar")


@query("cusum_events", walk_sql(f"{BARS_SQL}, r AS (SELECT *, ln(close / lag(close) OVER w) AS r FROM b {W})", "r", {
    "up": ("0::DOUBLE", "CASE WHEN greatest(0, p.up + s.r) > 2 THEN 0 ELSE greatest(0, p.up + s.r) END"),
    "dn": ("0::DOUBLE", "CASE WHEN greatest(0, p.up + s.r) <= 2 AND least(0, p.dn + s.r) < -2 THEN 0 ELSE least(0, p.dn + s.r) END"),
    "event": ("FALSE", "greatest(0, p.up + s.r) > 2 OR least(0, p.dn + s.r) < -2")}, "symbol s, ts t, event b"))
def _(t):
    return show(P.cusum_events(bars(t, 1), 2.0), "event")


@query("cusum_alarm", walk_sql(BARS_SQL, "b", {
    "u": ("greatest(0, (s.close - 250) / 120 - 0.5)", "CASE WHEN greatest(0, p.u + (s.close - 250) / 120 - 0.5) > 5 OR greatest(0, p.v - (s.close - 250) / 120 - 0.5) > 5 THEN 0 ELSE greatest(0, p.u + (s.close - 250) / 120 - 0.5) END"),
    "v": ("greatest(0, -(s.close - 250) / 120 - 0.5)", "CASE WHEN greatest(0, p.u + (s.close - 250) / 120 - 0.5) > 5 OR greatest(0, p.v - (s.close - 250) / 120 - 0.5) > 5 THEN 0 ELSE greatest(0, p.v - (s.close - 250) / 120 - 0.5) END"),
    "alarm": ("FALSE", "greatest(0, p.u + (s.close - 250) / 120 - 0.5) > 5 OR greatest(0, p.v - (s.close - 250) / 120 - 0.5) > 5")}, "symbol s, ts t, alarm b"))
def _(t):
    return show(P.cusum_alarm(bars(t), "close", 250.0, 120.0), "alarm")


@query("robust_z", f"""WITH {BARS_SQL}, m AS (SELECT a.symbol, a.ts, a.rn, a.close, median(q.close) AS md, count(*) AS n FROM b a JOIN b q ON q.symbol = a.symbol AND q.rn BETWEEN a.rn - 100 AND a.rn - 1 GROUP BY ALL),
 d AS (SELECT m.symbol, m.ts, m.close, md, n, median(abs(q.close - md)) AS mad FROM m JOIN b q ON q.symbol = m.symbol AND q.rn BETWEEN m.rn - 100 AND m.rn - 1 GROUP BY ALL)
 {sel('symbol s, ts t, z f, z_flag b', f'''(SELECT symbol, ts, z, abs(z) > 2 AS z_flag FROM (SELECT b.symbol, b.ts, CASE WHEN n >= 50 THEN (d.close - md) / (mad * 1.4826 + 1e-12) ELSE 0 END AS z
 FROM b LEFT JOIN d USING (symbol, ts)))''')}""")
def _(t):
    return show(P.robust_z(bars(t, 100), "close", 100, 50, 2.0), "z", "z_flag")


# ---------------------------------------------------------------- actions
@query("crossings", f"""WITH {BARS_SQL}, m AS (SELECT *, {gate('avg(close) @', 5)} AS f, {gate('avg(close) @', 20)} AS s FROM b {W})
 {sel('symbol s, ts t, up b, down b, level b', f'''(SELECT symbol, ts, coalesce(f > s AND lag(f) OVER w <= lag(s) OVER w, FALSE) AS up, coalesce(f < s AND lag(f) OVER w >= lag(s) OVER w, FALSE) AS down,
 coalesce(f > 250 AND lag(f) OVER w <= 250, FALSE) AS level FROM m {W})''')}""")
def _(t):
    s = I.sma(I.sma(bars(t, 20), n=5, out="f"), n=20, out="sl")
    s = P.crossover(P.crossunder(P.crossover(s, "f", "sl", "up"), "f", "sl", "down"), "f", 250.0, "level")
    return show(s, "up", "down", "level")


_ACT = {"gap_up": "open > lag(high) OVER w", "gap_down": "open < lag(low) OVER w", "inside_bar": "high < lag(high) OVER w AND low > lag(low) OVER w",
        "outside_bar": "high > lag(high) OVER w AND low < lag(low) OVER w", "narrow": "rn >= 6 AND high - low < min(high - low) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)",
        "new_high": "rn >= 20 AND close > max(close) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", "new_low": "rn >= 20 AND close < min(close) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
        "rising": "close > lag(close) OVER w AND lag(close) OVER w > lag(close, 2) OVER w", "falling": "close < lag(close) OVER w AND lag(close) OVER w < lag(close, 2) OVER w"}


@query("bar_actions", win(", ".join(f"coalesce({e}, FALSE) AS {k}" for k, e in _ACT.items()), ", ".join(f"{k} b" for k in _ACT)))
def _(t):
    return show(P.bar_actions(bars(t, 20)), *_ACT)


@query("runs", f"""WITH {BARS_SQL}, c AS (SELECT *, close > open AS up FROM b), g AS (SELECT *, max(CASE WHEN NOT up THEN rn END) OVER w AS lf, max(CASE WHEN up THEN rn END) OVER w AS lt FROM c {W})
 {sel('symbol s, ts t, run i, since i', '(SELECT symbol, ts, rn - coalesce(lf, -1) AS run, rn - lt AS since FROM g)')}""")
def _(t):
    s = bars(t).add(up=F.col("close") > F.col("open"))
    return show(P.bars_since(P.consecutive(s, "up"), "up"), "run", "since")


@query("gap_filled", f"""WITH {BARS_SQL}, g AS (SELECT *, CASE WHEN open > lag(high) OVER w THEN lag(high) OVER w END AS lvl FROM b {W}),
 h AS (SELECT *, max(CASE WHEN lvl IS NOT NULL THEN rn END) OVER w AS gat FROM g {W}), k AS (SELECT *, max(lvl) OVER (PARTITION BY symbol, gat) AS lv FROM h)
 {sel('symbol s, ts t, gap_filled b', '(SELECT symbol, ts, coalesce(max(CASE WHEN low <= lv THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, gat ORDER BY ts) = 1 AND gat IS NOT NULL, FALSE) AS gap_filled FROM k)')}""")
def _(t):
    return show(P.gap_filled(bars(t, 1)), "gap_filled")


@query("condition_composition", f"""WITH {BARS_SQL}, c AS (SELECT *, close > open AS a, volume > 4 AS v FROM b), d AS (SELECT *, max(a::INT) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS aw,
 sum(v::INT) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS vc FROM c {W}) {sel('symbol s, ts t, signal b', '(SELECT symbol, ts, (aw AND vc) OR NOT a AS signal FROM d)')}""")
def _(t):
    up, busy = Condition.of(F.col("close") > F.col("open"), "up"), Condition.of(F.col("volume") > 4, "busy")
    rule = (up.within(3) & busy.confirm(2)) | ~up
    return show(rule.apply(bars(t, 2)), "signal")


@query("condition_tree", f"""WITH {BARS_SQL}, m AS (SELECT *, {gate('avg(close) @', 5)} AS f, {gate('avg(close) @', 20)} AS s FROM b {W}), {decay_sql('e', 'b', '(1 - 2.0/11)', '2.0/11 * close', 0, 'close')}
 {sel('symbol s, ts t, signal b', f'''(SELECT m.symbol, m.ts, (coalesce(f > s AND lag(f) OVER w <= lag(s) OVER w, FALSE) OR close > 400) AND NOT coalesce(e.y < 200, FALSE) AS signal
 FROM m LEFT JOIN e USING (symbol, rn) WINDOW w AS (PARTITION BY m.symbol ORDER BY m.ts))''')}""")
def _(t):
    rule = build_condition({"all": [
        {"any": [{"fn": "crossover", "args": [{"ind": "sma", "params": {"n": 5}}, {"ind": "sma", "params": {"n": 20}}]},
                 {"fn": "gt", "args": ["close", 400]}]},
        {"not": {"fn": "lt", "args": [{"ind": "ema", "params": {"n": 10}}, 200]}}]})
    return show(rule.apply(bars(t, 20)), "signal")
