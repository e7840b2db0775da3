"""Statistics, tests, trades, bootstraps, folds and overfitting checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import patterns as PT
from ..operators import resample as R
from ..operators import stats as S
from ..operators import strategies as P
from ..operators import bars as B
from ..series import RN, Series, SeriesSpec, kept
from .base import BARS_SPEC, BARS_SQL, ORACLES, PANEL_SPEC, PANEL_SQL, TRADES_SQL, query, sel
from .indicator_queries import W, bars, gate

C = F.col
# small returns: the daily move of the bar, scaled so that compounding stays finite
_RET = f"r AS (SELECT *, ln(close / open) * 0.01 AS ret, ln(high / low) * 0.01 AS mkt FROM b)"


def rets(t, back=0, ahead=0):
    return Series.of(_ret_df(t), BARS_SPEC, back, ahead)


def _ret_df(t):
    return t.bars().withColumns({"ret": F.log(C("close") / C("open")) * 0.01, "mkt": F.log(C("high") / C("low")) * 0.01})


def agg(expr: str, spec: str, src: str = "r", more: str = "") -> str:
    return f"WITH {BARS_SQL}, {_RET}{more} {sel('symbol s, ' + spec, f'(SELECT symbol, {expr} FROM {src} GROUP BY symbol)')}"


_SK = "avg(pow(ret - m, 3)) / pow(var_pop(ret), 1.5)"
_KU = "(avg(pow(ret - m, 4)) / pow(var_pop(ret), 2) - 3)"
_M = ", rm AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS m FROM r)"


@query("describe", agg(f"count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, {_SK} AS skew, {_KU} AS kurtosis, count(ret) / 6.0 * (pow({_SK}, 2) + pow({_KU}, 2) / 4) AS jb, exp(-count(ret) / 12.0 * (pow({_SK}, 2) + pow({_KU}, 2) / 4)) AS jb_p",
                       "n i, mean f, std f, skew f, kurtosis f, jb f, jb_p f", "rm", _M))
def _(t):
    return S.describe(_ret_df(t), ["symbol"])


@query("tail_count", f"WITH {BARS_SQL}, {_RET}, m AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s FROM r GROUP BY 1) {sel('symbol s, beyond i', '(SELECT symbol, count(*) FILTER (WHERE abs(ret - m) > 2 * s) AS beyond FROM r JOIN m USING (symbol) GROUP BY 1)')}")
def _(t):
    return S.tail_count(_ret_df(t), ["symbol"], k=2.0).drop("expected")


@query("autocorr", f"WITH {BARS_SQL}, {_RET}, l AS (SELECT *, lag(ret) OVER w AS p FROM r {W}) {sel('symbol s, autocorr f', '(SELECT symbol, corr(ret, p) AS autocorr FROM l GROUP BY 1)')}")
def _(t):
    return S.autocorr(rets(t, 1), "ret")


@query("mean_tstat", agg("avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t_stat, pow(2.0 / (avg(ret) / stddev_samp(ret) * sqrt(252)), 2) AS years", "t_stat f, years f"))
def _(t):
    import math
    y = _ret_df(t).groupBy("symbol").agg(S.years_needed(F.avg("ret") / F.stddev_samp("ret") * math.sqrt(252)).alias("years"))
    return S.mean_tstat(_ret_df(t), ["symbol"]).join(y, "symbol")


@query("variance_ratio", f"WITH {BARS_SQL}, l AS (SELECT symbol, ln(close) - lag(ln(close), 5) OVER w AS q, ln(close) - lag(ln(close)) OVER w AS d FROM b {W}) {sel('symbol s, variance_ratio f', '(SELECT symbol, var_samp(q) / (5 * var_samp(d)) AS variance_ratio FROM l GROUP BY 1)')}")
def _(t):
    return S.variance_ratio(bars(t, 5).add(lc=F.log("close")), "lc")


_OU = "avg(y) - regr_slope(y, x) * avg(x)"


@query("fit_ou", f"""WITH {BARS_SQL}, m AS (SELECT *, avg(close) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v FROM b {W}), l AS (SELECT symbol, v AS y, lag(v) OVER w AS x FROM m {W}), z AS (SELECT * FROM l WHERE x IS NOT NULL),
 g AS (SELECT symbol, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS ssr, count(*) AS n FROM z GROUP BY 1)
 {sel('symbol s, theta f, mu f, sigma f, half_life f', '(SELECT symbol, -ln(b) AS theta, a / (1 - b) AS mu, sqrt(ssr / (n - 2)) * sqrt(2 * -ln(b) / (1 - b * b)) AS sigma, ln(2) / -ln(b) AS half_life FROM g)')}""")
def _(t):
    s = bars(t, 9)
    s = s.add(v=F.avg("close").over(s.rows(-9)), back=9, uses=["close"])
    return S.fit_ou(s, "v")


@query("hurst", f"""WITH {BARS_SQL}, l AS (SELECT a.symbol, k, stddev_pop(ln(a.close) - ln(p.close)) AS sd FROM b a CROSS JOIN range(2, 21) r(k) JOIN b p ON p.symbol = a.symbol AND p.rn = a.rn - k GROUP BY 1, 2)
 {sel('symbol s, hurst f', '(SELECT symbol, regr_slope(ln(sd), ln(k)) AS hurst FROM l GROUP BY 1)')}""")
def _(t):
    return S.hurst(bars(t, 20).add(lc=F.log("close")), "lc", range(2, 21))


@query("regression", f"""WITH {BARS_SQL}, {_RET} {sel('symbol s, n i, alpha f, beta f, ssr f', '(SELECT symbol, count(*) AS n, regr_intercept(ret, mkt) AS alpha, regr_slope(ret, mkt) AS beta, regr_syy(ret, mkt) - regr_slope(ret, mkt) * regr_sxy(ret, mkt) AS ssr FROM r GROUP BY 1)')}""")
def _(t):
    r = S.regress(_ret_df(t), ["symbol"], C("ret"), [F.lit(1.0), C("mkt")])
    return r.select("symbol", "n", C("coef")[0].alias("alpha"), C("coef")[1].alias("beta"), "ssr")


@query("adf_kpss", None)
def _(t):
    s = bars(t, 2).add(lc=F.log("close"))
    return S.adf(s, "lc").join(S.kpss(s, "lc", 5).select("symbol", C("stat").alias("kpss"), C("p_value").alias("kpss_p")), "symbol")


@query("min_frac_diff", None)
def _(t):
    """ADF p-value and correlation with the original per difference order; the smallest order below 5 % per symbol."""
    return S.min_frac_diff(t.bars().withColumn("lc", F.log("close")), BARS_SPEC.with_(block_rows=1 << 14), "lc")


@query("engle_granger", None)
def _(t):
    d = t.bars().select("symbol", "ts", F.log("close").alias("y"), F.log("open").alias("x"))
    return S.engle_granger(d, BARS_SPEC)


@query("hist_var_cvar", agg("max(v) AS var, avg(-ret) FILTER (WHERE -ret >= v) AS cvar", "var f, cvar f", "(SELECT r.*, v FROM r JOIN (SELECT symbol, quantile_cont(-ret, 0.99) AS v FROM r GROUP BY 1) USING (symbol))"))
def _(t):
    return S.hist_var_cvar(_ret_df(t), ["symbol"])


@query("var_by_method", agg(f"quantile_cont(-ret, 0.99) AS historical, -(avg(ret) + (-2.3263478740408408) * stddev_samp(ret)) AS normal, -(avg(ret) + (-2.3263478740408408 + (5.4118944310 - 1) * {_SK} / 6 + (-12.5899483 + 6.9790436) * {_KU} / 24 - (-25.1798966 + 11.6317394) * pow({_SK}, 2) / 36) * stddev_samp(ret)) AS cf0",
                            "historical f, normal f", "rm", _M))
def _(t):
    return S.var_by_method(_ret_df(t), ["symbol"]).select("symbol", "historical", "normal")


_EQ = f"""e AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS eq FROM r {W}), f AS (SELECT *, greatest(max(eq) OVER w, 1) AS pk FROM e {W}), g AS (SELECT *, eq / pk - 1 AS dd, avg(ret) OVER (PARTITION BY symbol) AS m FROM f),
 h AS (SELECT *, rn - coalesce(max(CASE WHEN dd >= 0 THEN rn END) OVER w, -1) AS run FROM g {W})"""


@query("tear_sheet", f"""WITH {BARS_SQL}, {_RET}, {_EQ} {sel('symbol s, cagr f, vol f, sharpe f, sortino f, max_dd f, dd_duration i, skew f, kurtosis f, calmar f, tail_ratio f', f'''(SELECT *, cagr / abs(max_dd) AS calmar FROM (SELECT symbol, pow(arg_max(eq, ts), 252.0 / count(*)) - 1 AS cagr,
 stddev_samp(ret) * sqrt(252) AS vol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252) AS sortino, min(dd) AS max_dd, max(CASE WHEN dd < 0 THEN run ELSE 0 END) AS dd_duration,
 {_SK} AS skew, {_KU} AS kurtosis, quantile_cont(ret, 0.95) / abs(quantile_cont(ret, 0.05)) AS tail_ratio FROM h GROUP BY symbol))''')}""")
def _(t):
    return S.tear_sheet(rets(t))


@query("benchmark_stats", agg("covar_samp(ret, mkt) / var_samp(mkt) AS beta, (avg(ret) - covar_samp(ret, mkt) / var_samp(mkt) * avg(mkt)) * 252 AS alpha, avg(ret - mkt) / stddev_samp(ret - mkt) * sqrt(252) AS ir, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252) AS sortino", "beta f, alpha f, ir f, sharpe f, sortino f"))
def _(t):
    return S.benchmark_stats(_ret_df(t), ["symbol"], bench="mkt")


@query("regime_vols", agg("stddev_samp(ret) FILTER (WHERE NOT mkt > 0.01) * sqrt(252) AS calm_vol, stddev_samp(ret) FILTER (WHERE mkt > 0.01) * sqrt(252) AS stress_vol, avg((mkt + 0.001) / (abs(ret) + 0.01) - ln((mkt + 0.001) / (abs(ret) + 0.01)) - 1) AS qlike", "calm_vol f, stress_vol f, qlike f"))
def _(t):
    d = _ret_df(t)
    q = d.groupBy("symbol").agg(S.qlike(C("mkt") + 0.001, F.abs("ret") + 0.01).alias("qlike"))
    return S.regime_vols(d, ["symbol"], prob="mkt", threshold=0.01).join(q, "symbol")


_TRD = f"""p AS (SELECT *, CASE WHEN volume >= 4 THEN sign(close - open) ELSE 0 END AS ps FROM b), q AS (SELECT *, coalesce(lag(ps) OVER w, 0) AS pq, lead(open) OVER w AS no, lead(rn) OVER w AS ni FROM p {W}),
 c AS (SELECT *, count(*) FILTER (WHERE ps <> pq AND rn > 0) OVER w AS id FROM q {W}), g AS (SELECT symbol, id, any_value(ps) AS d, bool_or(ps <> 0 AND ps <> pq AND rn > 0) AS ok, arg_min(no, rn) AS en, arg_min(ni, rn) AS ei FROM c GROUP BY 1, 2),
 h AS (SELECT *, lead(ei) OVER v AS xi, lead(en) OVER v AS xp FROM g WINDOW v AS (PARTITION BY symbol ORDER BY id)),
 t AS (SELECT h.symbol, ei AS entry_i, xi AS exit_i, d::INT AS direction, d * (xp / en - 1) AS ret, max(b.high) AS hi, min(b.low) AS lo, en FROM h JOIN b ON b.symbol = h.symbol AND b.rn BETWEEN ei AND xi - 1 WHERE ok AND xi IS NOT NULL GROUP BY ALL)"""


def _trades(t):
    s = bars(t, 1, 1).add(pos=F.when(C("volume") >= 4, F.signum(C("close") - C("open"))).otherwise(0.0))
    return S.trades_from_positions(s)


@query("trades_from_positions", f"""WITH {BARS_SQL}, {_TRD} {sel('symbol s, entry_i i, exit_i i, direction i, ret f, mae f, mfe f', '''(SELECT *, least(CASE WHEN direction > 0 THEN lo / en - 1 ELSE 1 - hi / en END, 0) AS mae, greatest(CASE WHEN direction > 0 THEN hi / en - 1 ELSE 1 - lo / en END, 0) AS mfe FROM t)''')}""")
def _(t):
    return _trades(t)


@query("trade_stats", f"""WITH {BARS_SQL}, {_TRD}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_i) AS n FROM t), l AS (SELECT *, n - coalesce(max(CASE WHEN ret >= 0 THEN n END) OVER (PARTITION BY symbol ORDER BY n), 0) AS run FROM k)
 {sel('symbol s, win_rate f, payoff f, expectancy f, profit_factor f, max_consecutive_losses i', '''(SELECT symbol, avg((ret > 0)::INT) AS win_rate, avg(ret) FILTER (WHERE ret > 0) / abs(avg(ret) FILTER (WHERE ret < 0)) AS payoff, avg(ret) AS expectancy,
 sum(ret) FILTER (WHERE ret > 0) / abs(sum(ret) FILTER (WHERE ret < 0)) AS profit_factor, max(run) AS max_consecutive_losses FROM l GROUP BY 1)''')}""")
def _(t):
    return S.trade_stats(_trades(t), SeriesSpec(("symbol",), ("entry_i",), "entry_i div 100000"))


@query("sharpe_significance", agg("avg(ret) / stddev_samp(ret) AS sr, sqrt((1 + 0.5 * pow(avg(ret) / stddev_samp(ret), 2)) / count(*)) AS se", "sr f, se f"))
def _(t):
    m = S.sharpe_moments(_ret_df(t), ["symbol"])
    return m.select("symbol", "sr", S.sharpe_se(C("sr"), C("T")).alias("se"))


@query("psr_deflated", None)
def _(t):
    m = S.sharpe_moments(_ret_df(t), ["symbol"])
    sr0 = S.expected_max_sharpe(m, [])
    d = m.crossJoin(F.broadcast(sr0))
    return d.select("symbol", S.psr().alias("psr"), S.psr(C("sr0")).alias("dsr"), "sr0", S.min_track_record(-0.1).alias("min_track"))


@query("kupiec", agg("count(*) FILTER (WHERE ret < -0.02)::DOUBLE AS x, count(*)::DOUBLE AS n, -2 * ((count(*) - count(*) FILTER (WHERE ret < -0.02)) * ln(0.95) + count(*) FILTER (WHERE ret < -0.02) * ln(0.05)) + 2 * ((count(*) - count(*) FILTER (WHERE ret < -0.02)) * ln(1 - count(*) FILTER (WHERE ret < -0.02) / count(*)::DOUBLE) + count(*) FILTER (WHERE ret < -0.02) * ln(count(*) FILTER (WHERE ret < -0.02) / count(*)::DOUBLE)) AS lr", "x f, n f, lr f"))
def _(t):
    return S.kupiec(_ret_df(t).withColumn("ex", C("ret") < -0.02), ["symbol"], "ex", 0.05).drop("p_value")


@query("bh_adjust", """WITH p AS (SELECT doc_id AS id, (n_chars % 1009) / 1009.0::DOUBLE + 1e-6 AS p_value FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY p_value, id) AS rk, count(*) OVER () AS m FROM p), q AS (SELECT *, least(min(p_value * m / rk) OVER (ORDER BY rk DESC), 1) AS q_value FROM r) """
       + sel("id i, p_value f, q_value f, discovery b", "(SELECT *, q_value <= 0.9 AS discovery FROM q)"))
def _(t):
    d = t.documents.select(C("doc_id").alias("id"), ((C("n_chars") % 1009) / 1009.0 + 1e-6).alias("p_value"))
    return S.bh(d, alpha=0.9)


@query("hill", f"WITH {BARS_SQL}, {_RET}, k AS (SELECT symbol, -ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY -ret DESC) AS rn FROM r WHERE ret < 0) {sel('symbol s, xi f', '(SELECT symbol, avg(ln(x)) FILTER (WHERE rn <= 50) - max(ln(x)) FILTER (WHERE rn = 51) AS xi FROM k GROUP BY 1)')}")
def _(t):
    return S.hill(_ret_df(t), ["symbol"], k=50)


@query("evt_var_es", None)
def _(t):
    return S.evt_var_es(_ret_df(t), ["symbol"])


@query("newey_west", f"""WITH {BARS_SQL}, {_RET}, d AS (SELECT symbol, rn, ret - avg(ret) OVER (PARTITION BY symbol) AS d, ret FROM r), l AS (SELECT symbol, d, ret, lag(d, 1) OVER v AS d1, lag(d, 2) OVER v AS d2, lag(d, 3) OVER v AS d3 FROM d WINDOW v AS (PARTITION BY symbol ORDER BY rn))
 {sel('symbol s, mean f, se f, t_stat f', '(SELECT *, mean / se AS t_stat FROM (SELECT symbol, avg(ret) AS mean, sqrt(sum(d * d) + 2 * 0.75 * sum(d * d1) + 2 * 0.5 * sum(d * d2) + 2 * 0.25 * sum(d * d3)) / count(*) AS se FROM l GROUP BY 1))')}""")
def _(t):
    return S.newey_west(rets(t), "ret", 3)


@query("hac_regression", None)
def _(t):
    return S.hac_regression(rets(t), "ret", "mkt", 5)


@query("chow_test", f"""WITH {BARS_SQL}, {_RET}, s AS (SELECT *, rn >= 800 AS sg FROM r), p AS (SELECT symbol, count(*) AS n, regr_syy(ret, mkt) - regr_slope(ret, mkt) * regr_sxy(ret, mkt) AS s FROM s GROUP BY 1),
 q AS (SELECT symbol, sum(s) AS s12 FROM (SELECT symbol, sg, regr_syy(ret, mkt) - regr_slope(ret, mkt) * regr_sxy(ret, mkt) AS s FROM s GROUP BY 1, 2) GROUP BY 1) {sel('symbol s, f_stat f', '(SELECT symbol, ((s - s12) / 2) / (s12 / (n - 4)) AS f_stat FROM p JOIN q USING (symbol))')}""")
def _(t):
    d = rets(t).df
    return S.chow_test(d, ["symbol"], "ret", "mkt", C(RN) >= 800).drop("p_value")


@query("cusum_residuals", None)
def _(t):
    return S.cusum_residuals(rets(t), "ret", "mkt")


@query("normal_posterior", agg("(count(*) * avg(ret) / var_samp(ret)) / (1 / (0.001 * 0.001) + count(*) / var_samp(ret)) AS post_mean, sqrt(1 / (1 / (0.001 * 0.001) + count(*) / var_samp(ret))) AS post_sd", "post_mean f, post_sd f"))
def _(t):
    return S.normal_posterior(_ret_df(t), ["symbol"])


@query("capacity", f"""WITH {BARS_SQL}, {_RET}, m AS (SELECT symbol, avg(abs(ret)) AS m, stddev_samp(abs(ret)) AS s FROM r GROUP BY 1) {sel('symbol s, capital f, net_sharpe f', '(SELECT symbol, c AS capital, (m - 0.1 * 0.02 * sqrt(0.1 * c / 1e8)) / s * sqrt(252) AS net_sharpe FROM m CROSS JOIN (VALUES (1e5), (1e7), (1e9)) v(c))')}""")
def _(t):
    d = _ret_df(t).withColumn("ret", F.abs("ret"))
    return S.net_sharpe_by_capital(d, ["symbol"], [1e5, 1e7, 1e9], 0.1, 1e8, 0.02)


_HALF = "h AS (SELECT *, 2 * rn < count(*) OVER (PARTITION BY symbol) AS ex FROM r)"


def _halves(t):
    """Returns with a mark for the first half of each symbol's rows."""
    d = rets(t).df.select("symbol", "ret", RN)
    n = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    return d.join(n, "symbol").select("symbol", "ret", (2 * C(RN) < C("_n")).alias("first"))


@query("psi", f"""WITH {BARS_SQL}, {_RET}, {_HALF}, e AS (SELECT symbol, {', '.join(f'quantile_cont(ret, {i / 10}) AS q{i}' for i in range(1, 10))} FROM h WHERE ex GROUP BY 1),
 x AS (SELECT symbol, ex, {' + '.join(f'(ret >= q{i})::INT' for i in range(1, 10))} AS bk FROM h JOIN e USING (symbol)), c AS (SELECT symbol, bk, count(*) FILTER (WHERE ex) / sum(count(*) FILTER (WHERE ex)) OVER (PARTITION BY symbol) + 1e-6 AS e,
 count(*) FILTER (WHERE NOT ex) / sum(count(*) FILTER (WHERE NOT ex)) OVER (PARTITION BY symbol) + 1e-6 AS a FROM x GROUP BY 1, 2) {sel('symbol s, psi f', '(SELECT symbol, sum((a - e) * ln(a / e)) AS psi FROM c GROUP BY 1)')}""")
def _(t):
    d = _halves(t)
    return S.psi(d.where("first"), d.where("not first"), "ret", ["symbol"])


@query("ks_two_sample", f"""WITH {BARS_SQL}, {_RET}, {_HALF}, c AS (SELECT symbol, ret, count(*) FILTER (WHERE ex) AS a, count(*) FILTER (WHERE NOT ex) AS z FROM h GROUP BY 1, 2), k AS (SELECT symbol, abs(sum(a) OVER v / sum(a) OVER (PARTITION BY symbol) - sum(z) OVER v / sum(z) OVER (PARTITION BY symbol)) AS d FROM c WINDOW v AS (PARTITION BY symbol ORDER BY ret))
 {sel('symbol s, ks f', '(SELECT symbol, max(d) AS ks FROM k GROUP BY 1)')}""")
def _(t):
    return S.ks_two_sample(_halves(t), ["symbol"], "ret", "first").drop("p_value")


@query("rank_ic", f"""WITH {PANEL_SQL}, x AS (SELECT month, close, n, rank() OVER (PARTITION BY month ORDER BY close) + (count(*) OVER (PARTITION BY month, close) - 1) / 2.0 AS a, rank() OVER (PARTITION BY month ORDER BY n) + (count(*) OVER (PARTITION BY month, n) - 1) / 2.0 AS z FROM panel)
 {sel('month d, ic f, n i', '(SELECT month, corr(a, z) AS ic, count(*) AS n FROM x GROUP BY 1)')}""")
def _(t):
    return S.rank_ic(t.panel(), ["month"], "close", "n")


@query("cross_sectional_rank", f"WITH {PANEL_SQL} {sel('symbol s, month d, rank f', '(SELECT symbol, month, (rank() OVER (PARTITION BY month ORDER BY n) + (count(*) OVER (PARTITION BY month, n) - 1) / 2.0) / count(*) OVER (PARTITION BY month) AS rank FROM panel)')}")
def _(t):
    return P.cross_sectional_rank(t.panel(), "n", "month").select("symbol", "month", "rank")


@query("cross_sectional_momentum", f"""WITH {PANEL_SQL}, m AS (SELECT symbol, month, lag(close) OVER w / lag(close, 12) OVER w - 1 AS mom FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY month)), k AS (SELECT *, CASE WHEN mom IS NOT NULL THEN (rank() OVER (PARTITION BY month ORDER BY mom NULLS LAST) + (count(*) OVER (PARTITION BY month, mom) - 1) / 2.0) / count(mom) OVER (PARTITION BY month) END AS rk FROM m),
 f AS (SELECT *, coalesce(rk > 1 - 0.2 + 1e-12, FALSE)::INT AS i FROM k) {sel('symbol s, month d, weight f', '(SELECT symbol, month, coalesce(i / nullif(sum(i) OVER (PARTITION BY month), 0), 0) AS weight FROM f)')}""")
def _(t):
    return P.cross_sectional_momentum(Series.of(t.panel(), PANEL_SPEC, 12), top_q=0.2, date="month").select("symbol", "month", "weight")


@query("dual_momentum", f"""WITH {PANEL_SQL}, m AS (SELECT symbol, month, close / lag(close, 12) OVER w - 1 AS r FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY month)), g AS (SELECT month, arg_max(symbol, r) FILTER (WHERE symbol <> 'NATION_0') AS bs, max(r) FILTER (WHERE symbol <> 'NATION_0') AS br, max(r) FILTER (WHERE symbol = 'NATION_0') AS cr FROM m GROUP BY 1)
 {sel('month d, pick s', "(SELECT month, CASE WHEN cr IS NOT NULL THEN CASE WHEN br > cr THEN bs ELSE 'NATION_0' END END AS pick FROM g)")}""")
def _(t):
    return P.dual_momentum(Series.of(t.panel(), PANEL_SPEC, 12), "NATION_0", 12, date="month")


@query("monthly_winners", f"""WITH {PANEL_SQL}, m AS (SELECT symbol, month, close / lag(close) OVER w - 1 AS ret FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY month)), x AS (SELECT *, lead(ret) OVER (PARTITION BY symbol ORDER BY month) AS nx, CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY month ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY month, ret) - 1) / 2.0) / count(ret) OVER (PARTITION BY month) END AS rk FROM m)
 {sel('month d, winners f, equal_weight f', '(SELECT month, avg(nx) FILTER (WHERE rk > 1 - 0.2 + 1e-12) AS winners, avg(nx) AS equal_weight FROM x WHERE nx IS NOT NULL GROUP BY 1)')}""")
def _(t):
    s = I.simple_returns(Series.of(t.panel(), PANEL_SPEC, 1))
    return P.monthly_winners(s.done(), "ret")


@query("average_precision", """WITH s AS (SELECT (n_chars % 500) / 500.0 AS p, quality AS y FROM labels JOIN documents USING (doc_id)), c AS (SELECT p, sum(y) AS tp, count(*) AS n FROM s GROUP BY 1), k AS (SELECT *, sum(tp) OVER (ORDER BY p DESC) AS ct, sum(n) OVER (ORDER BY p DESC) AS cn, sum(tp) OVER () AS tot FROM c) """
       + sel("pr_auc f", "(SELECT sum(tp / tot * ct / cn) AS pr_auc FROM k)"))
def _(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("p", (C("n_chars") % 500) / 500.0)
    return S.average_precision(d, [], "p", "quality")


@query("pinball_coverage", agg("avg(greatest(0.9 * (ret - mkt), (0.9 - 1) * (ret - mkt))) AS loss, avg((ret >= -mkt * 0.9 AND ret <= mkt * 0.9)::INT) AS cover", "loss f, cover f"))
def _(t):
    return _ret_df(t).groupBy("symbol").agg(S.pinball(C("mkt"), C("ret"), 0.9).alias("loss"), S.coverage(-C("mkt") * 0.9, C("mkt") * 0.9, C("ret")).alias("cover"))


@query("conformal_interval", f"WITH {BARS_SQL}, {_RET}, k AS (SELECT symbol, abs(ret) AS a, row_number() OVER (PARTITION BY symbol ORDER BY abs(ret)) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM r) {sel('symbol s, half_width f', '(SELECT symbol, a AS half_width FROM k WHERE k = ceil((n + 1) * 0.9))')}")
def _(t):
    return S.conformal_interval(_ret_df(t), ["symbol"], "ret")


@query("shadow_compare", agg("avg(ret) / stddev_samp(ret) * sqrt(252) AS champion_sharpe, avg(mkt) / stddev_samp(mkt) * sqrt(252) AS challenger_sharpe, avg((ret > 0)::INT) AS agreement, count(*) AS days, count(*) >= 60 AND avg(mkt) / stddev_samp(mkt) * sqrt(252) >= avg(ret) / stddev_samp(ret) * sqrt(252) + 0.3 AS promote",
                              "champion_sharpe f, challenger_sharpe f, agreement f, days i, promote b"))
def _(t):
    return S.shadow_compare(_ret_df(t).withColumn("agree", C("ret") > 0), ["symbol"], "ret", "mkt")


@query("lookback_windows", f"WITH {BARS_SQL}, m AS (SELECT symbol, max(rn) + 1 AS n FROM b GROUP BY 1), x AS (SELECT b.symbol, ts, rn, n, CASE WHEN rn >= 4 THEN sum(close) OVER (PARTITION BY b.symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS s, lag(close, 4) OVER (PARTITION BY b.symbol ORDER BY ts) AS f0 FROM b JOIN m ON m.symbol = b.symbol) {sel('symbol s, ts t, s f, f0 f, role s', '''(SELECT *, CASE WHEN rn >= floor(n * 0.85) THEN 'test' WHEN rn >= floor(n * 0.85) - 5 THEN 'drop' WHEN rn >= floor(n * 0.7) THEN 'val' WHEN rn >= floor(n * 0.7) - 5 THEN 'drop' ELSE 'train' END AS role FROM x)''')}".replace("floor(n * 0.7)", "floor(n * (1 - 0.15::DOUBLE - 0.15::DOUBLE))").replace("floor(n * 0.85)", "floor(n * (1 - 0.15::DOUBLE))"))
def _(t):
    s = S.lookback_windows(bars(t, 4), "close", 5).flat()
    n = s.df.groupBy("symbol").agg((F.max(RN) + 1).alias("n"))
    d = s.df.join(n, "symbol")
    return d.select("symbol", "ts", F.aggregate("window", F.lit(0.0), lambda a, v: a + v).alias("s"), C("window")[0].alias("f0"), S.time_split(C("n"), C(RN), gap=5).alias("role"))


@query("implied_vs_realized", agg("avg(mkt * 0.9) AS mean_implied, avg(abs(ret)) AS mean_realized, avg((abs(ret) > mkt * 0.9)::INT) AS share_exceeded, avg(mkt * 0.9 - abs(ret)) AS mean_premium, count(*) AS n", "mean_implied f, mean_realized f, share_exceeded f, mean_premium f, n i"))
def _(t):
    return S.implied_vs_realized(_ret_df(t).withColumn("mkt", C("mkt") * 0.9), ["symbol"], "mkt", "ret")


@query("event_study", f"""WITH {BARS_SQL}, {_RET}, ev AS (SELECT symbol, rn AS e FROM r WHERE rn % 97 = 96), j AS (SELECT ev.symbol, ev.e, r.rn - ev.e AS o, ret, mkt FROM ev JOIN r ON r.symbol = ev.symbol AND r.rn BETWEEN ev.e - 60 AND ev.e + 5),
 g AS (SELECT symbol, e, regr_slope(ret, mkt) FILTER (WHERE o BETWEEN -60 AND -10) AS bb, regr_intercept(ret, mkt) FILTER (WHERE o BETWEEN -60 AND -10) AS aa, count(*) FILTER (WHERE o BETWEEN -60 AND -10) AS ne, count(*) FILTER (WHERE o BETWEEN -1 AND 5) AS nw FROM j GROUP BY 1, 2),
 c AS (SELECT o, sum(ret - aa - bb * mkt) OVER (PARTITION BY j.symbol, j.e ORDER BY o) AS car FROM j JOIN g ON g.symbol = j.symbol AND g.e = j.e WHERE ne = 51 AND nw = 7 AND o BETWEEN -1 AND 5)
 {sel('o0 i, mean_car f, t_stat f, n i', '(SELECT o AS o0, avg(car) AS mean_car, avg(car) / (stddev_samp(car) / sqrt(count(*))) AS t_stat, count(*) AS n FROM c GROUP BY 1)')}""")
def _(t):
    d = _ret_df(t)
    ev = Series.of(d, BARS_SPEC).df.where(C(RN) % 97 == 96).select("symbol", C(RN).alias("event_rn"))
    return S.event_study(d, BARS_SPEC, ev, est=(-60, -10), win=(-1, 5)).withColumnRenamed("offset", "o0")


@query("drift_by_label", None)
def _(t):
    d = _ret_df(t)
    ev = Series.of(d, BARS_SPEC).df.where(C(RN) % 97 == 96).select("symbol", C(RN).alias("event_rn"), F.when(C("ret") > 0, "raised").otherwise("lowered").alias("label"))
    return S.event_study(d, BARS_SPEC, ev, est=(-60, -10), win=(1, 5), by=("label",)).withColumnRenamed("offset", "o0")


_SPANS = "sp AS (SELECT symbol, rn AS t0_rn, rn + 3 + rn % 5 AS t1_rn FROM b WHERE rn % 4 = 0), mx AS (SELECT symbol, max(rn) AS m FROM b GROUP BY 1), s2 AS (SELECT sp.* FROM sp JOIN mx USING (symbol) WHERE t1_rn <= m)"


def _spans(t):
    d = Series.of(t.bars().select("symbol", "ts"), BARS_SPEC).df
    m = d.groupBy("symbol").agg(F.max(RN).alias("_m"))
    return d.where(C(RN) % 4 == 0).select("symbol", C(RN).alias("t0_rn"), (C(RN) + 3 + C(RN) % 5).alias("t1_rn")).join(m, "symbol").where(C("t1_rn") <= C("_m")).drop("_m")


@query("num_concurrent", f"WITH {BARS_SQL}, {_SPANS} {sel('symbol s, ts t, concurrent i', '(SELECT b.symbol, b.ts, count(s2.t0_rn) AS concurrent FROM b LEFT JOIN s2 ON s2.symbol = b.symbol AND b.rn BETWEEN s2.t0_rn AND s2.t1_rn GROUP BY 1, 2)')}")
def _(t):
    return S.num_concurrent(t.bars().select("symbol", "ts"), _spans(t), BARS_SPEC).select("symbol", "ts", "concurrent")


@query("avg_uniqueness", f"WITH {BARS_SQL}, {_SPANS}, c AS (SELECT b.symbol, b.rn, count(s2.t0_rn) AS c FROM b LEFT JOIN s2 ON s2.symbol = b.symbol AND b.rn BETWEEN s2.t0_rn AND s2.t1_rn GROUP BY 1, 2) {sel('symbol s, t0_rn i, t1_rn i, uniqueness f', '(SELECT s2.symbol, t0_rn, t1_rn, avg(1.0::DOUBLE / c) AS uniqueness FROM s2 JOIN c ON c.symbol = s2.symbol AND c.rn BETWEEN t0_rn AND t1_rn GROUP BY 1, 2, 3)')}")
def _(t):
    sp = _spans(t)
    c = S.num_concurrent(t.bars().select("symbol", "ts"), sp, BARS_SPEC)
    return S.avg_uniqueness(c, sp, BARS_SPEC)


# ---------------------------------------------------------------- edges and bootstraps
@query("pattern_edge", None)
def _(t):
    s = I.forward_returns(PT.engulfing(bars(t, 1, 6)), 5)
    return R.permutation_edge(s.done(keep_rn=True), ["symbol"], RN, "engulfing", "fwd", n_perm=200)


@query("edge_table", None)
def _(t):
    """Edge per pattern, side, symbol; false-discovery control over all rows; summary per pattern and side."""
    s = PT.morning_evening_star(PT.engulfing(bars(t, 2, 6)))
    d = I.forward_returns(s, 5).done(keep_rn=True)
    u = d.unpivot(["symbol", RN, "fwd"], ["engulfing", "star"], "pattern", "sig").withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    u = u.withColumn("hit", (C("sig") == C("side")).cast("int"))
    e = R.permutation_edge(u, ["pattern", "side", "symbol"], RN, "hit", "fwd", n_perm=100).where(C("n") > 0)
    q = S.bh(e.withColumn("id", F.concat_ws("/", "pattern", "side", "symbol")), alpha=0.1)
    return q.groupBy("pattern", "side").agg(F.count(F.lit(1)).alias("tests"), F.sum("n").alias("events"), (F.sum(C("edge") * C("n")) / F.sum("n")).alias("mean_edge"),
                                            F.avg((C("p_value") < 0.05).cast("double")).alias("share_p05"), F.sum(C("discovery").cast("int")).alias("discoveries"))


@query("bootstrap_sharpes", None)
def _(t):
    b = R.bootstrap_sharpes(_ret_df(t).select("symbol", "ts", "ret"), BARS_SPEC, reps=200)
    return b.groupBy("symbol").agg(F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("sd"), F.count(F.lit(1)).alias("reps"))


@query("block_bootstrap_ci", None)
def _(t):
    return R.block_bootstrap_ci(_ret_df(t).select("symbol", "ts", "ret"), BARS_SPEC, reps=200)


@query("half_life_ci", None)
def _(t):
    s = bars(t, 9)
    d = s.add(x=F.avg("close").over(s.rows(-9))).done().select("symbol", "ts", "x")
    return R.half_life_ci(d, BARS_SPEC, reps=100)


@query("reality_check", None)
def _(t):
    d = _ret_df(t).select(C("symbol").alias("strategy"), "ts", "ret")
    return R.reality_check(d, BARS_SPEC.with_(keys=("strategy",)), reps=200)


@query("drawdown_distribution", None)
def _(t):
    d = R.drawdown_distribution(_trades(t).withColumn("ret", C("ret") * 1e-4), ["symbol"], "entry_i", reps=50)
    return d.groupBy("symbol").agg(F.avg("max_dd").alias("mean_dd"), F.min("max_dd").alias("worst_dd"))


@query("risk_of_ruin", None)
def _(t):
    from .market_queries import journal
    j = journal(t).where(C("r_multiple").isNotNull()).select(C("setup_tag").alias("symbol"), C("trade_id").alias("seq"), "r_multiple")
    return R.risk_of_ruin(j, SeriesSpec(("symbol",), ("seq",), "seq div 100000"), 0.02, n_trades=100, n_sims=200)


@query("backtest_band", None)
def _(t):
    return R.backtest_band(_ret_df(t).select("symbol", "ts", "ret"), BARS_SPEC, reps=200)


@query("inside_band", f"""WITH {BARS_SQL}, {_RET}, c AS (SELECT symbol, rn + 1 AS day, sum(ret) OVER w AS cum FROM r {W}) {sel('symbol s, day i, cum f, inside b', '(SELECT symbol, day, cum, cum BETWEEN -0.01 * sqrt(day) AND 0.01 * sqrt(day) AS inside FROM c)')}""")
def _(t):
    last = t.bars().groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    band = last.select(F.explode(F.sequence(F.lit(1).cast("bigint"), C("n"))).alias("day")).select("day", (-0.01 * F.sqrt("day")).alias("lower"), (0.01 * F.sqrt("day")).alias("upper"))
    return S.inside_band(rets(t), band).select("symbol", "day", "cum", "inside")


# ---------------------------------------------------------------- folds
@query("walk_forward_folds", f"""WITH {BARS_SQL}, n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), f AS (SELECT symbol, k AS fold FROM n, range(1000) r(k) WHERE k * 100 + 500 + 100 <= n) {sel('symbol s, fold i, role s, lo i, hi i', "(SELECT symbol, fold, 'train' AS role, fold * 100 AS lo, fold * 100 + 499 AS hi FROM f UNION ALL SELECT symbol, fold, 'test', fold * 100 + 500, fold * 100 + 599 FROM f)")}""")
def _(t):
    return R.walk_forward_folds(t.bars().groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), ["symbol"], 500, 100)


_BLK = "n // {k} * i + least(i, n % {k})"


@query("purged_folds", f"""WITH {BARS_SQL}, n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), f AS (SELECT symbol, n, i, n // 5 * i + least(i, n % 5) AS lo, n // 5 * i + least(i, n % 5) + n // 5 + (i < n % 5)::INT - 1 AS hi, ceil(0.01 * n)::BIGINT AS em FROM n, range(5) r(i)),
 u AS (SELECT symbol, i AS fold, 'test' AS role, lo, hi FROM f UNION ALL SELECT symbol, i, 'train', 0, lo - 6 FROM f UNION ALL SELECT symbol, i, 'train', hi + em + 1, n - 1 FROM f) {sel('symbol s, fold i, role s, lo i, hi i', 'u', 'lo <= hi')}""")
def _(t):
    return R.purged_folds(t.bars().groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), ["symbol"])


@query("cpcv_roles", f"""WITH {BARS_SQL}, n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), cb AS (SELECT row_number() OVER (ORDER BY a.g, z.g) - 1 AS combo, a.g AS g1, z.g AS g2 FROM range(6) a(g), range(6) z(g) WHERE a.g < z.g), g AS (SELECT combo, g1 AS i FROM cb UNION ALL SELECT combo, g2 FROM cb),
 t AS (SELECT symbol, combo, n // 6 * i + least(i, n % 6) AS lo, n // 6 * i + least(i, n % 6) + n // 6 + (i < n % 6)::INT - 1 AS hi, ceil(0.01 * n) AS em FROM n, g), r AS (SELECT b.symbol, b.rn, combo, bool_or(b.rn BETWEEN lo AND hi) AS te, bool_and(b.rn + 5 < lo OR b.rn > hi + em) AS tr FROM b JOIN t ON t.symbol = b.symbol GROUP BY 1, 2, 3)
 {sel('symbol s, combo i, role s, n i', "(SELECT symbol, combo, CASE WHEN te THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM r WHERE te OR tr GROUP BY 1, 2, 3)")}""")
def _(t):
    d = Series.of(t.bars().select("symbol", "ts"), BARS_SPEC).df
    n = t.bars().groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return R.cpcv_roles(d, n, ["symbol"]).groupBy("symbol", "combo", "role").agg(F.count(F.lit(1)).alias("n"))


def _configs(t):
    """P&L of a small grid of position rules on every symbol: long rows (symbol, ts, config, pnl)."""
    s = bars(t, 30, 1)
    ns = (5, 10, 15, 20, 25, 30)
    for n in ns:
        s = I.sma(s, "close", n, f"m{n}")
    s = s.add(_r=F.log(s.lead("close", 1) / C("close")) * 0.01)
    d = s.done().where(C("_r").isNotNull())
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("config"), F.coalesce(F.signum(C("close") - C(f"m{n}")) * C("_r"), F.lit(0.0)).alias("pnl")) for i, n in enumerate(ns)])
    return d.select("symbol", "ts", F.inline(rows))


_CFG = f"""l AS (SELECT *, ln(lead(close) OVER w / close) * 0.01 AS r, {', '.join(gate('avg(close) @', n) + f' AS m{n}' for n in (5, 10, 15, 20, 25, 30))} FROM b {W}),
 cf AS ({' UNION ALL '.join(f'SELECT symbol, rn, {i} AS config, coalesce(sign(close - m{n}) * r, 0) AS pnl FROM l WHERE r IS NOT NULL' for i, n in enumerate((5, 10, 15, 20, 25, 30)))})"""


@query("walk_forward_optimize", f"""WITH {BARS_SQL}, {_CFG}, nn AS (SELECT symbol, max(rn) + 1 AS n FROM cf GROUP BY 1), f AS (SELECT symbol, k AS fold FROM nn, range(1000) r(k) WHERE k * 100 + 600 <= n),
 i AS (SELECT f.symbol, fold, config, avg(pnl) / stddev_samp(pnl) * sqrt(252) AS s FROM f JOIN cf ON cf.symbol = f.symbol AND rn BETWEEN fold * 100 AND fold * 100 + 499 GROUP BY 1, 2, 3), o AS (SELECT f.symbol, fold, config, avg(pnl) / stddev_samp(pnl) * sqrt(252) AS s, sum(pnl) AS p FROM f JOIN cf ON cf.symbol = f.symbol AND rn BETWEEN fold * 100 + 500 AND fold * 100 + 599 GROUP BY 1, 2, 3),
 bst AS (SELECT symbol, fold, arg_max(config, s) AS config, max(s) AS is_sharpe FROM i GROUP BY 1, 2) {sel('symbol s, fold i, config i, is_sharpe f, oos_sharpe f, oos_pnl f', '(SELECT bst.*, o.s AS oos_sharpe, o.p AS oos_pnl FROM bst JOIN o USING (symbol, fold, config))')}""")
def _(t):
    return R.walk_forward_optimize(_configs(t), BARS_SPEC, 500, 100)


@query("walk_forward_efficiency", None)
def _(t):
    return R.walk_forward_efficiency(R.walk_forward_optimize(_configs(t), BARS_SPEC, 500, 100), ["symbol"])


@query("pbo_cscv", f"""WITH {BARS_SQL}, {_CFG}, nn AS (SELECT symbol, max(rn) + 1 AS n FROM cf GROUP BY 1), bk AS (SELECT cf.*, CASE WHEN rn < n % 6 * (n // 6 + 1) THEN rn // (n // 6 + 1) ELSE n % 6 + (rn - n % 6 * (n // 6 + 1)) // (n // 6) END AS blk FROM cf JOIN nn USING (symbol)),
 cb AS (SELECT row_number() OVER (ORDER BY a.g, c.g, d.g) - 1 AS split, [a.g, c.g, d.g] AS ins FROM range(6) a(g), range(6) c(g), range(6) d(g) WHERE a.g < c.g AND c.g < d.g),
 g AS (SELECT symbol, split, config, list_contains(ins, blk) AS isin, avg(pnl) / stddev_samp(pnl) AS sr FROM bk, cb GROUP BY 1, 2, 3, 4), w AS (SELECT symbol, split, arg_max(config, sr) AS bc FROM g WHERE isin GROUP BY 1, 2),
 o AS (SELECT symbol, split, config, row_number() OVER (PARTITION BY symbol, split ORDER BY sr, config) AS rk FROM g WHERE NOT isin) {sel('symbol s, split i, config i, logit f', '(SELECT o.symbol, o.split, o.config, ln((rk / 7.0) / (1 - rk / 7.0)) AS logit FROM o JOIN w ON w.symbol = o.symbol AND w.split = o.split AND w.bc = o.config)')}""")
def _(t):
    return R.pbo_cscv(_configs(t), BARS_SPEC, 6)


@query("pbo", sel("symbol s, pbo f, splits i", f"(SELECT symbol, avg((logit <= 0)::INT) AS pbo, count(*) AS splits FROM ({ORACLES['pbo_cscv']}) GROUP BY 1)"))
def _(t):
    return R.pbo(R.pbo_cscv(_configs(t), BARS_SPEC, 6), ["symbol"])


@query("plateau_scores", f"""WITH g AS (SELECT p_size % 7 AS x, p_partkey % 9 AS y, avg(p_retailprice) AS score FROM part GROUP BY 1, 2) {sel('x i, y i, score f, plateau f', '(SELECT a.x, a.y, a.score, avg(z.score) AS plateau FROM g a JOIN g z ON abs(a.x - z.x) <= 1 AND abs(a.y - z.y) <= 1 GROUP BY 1, 2, 3)')}""")
def _(t):
    g = t.part.groupBy((C("p_size") % 7).alias("x"), (C("p_partkey") % 9).alias("y")).agg(F.avg("p_retailprice").alias("score"))
    return R.plateau_scores(g, "x", "y")


@query("pareto_front", sel("o_orderkey i", "(SELECT a.o_orderkey FROM orders a ANTI JOIN orders z ON z.o_totalprice >= a.o_totalprice AND z.o_custkey <= a.o_custkey AND (z.o_totalprice > a.o_totalprice OR z.o_custkey < a.o_custkey))"))
def _(t):
    return R.pareto_front(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), "o_totalprice", "o_custkey").select("o_orderkey")


@query("grid_search", f"""WITH {BARS_SQL}, {_CFG} {sel('symbol s, config i, score f', '(SELECT symbol, config, avg(pnl) / stddev_samp(pnl) * sqrt(252) AS score FROM cf GROUP BY 1, 2)')}""")
def _(t):
    """Sharpe ratio of every rule of the grid on every symbol."""
    return R.sharpe_by(_configs(t), ["symbol", "config"]).select("symbol", "config", C("sharpe").alias("score"))


def _variants(t):
    """P&L of one rule and of its neighbours: moved parameter, position one bar late, costs doubled."""
    s = bars(t, 31, 1)
    for n in (8, 10, 12):
        s = I.sma(s, "close", n, f"m{n}")
    s = s.add(_r=F.log(s.lead("close", 1) / C("close")) * 0.01, **{f"p{n}": F.coalesce(F.signum(C("close") - C(f"m{n}")), F.lit(0.0)) for n in (8, 10, 12)})
    s = s.add(**{f"q{n}": F.coalesce(s.lag(f"p{n}"), F.lit(0.0)) for n in (8, 10, 12)}, late=F.coalesce(s.lag("p10", 2), F.lit(0.0)))
    d = s.done().where(C("_r").isNotNull())
    net = lambda p, before, bps: p * C("_r") - bps / 1e4 * F.abs(p - before)
    cost = 0.5
    rows = {"base": net(C("p10"), C("q10"), cost), "param -20%": net(C("p8"), C("q8"), cost), "param +20%": net(C("p12"), C("q12"), cost),
            "delay 1 bar": net(C("q10"), C("late"), cost), "costs x2": net(C("p10"), C("q10"), 2 * cost)}
    return d.select("symbol", "ts", F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("pnl")) for k, v in rows.items()])))


@query("robustness_gate", None)
def _(t):
    """Scorecard of a rule per symbol and the gate on its metrics; overfitting from the grid, drawdown from the curve."""
    p = kept(_variants(t))
    card = R.robustness_scorecard(p, BARS_SPEC, keys=["symbol"])
    base = p.where(C("variant") == "base").withColumnRenamed("pnl", "ret")
    m = S.sharpe_moments(base, ["symbol"]).select("symbol", (C("sr") * 252 ** 0.5).alias("oos_sharpe"), S.psr().alias("dsr"))
    curve = Series.of(base, BARS_SPEC).running({"equity": ("sum", C("ret"))}).running({"peak": ("max", F.greatest(C("equity"), F.lit(0.0)))}).df
    dd = curve.groupBy("symbol").agg(F.min(F.exp(C("equity") - C("peak")) - 1).alias("max_dd"))
    over = R.pbo(R.pbo_cscv(_configs(t), BARS_SPEC, 6), ["symbol"]).select("symbol", "pbo")
    x = m.join(over, "symbol").join(dd, "symbol").join(card.groupBy("symbol").agg(F.avg(C("passed").cast("double")).alias("robustness")), "symbol")
    gate = R.validation_gate(x, keys=["symbol"]).select("symbol", "check", "value", "passed", "all_passed")
    return gate.unionByName(card.select("symbol", C("test").alias("check"), "value", "passed", F.lit(None).cast("boolean").alias("all_passed")))
