"""Regimes, folds by label times and walk-forward meta labels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expanding as E
from ..operators import hmm as H
from ..operators import label_folds as LF
from ..operators import ml as ML
from ..operators import stats as S
from ..operators import student as ST
from ..series import RN, SeriesSpec
from ..session import checkpointed
from .base import BARS_SPEC, BARS_SQL, query, sel
from .desk_queries import ncdf
from .indicator_queries import ADX_SQL, bars
from .stats_queries import rets

C, L = F.col, F.lit


# ---------------------------------------------------------------- hidden Markov models
@query("hmm_regimes", None)
def _(t):
    """State of each row: most likely path over all rows, filter (rows up to it only) and smoother."""
    rows, _fit = H.hmm_regimes(rets(t), "ret")
    return rows.select("symbol", C(RN).alias("rn"), "state", C("filtered")[1].alias("p_high"), C("smoothed")[1].alias("s_high"))


@query("hmm_model", None)
def _(t):
    """Fitted parameters, with the gain of the last pass and whether it settled."""
    fitted = H.Chain(rets(t), "ret").fit()
    return H.model(fitted, ["symbol"]).select("symbol", "state", "start", C("moves")[0].alias("to_calm"), C("moves")[1].alias("to_wild"), F.sqrt("variance").alias("sd"), "offset", "loglik", "settled")


def _density(x, v):
    return f"exp(-0.5 * ({x} * {x} / {v} + ln(2 * pi() * {v})))"


def _move(a, b):
    return f"ln({'0.95' if a == b else '0.05'}::DOUBLE)"


_HMM = f"""WITH RECURSIVE {BARS_SQL}, r AS (SELECT symbol, rn, ln(close / open) * 0.01 AS r0 FROM b),
 x AS (SELECT symbol, rn, r0 - avg(r0) OVER p AS x, var_pop(r0) OVER p * 0.36 AS v0, var_pop(r0) OVER p * 2.56 AS v1, max(rn) OVER p AS top FROM r WINDOW p AS (PARTITION BY symbol)),
 e AS MATERIALIZED (SELECT symbol, rn, top, {_density('x', 'v0')} AS b0, {_density('x', 'v1')} AS b1 FROM x),
 f AS (SELECT symbol, rn, top, b0 / (b0 + b1) AS p, ln(0.5::DOUBLE) + ln(b0) AS d0, ln(0.5::DOUBLE) + ln(b1) AS d1, 0 AS k0, 0 AS k1 FROM e WHERE rn = 0
 UNION ALL SELECT e.symbol, e.rn, e.top, (1 - (0.05 * f.p + 0.95 * (1 - f.p)) * e.b1 / ((0.95 * f.p + 0.05 * (1 - f.p)) * e.b0 + (0.05 * f.p + 0.95 * (1 - f.p)) * e.b1)),
 greatest(f.d0 + {_move(0, 0)}, f.d1 + {_move(1, 0)}) + ln(e.b0), greatest(f.d0 + {_move(0, 1)}, f.d1 + {_move(1, 1)}) + ln(e.b1),
 CASE WHEN f.d1 + {_move(1, 0)} > f.d0 + {_move(0, 0)} THEN 1 ELSE 0 END, CASE WHEN f.d1 + {_move(1, 1)} > f.d0 + {_move(0, 1)} THEN 1 ELSE 0 END
 FROM f JOIN e ON e.symbol = f.symbol AND e.rn = f.rn + 1),
 g AS MATERIALIZED (SELECT * FROM f),
 w AS (SELECT symbol, rn, CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS state FROM g WHERE rn = top
 UNION ALL SELECT g.symbol, g.rn, CASE WHEN w.state = 1 THEN n.k1 ELSE n.k0 END FROM w JOIN g ON g.symbol = w.symbol AND g.rn = w.rn - 1 JOIN g n ON n.symbol = w.symbol AND n.rn = w.rn)"""


@query("hmm_filter_path", f"{_HMM} {sel('symbol s, rn i, state i, p_high f', '(SELECT g.symbol, g.rn, state, 1 - p AS p_high FROM g JOIN w ON w.symbol = g.symbol AND w.rn = g.rn)')}")
def _(t):
    """Filter and path of a stated model: calm and wild rows at 0.6 and 1.6 of the symbol's deviation."""
    s = rets(t)
    v = F.var_pop("ret")
    par = s.flat().df.groupBy("symbol").agg(F.array(*[L(x) for x in (0.5, 0.5, 0.95, 0.05, 0.05, 0.95, 0.0, 0.0)], v * 0.36, v * 2.56).alias("par"))
    rows = H.Chain(s, "ret", block=512).states(par)
    return rows.select("symbol", C(RN).alias("rn"), "state", C("filtered")[1].alias("p_high"))


# ---------------------------------------------------------------- folds by label times
EVENTS = SeriesSpec(("symbol",), ("t0_rn",), "t0_rn div 100000")
TRANSIT = SeriesSpec(("supplier",), ("t0", "id", "t1"), "year(t0)")


def _transit(t):
    """Labels that take time to resolve: an order line of q pieces is known q days after the order."""
    return (t.lineitem.join(t.orders.select(C("o_orderkey").alias("l_orderkey"), C("o_orderdate").alias("t0")), "l_orderkey")
            .select(C("l_suppkey").alias("supplier"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), "t0", F.expr("t0 + make_dt_interval(cast(l_quantity as int))").alias("t1")))


_FOLDS = """WITH l AS (SELECT l_suppkey AS supplier, l_orderkey * 10 + l_linenumber AS id, o_orderdate AS t0, o_orderdate + to_days(l_quantity::INT) AS t1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 p AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY t0, id, t1) - 1 AS pos, count(*) OVER (PARTITION BY supplier) AS n FROM l),
 f AS (SELECT *, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS fold FROM p),
 s AS (SELECT supplier, fold, n, min(t0) AS a, max(t1) AS b, max(pos) AS last FROM f GROUP BY 1, 2, 3),
 e AS (SELECT s.supplier, s.fold, s.a, greatest(s.b, q.t0) AS b FROM s JOIN p q ON q.supplier = s.supplier AND q.pos = least(s.last + ceil(0.01::DOUBLE * s.n)::BIGINT, s.n - 1)),
 o AS (SELECT f.supplier, f.id, f.pos, f.fold, string_agg(e.fold::VARCHAR, ',' ORDER BY e.fold) AS purged FROM f LEFT JOIN e ON e.supplier = f.supplier AND e.fold <> f.fold AND f.t1 >= e.a AND f.t0 <= e.b GROUP BY 1, 2, 3, 4)"""


@query("purged_label_folds", f"{_FOLDS} {sel('supplier i, id i, fold i, purged s', '(SELECT supplier, id, fold, coalesce(purged, chr(45)) AS purged FROM o)')}")
def _(t):
    d = LF.purged_kfold(_transit(t), TRANSIT, "t0", "t1")
    return d.select("supplier", "id", "fold", F.when(F.size("purged") > 0, F.array_join("purged", ",")).otherwise("-").alias("purged"))


@query("purged_label_sizes", f"""{_FOLDS}, k AS (SELECT unnest(range(5)) AS fold) {sel('supplier i, fold i, tested i, purged i, trained i', "(SELECT o.supplier, k.fold, sum((o.fold = k.fold)::INT) AS tested, sum((contains(',' || coalesce(purged, '') || ',', ',' || k.fold || ','))::INT) AS purged, sum((o.fold <> k.fold AND NOT contains(',' || coalesce(purged, '') || ',', ',' || k.fold || ','))::INT) AS trained FROM o, k GROUP BY 1, 2)")}""")
def _(t):
    """Rows that each fold tests, trains on and leaves out."""
    d = LF.purged_kfold(_transit(t), TRANSIT, "t0", "t1")
    c = lambda p: F.sum(p.cast("int"))
    parts = [LF.purged_training(d, f) for f in range(5)]
    g = d.groupBy("supplier").agg(F.count(L(1)).alias("n"), *[c(te).alias(f"te{f}") for f, (_, te) in enumerate(parts)], *[c(tr).alias(f"tr{f}") for f, (tr, _) in enumerate(parts)])
    rows = F.array(*[F.struct(L(f).alias("fold"), C(f"te{f}").alias("tested"), (C("n") - C(f"te{f}") - C(f"tr{f}")).alias("purged"), C(f"tr{f}").alias("trained")) for f in range(5)])
    return g.select("supplier", F.inline(rows))


@query("purged_label_cv", None)
def _(t):
    """Out-of-fold AUC of barrier labels with folds purged by label times."""
    ds = checkpointed(ML.meta_dataset(bars(t, 30), h=1.0))
    feats = ["ret5", "ret20", "vol20", "vol_ratio", "er10"]
    d = checkpointed(LF.purged_kfold(ds.dropna(subset=feats), EVENTS, "t0_rn", "t1_rn", 3))
    return ML.auc(ML.cv_predictions(ML.assemble(d, feats), [LF.purged_training(d, f) for f in range(3)]).select("symbol", "fold", "y", "prob"), by=("symbol",))


# ---------------------------------------------------------------- walk-forward meta labels
_BET = f"CASE WHEN prob >= 1 THEN 1.0 WHEN prob <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 2 * {ncdf('((prob - 0.5) / sqrt(prob * (1 - prob)))')} - 1)) END"


def _events(t):
    """Every seventh bar with its barrier outcome; the side follows the bar, two features, weight by length."""
    d = bars(t).df
    e = d.where(C(RN) % 7 == 0).select("symbol", C(RN).alias("t0_rn"), C("close").alias("c0"), L(0.3).alias("vol"))
    tb = ML.triple_barrier(d, e, ["symbol"])
    side = F.when(C("close") >= C("open"), 1.0).otherwise(-1.0)
    x = d.select("symbol", C(RN).alias("t0_rn"), side.alias("side"), (C("close") / C("open") - 1).alias("x1"), (C("high") / C("low") - 1).alias("x2"))
    return (tb.join(x, ["symbol", "t0_rn"]).withColumn("ret", C("side") * C("ret")).withColumn("y", (C("ret") > 0).cast("int"))
            .withColumn("w", 1.0 / (C("t1_rn") - C("t0_rn"))))


_META = f"""WITH {BARS_SQL}, e AS (SELECT symbol, rn AS t0_rn, close AS c0 FROM b WHERE rn % 7 = 0), j AS (SELECT e.*, b.rn, b.close / c0 - 1 AS r FROM e JOIN b ON b.symbol = e.symbol AND b.rn BETWEEN t0_rn + 1 AND t0_rn + 10),
 g AS (SELECT symbol, t0_rn, coalesce(min(rn) FILTER (WHERE r >= 0.3 OR r <= -0.3), max(rn)) AS t1_rn FROM j GROUP BY 1, 2),
 d AS (SELECT g.*, CASE WHEN b.close >= b.open THEN j.r ELSE -j.r END AS ret, b.close / b.open - 1 AS x1, b.high / b.low - 1 AS x2, 1.0::DOUBLE / (g.t1_rn - g.t0_rn) AS w,
 row_number() OVER (PARTITION BY g.symbol ORDER BY g.t0_rn) - 1 AS pos, count(*) OVER (PARTITION BY g.symbol) AS n FROM g JOIN j USING (symbol, t0_rn) JOIN b ON b.symbol = g.symbol AND b.rn = g.t0_rn WHERE j.rn = g.t1_rn),
 p AS (SELECT *, (ret > 0)::INT AS y, CASE WHEN pos >= floor(n / 3) THEN (pos - floor(n / 3)::BIGINT) // 100 END AS win FROM d),
 k AS (SELECT symbol, win, min(t0_rn) AS at FROM p WHERE win IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT k.symbol, k.win, count(p.y) AS known, sum(w) AS ws, sum(w * y) AS w1, sum(w * (1 - y)) AS w0, sum(w * y * x1) AS a1, sum(w * y * x2) AS a2, sum(w * (1 - y) * x1) AS b1, sum(w * (1 - y) * x2) AS b2,
 sum(w * x1 * x1) AS xx, sum(w * x1 * x2) AS xy, sum(w * x2 * x2) AS yy FROM k JOIN p ON p.symbol = k.symbol AND p.t1_rn < k.at GROUP BY 1, 2),
 c AS (SELECT *, (xx - a1 * a1 / w1 - b1 * b1 / w0) / ws AS cxx, (xy - a1 * a2 / w1 - b1 * b2 / w0) / ws AS cxy, (yy - a2 * a2 / w1 - b2 * b2 / w0) / ws AS cyy, a1 / w1 - b1 / w0 AS dx, a2 / w1 - b2 / w0 AS dy FROM s),
 v AS (SELECT *, (cyy * dx - cxy * dy) / (cxx * cyy - cxy * cxy) AS cx, (cxx * dy - cxy * dx) / (cxx * cyy - cxy * cxy) AS cy FROM c),
 q AS (SELECT p.symbol, p.pos, p.win, p.y, p.ret, v.known, 1 / (1 + exp(-(ln(w1) - ln(w0) - 0.5 * ((a1 / w1 + b1 / w0) * cx + (a2 / w1 + b2 / w0) * cy) + cx * x1 + cy * x2))) AS prob FROM p JOIN v ON v.symbol = p.symbol AND v.win = p.win),
 o AS (SELECT *, ret - 0.001 AS primary_, size * ret - 0.001 * size AS meta FROM (SELECT *, {_BET} AS size FROM q))"""


@query("walk_forward_meta", f"{_META} {sel('symbol s, pos i, win i, known i, prob f, size f, y i, pnl_primary f, pnl_meta f', '(SELECT symbol, pos, win, known, prob, size, y, primary_ AS pnl_primary, meta AS pnl_meta FROM o)')}")
def _(t):
    o = LF.walk_forward_meta(_events(t), EVENTS, "t0_rn", "t1_rn", ["x1", "x2"], w="w")
    return o.select("symbol", "pos", C("window").alias("win"), "known", "prob", "size", "y", C("primary").alias("pnl_primary"), C("meta").alias("pnl_meta"))


@query("meta_summary", f"""{_META}, a AS (SELECT symbol, 'primary' AS arm, primary_ AS pnl, TRUE AS taken, y FROM o UNION ALL SELECT symbol, 'meta', meta, size > 0, y FROM o)
 {sel('symbol s, arm s, trades i, precision f, total f, sharpe f', '(SELECT symbol, arm, sum(taken::INT) AS trades, avg(y) FILTER (taken) AS precision, sum(pnl) AS total, avg(pnl) / stddev_samp(pnl) * sqrt(count(*) / 7.0::DOUBLE) AS sharpe FROM a GROUP BY 1, 2)')}""")
def _(t):
    return LF.meta_summary(LF.walk_forward_meta(_events(t), EVENTS, "t0_rn", "t1_rn", ["x1", "x2"], w="w"), ["symbol"], 7.0)


@query("walk_forward_meta_features", None)
def _(t):
    """The same on events of the cumulative-sum filter with seven features and weights by uniqueness."""
    ds = checkpointed(ML.meta_dataset(bars(t, 30), h=1.0))
    spans = ds.select("symbol", "t0_rn", "t1_rn")
    active = S.num_concurrent(t.bars().select("symbol", "ts"), spans, BARS_SPEC)
    ds = checkpointed(ds.join(checkpointed(S.avg_uniqueness(checkpointed(active), spans, BARS_SPEC)), ["symbol", "t0_rn", "t1_rn"]))
    feats = ["ret5", "ret20", "vol20", "vol_ratio", "er10", "volume_z", "side"]
    return LF.meta_summary(LF.walk_forward_meta(ds.dropna(subset=feats), EVENTS, "t0_rn", "t1_rn", feats, w="uniqueness", retrain_every=25), ["symbol"], 7.0)


# ---------------------------------------------------------------- regimes by trend and volatility
@query("expanding_median", f"WITH {BARS_SQL} {sel('symbol s, rn i, volume_median f, close_median f', '(SELECT symbol, rn, median(volume) OVER w AS volume_median, median(close) OVER w AS close_median FROM b WINDOW w AS (PARTITION BY symbol ORDER BY rn))')}")
def _(t):
    s = bars(t)
    v, c = E.expanding_median(s, "volume", "volume_median", block=256), E.expanding_median(s, "close", "close_median", block=256)
    return v.join(c, ["symbol", RN]).withColumnRenamed(RN, "rn")


@query("regime_map", f"""WITH {BARS_SQL}, {ADX_SQL}, lr AS (SELECT symbol, rn, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY rn)) AS lr FROM b),
 sd AS (SELECT symbol, rn, CASE WHEN count(lr) OVER w = 20 THEN stddev_samp(lr) OVER w END AS vol FROM lr WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 me AS (SELECT *, median(vol) OVER (PARTITION BY symbol ORDER BY rn) AS vol_median FROM sd),
 fl AS (SELECT b.symbol, b.ts, vol, CASE WHEN vol IS NOT NULL THEN vol_median END AS vol_median, coalesce((ax.y > 25)::INT, 0) AS trend, coalesce((vol > vol_median)::INT, 0) AS high_vol FROM b LEFT JOIN ax USING (symbol, rn) JOIN me USING (symbol, rn))
 {sel('symbol s, ts t, vol f, vol_median f, trend i, high_vol i, regime s', "(SELECT *, CASE WHEN trend = 1 THEN 'trend' ELSE 'range' END || '/' || CASE WHEN high_vol = 1 THEN 'high vol' ELSE 'low vol' END AS regime FROM fl)")}""")
def _(t):
    return E.estimate_regimes(bars(t), block=256).select("symbol", "ts", "vol", "vol_median", "trend", "high_vol", "regime")


# ---------------------------------------------------------------- heavy tails
@query("student_t_fit", None)
def _(t):
    """Student-t fit of the log values of each event type; `settled` says that the scores promise no more."""
    d = t.events.where("value > 0").select("event_type", F.log("value").alias("v"))
    return ST.fit(d, ["event_type"], "v").select("event_type", "n", "df", "loc", "scale", "loglik", "settled")
