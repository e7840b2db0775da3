"""Streaming twins run over the stored events with availableNow; results must equal the batch definition."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import NEXT
from ..streaming import twins as TW
from .base import SCHEMAS, TRADES_SQL, query, sel, walk_sql
from .ledger_queries import _OK, _RAW

C = F.col
D = T.DoubleType()


def events(t):
    e = TW.read_files(TW.prepare(t.spark), f"{t.sf}/event[s].parquet", SCHEMAS["events"])
    return e.withColumn("ts", C("ts").cast("timestamp"))


def ticks(t):
    return events(t).select(C("event_type").alias("symbol"), "ts", C("event_id").alias("seq"), C("value").alias("price"), (1 + C("user_id") % 10).alias("size"))


def _scan(t, step, outputs):
    return TW.run_available(TW.scan(ticks(t), ["symbol"], ["ts", "seq"], step, [], outputs, ["symbol", "seq"]))


_B = "WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)"


@query("stream_bars", f"""WITH {TRADES_SQL}, mx AS (SELECT max(ts) AS m FROM trades), b AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(size) AS volume FROM trades GROUP BY 1, 2)
 {sel('symbol s, ts t, open f, high f, low f, close f, volume i', '(SELECT b.* FROM b, mx WHERE b.ts + INTERVAL 1 hour <= m)')}""")
def _(t):
    return TW.run_available(TW.tick_bars(ticks(t), "1 hour"))


_ROWS = f"{TRADES_SQL}, tr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS rn FROM trades)"
_NEXT = "CASE WHEN p.n < 20 THEN (p.total + s.price) / 20 ELSE s.price * 2 / 21 + p.val * 19 / 21 END"


@query("stream_ema", walk_sql(_ROWS, "tr", {"seq": ("s.seq", "s.seq"), "n": ("1", "p.n + 1"), "total": ("s.price", "p.total + s.price"), "val": ("s.price / 20", _NEXT),
                                            "ema": ("NULL::DOUBLE", f"CASE WHEN p.n >= 19 THEN {_NEXT} END")}, "symbol s, seq i, ema f"))
def _(t):
    return _scan(t, TW.ema_step("price", 20), {"ema": D})


_GAIN, _LOSS = ("(CASE WHEN s.rn <= 14 THEN p.{0} + {1} / 14 ELSE (p.{0} * 13 + {1}) / 14 END)".format(c, f"greatest({x}, 0::DOUBLE)") for c, x in (("gain", "s.price - p.prev"), ("loss", "p.prev - s.price")))


@query("stream_rsi", walk_sql(_ROWS, "tr", {"seq": ("s.seq", "s.seq"), "prev": ("s.price", "s.price"), "gain": ("0::DOUBLE", _GAIN), "loss": ("0::DOUBLE", _LOSS),
                                            "rsi": ("NULL::DOUBLE", f"CASE WHEN s.rn >= 14 THEN CASE WHEN {_LOSS} = 0 THEN 100 ELSE 100 - 100 / (1 + {_GAIN} / {_LOSS}) END END")}, "symbol s, seq i, rsi f"))
def _(t):
    return _scan(t, TW.rsi_step("price", 14), {"rsi": D})


@query("stream_rolling_max", f"WITH {TRADES_SQL} {sel('symbol s, seq i, rolling_max f', '(SELECT symbol, seq, CASE WHEN count(*) OVER w2 = 20 THEN max(price) OVER w2 END AS rolling_max FROM trades WINDOW w2 AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))')}")
def _(t):
    return _scan(t, TW.rolling_max_step("price", 20), {"rolling_max": D})


@query("stream_bollinger", f"WITH {TRADES_SQL} {sel('symbol s, seq i, upper f, middle f, lower f', '(SELECT symbol, seq, CASE WHEN count(*) OVER w2 = 20 THEN avg(price) OVER w2 + 2 * stddev_pop(price) OVER w2 END AS upper, CASE WHEN count(*) OVER w2 = 20 THEN avg(price) OVER w2 END AS middle, CASE WHEN count(*) OVER w2 = 20 THEN avg(price) OVER w2 - 2 * stddev_pop(price) OVER w2 END AS lower FROM trades WINDOW w2 AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))')}".replace("FROM trades WINDOW", "FROM (SELECT *, price AS p0 FROM trades) WINDOW"))
def _(t):
    return _scan(t, TW.bollinger_step("price", 20), {"upper": D, "middle": D, "lower": D})


@query("stream_rolling", f"WITH {TRADES_SQL} {sel('symbol s, seq i, std f', '(SELECT symbol, seq, CASE WHEN count(*) OVER w2 = 20 THEN stddev_samp(price) OVER w2 END AS std FROM trades WINDOW w2 AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))')}")
def _(t):
    return _scan(t, TW.rolling_step("price", 20), {"mean": D, "std": D}).drop("mean")


@query("stream_robust_z", None)
def _(t):
    return _scan(t, TW.robust_z_step("price", 100), {"z": D, "flag": T.BooleanType()})


_UP, _DOWN = "greatest(0::DOUBLE, p.up + (s.price - 50) / 50 - 0.5)", "greatest(0::DOUBLE, p.down - (s.price - 50) / 50 - 0.5)"
_UP0, _DOWN0 = _UP.replace("p.up + ", ""), _DOWN.replace("p.down - ", "- ")


@query("stream_cusum", walk_sql(_ROWS, "tr", {"seq": ("s.seq", "s.seq"), "up": (f"CASE WHEN greatest({_UP0}, {_DOWN0}) > 5 THEN 0 ELSE {_UP0} END", f"CASE WHEN greatest({_UP}, {_DOWN}) > 5 THEN 0 ELSE {_UP} END"),
                                              "down": (f"CASE WHEN greatest({_UP0}, {_DOWN0}) > 5 THEN 0 ELSE {_DOWN0} END", f"CASE WHEN greatest({_UP}, {_DOWN}) > 5 THEN 0 ELSE {_DOWN} END"),
                                              "alarm": (f"greatest({_UP0}, {_DOWN0}) > 5", f"greatest({_UP}, {_DOWN}) > 5")}, "symbol s, seq i, alarm b"))
def _(t):
    return _scan(t, TW.cusum_step("price", 50.0, 50.0), {"alarm": T.BooleanType()})


@query("stream_decay_index", f"WITH {TRADES_SQL} {sel('symbol s, seq i, index f', '(SELECT a.symbol, a.seq, round(sum((p.price - 50) * exp(-(epoch_us(a.ts) - epoch_us(p.ts)) / 3.6e9 / 24)), 3) AS index FROM trades a JOIN trades p ON p.symbol = a.symbol AND p.ts <= a.ts GROUP BY 1, 2)')}")
def _(t):
    s = ticks(t).withColumn("score", C("price") - 50)
    return TW.run_available(TW.scan(s, ["symbol"], ["ts", "seq"], TW.decay_step("score", "ts"), [], {"index": D}, ["symbol", "seq"])).withColumn("index", F.round("index", 3))


@query("stream_pov", f"WITH {TRADES_SQL}, w AS (SELECT symbol, seq, ts, coalesce(floor(0.1 * lag(size * 10) OVER (PARTITION BY symbol ORDER BY ts, seq)), 0) AS want FROM trades), c AS (SELECT *, sum(want) OVER (PARTITION BY symbol ORDER BY ts, seq) AS cum FROM w) {sel('symbol s, seq i, child f', '(SELECT symbol, seq, least(cum, 5000) - least(cum - want, 5000) AS child FROM c)')}")
def _(t):
    s = ticks(t).withColumn("vol", (C("size") * 10).cast("double"))
    return TW.run_available(TW.scan(s, ["symbol"], ["ts", "seq"], TW.pov_step("vol", 5000.0), [], {"child": D}, ["symbol", "seq"]))


@query("stream_orders", f"""WITH RECURSIVE {_RAW}, f AS (SELECT *, row_number() OVER (PARTITION BY coid ORDER BY ts, seq) - 1 AS rn, kind = 'fill' AND row_number() OVER (PARTITION BY coid, exec_id ORDER BY ts, seq) = 1 AS fresh FROM r),
 g AS (SELECT *, sum(CASE WHEN fresh THEN qty ELSE 0 END) OVER (PARTITION BY coid ORDER BY rn) AS filled FROM f), h AS (SELECT *, CASE WHEN kind = 'status' THEN st WHEN fresh THEN CASE WHEN filled >= oq THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END END AS tgt FROM g),
 walk AS (SELECT coid, seq, rn, filled, CASE WHEN list_contains(CASE 'PENDING_NEW' {_OK} ELSE [] END, tgt) THEN tgt ELSE 'PENDING_NEW' END AS state FROM h WHERE rn = 0
 UNION ALL SELECT h.coid, h.seq, h.rn, h.filled, CASE WHEN h.tgt IS NOT NULL AND list_contains(CASE p.state {_OK} ELSE [] END, h.tgt) THEN h.tgt ELSE p.state END FROM walk p JOIN h ON h.coid = p.coid AND h.rn = p.rn + 1)
 {sel('coid i, seq i, order_state s, filled f', '(SELECT *, state AS order_state FROM walk)')}""")
def _(t):
    e, typ = events(t), C("event_type")
    st = (F.when(typ == "view", "ACCEPTED").when(typ == "signup", "PENDING_NEW").when(typ == "click", "PENDING_CANCEL").when(typ == "error", F.when(C("event_id") % 9 == 0, "CANCELLED").otherwise("PARTIALLY_FILLED")))
    fill = typ == "purchase"
    d = e.select(C("user_id").alias("coid"), "ts", C("event_id").alias("seq"), F.when(fill, "fill").otherwise("status").alias("kind"), st.alias("state"),
                 F.when(fill, F.concat(F.lit("x"), (C("event_id") % 997).cast("string"))).alias("exec_id"), (1 + C("event_id") % 5).cast("double").alias("qty"), C("value").alias("price"), F.lit(30.0).alias("order_qty"))
    assert NEXT
    return TW.run_available(TW.track_orders(d)).drop("anomaly")


@query("stream_book_fills", "WITH d AS (SELECT event_id % 9000 AS fill_id, event_type AS symbol, arg_min(user_id % 10, ts) AS q FROM events GROUP BY 1, 2) " + sel("symbol s, position i", "(SELECT event_type AS symbol, sum(q) AS position FROM (SELECT event_id // 2 AS fill_id, arg_min(event_type, event_id) AS event_type, arg_min(event_id // 2 % 10, event_id) AS q FROM events GROUP BY 1) GROUP BY 1)").replace("event_type AS symbol, sum(q)", "'book' AS symbol, sum(q)").replace(" GROUP BY 1) GROUP BY 1)", " GROUP BY 1))"))
def _(t):
    # every fill is delivered twice
    f = events(t).select(F.floor(C("event_id") / 2).alias("fill_id"), "ts", F.lit("book").alias("symbol"), (F.floor(C("event_id") / 2) % 10).alias("qty"))
    return TW.run_available(TW.book_fills_once(f, within="31 days"), "complete")


@query("stream_session_signal", """WITH a AS (SELECT event_type AS ticker, CASE WHEN ts::TIME <= TIME '14:30:00' THEN ts::DATE + INTERVAL '14 hours 30 minutes' ELSE ts::DATE + INTERVAL '38 hours 30 minutes' END AS open_at, value - 50 AS s FROM events), g AS (SELECT ticker, open_at, sum(s) AS signal FROM a GROUP BY 1, 2), m AS (SELECT max(ts) AS m FROM events) """ + sel("ticker s, open_at t, signal f", "(SELECT g.* FROM g, m WHERE open_at <= m - INTERVAL 1 hour)"))
def _(t):
    s = events(t).select(C("event_type").alias("ticker"), C("ts").alias("usable_at"), (C("value") - 50).alias("sentiment"))
    return TW.run_available(TW.session_signal(s, "ticker"))
