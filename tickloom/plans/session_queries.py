"""Audit chains, calendar and time-of-day operators, partitioned files."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chains as H
from ..operators import sessions as S
from ..series import RN, SeriesSpec
from ..session import shared_folder
from ..sources import market as M
from .base import BARS_SQL, TRADES_SQL, query, sel
from .indicator_queries import bars

C, L = F.col, F.lit


# ---------------------------------------------------------------- hash chains
@query("audit_chain", f"""WITH RECURSIVE c AS (SELECT conv_id, turn, turn || '|' || role || '|' || text AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
 w AS (SELECT conv_id, turn, i, body, '{H.START}' AS prev, sha256('{H.START}' || '|' || body) AS h FROM c WHERE i = 0
 UNION ALL SELECT c.conv_id, c.turn, c.i, c.body, w.h, sha256(w.h || '|' || c.body) FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i + 1),
 x AS (SELECT conv_id, i, h, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN upper(body) ELSE body END AS body, CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN '{H.START}' ELSE prev END AS prev FROM w),
 k AS (SELECT *, prev = CASE WHEN i = 0 THEN '{H.START}' ELSE lag(h) OVER (PARTITION BY conv_id ORDER BY i) END AND sha256(prev || '|' || body) = h AS ok FROM x)
 {sel('conv_id i, records i, first_broken i', '(SELECT conv_id, count(*) AS records, coalesce(min(i) FILTER (NOT ok), -1) AS first_broken FROM k GROUP BY 1)')}""")
def _(t):
    """Conversations as audit chains; some bodies and links are altered after sealing and must be found."""
    d = H.sealed(t.conversations, ["conv_id"], "turn", F.concat_ws("|", C("turn"), C("role"), C("text")))
    d = d.withColumn("body", F.when((C("conv_id") % 5 == 0) & (C("turn") == 1), F.upper("body")).otherwise(C("body")))
    d = d.withColumn("prev", F.when((C("conv_id") % 7 == 0) & (C("turn") == 2), L(H.START)).otherwise(C("prev")))
    return H.verify(d, SeriesSpec(("conv_id",), ("turn",), "turn div 65536"))


# ---------------------------------------------------------------- calendar
@query("bar_strength", f"WITH {BARS_SQL} {sel('symbol s, ts t, ibs f', '(SELECT symbol, ts, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS ibs FROM b)')}")
def _(t):
    return t.bars().select("symbol", "ts", S.bar_strength().alias("ibs"))


_WORK = "len(list_filter(range({a}::TIMESTAMP, {b}::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6))"


@query("turn_of_month", f"""WITH {BARS_SQL} {sel('symbol s, ts t, turn b', f'''(SELECT symbol, ts, {_WORK.format(a="(ts::DATE + 1)", b="(last_day(ts::DATE) + 1)")} < 1
 OR {_WORK.format(a="date_trunc('month', ts)", b="ts::DATE")} < 3 AS turn FROM b)''')}""")
def _(t):
    return t.bars().select("symbol", "ts", S.turn_of_month(F.to_date("ts")).alias("turn"))


# ---------------------------------------------------------------- time of day
@query("time_price_profile", f"""WITH {TRADES_SQL}, p AS (SELECT symbol, ts::DATE AS date, floor(price / 5)::BIGINT AS bin, count(DISTINCT hour(ts) * 2 + minute(ts) // 30) AS periods FROM trades WHERE price IS NOT NULL GROUP BY 1, 2, 3),
 r AS (SELECT *, coalesce(sum(periods) OVER (PARTITION BY symbol, date ORDER BY periods DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(periods) OVER (PARTITION BY symbol, date) AS total FROM p)
 {sel('symbol s, date d, bins i, point i, value_low i, value_high i', '(SELECT symbol, date, count(*) AS bins, arg_max(bin, (periods, -bin)) AS point, min(bin) FILTER (before < 0.7::DOUBLE * total) AS value_low, max(bin) FILTER (before < 0.7::DOUBLE * total) AS value_high FROM r GROUP BY 1, 2)')}""")
def _(t):
    return S.profile_levels(S.time_price_profile(t.trades(), ["symbol"], "ts", "price", 5.0), ["symbol"])


@query("relative_volume", f"""WITH {TRADES_SQL}, d AS (SELECT symbol, ts::DATE AS date, hour(ts) * 2 + minute(ts) // 30 AS slot, sum(size) AS volume FROM trades GROUP BY 1, 2, 3)
 {sel('symbol s, date d, slot i, volume i, ratio f', '(SELECT *, volume / avg(volume) OVER (PARTITION BY symbol, slot ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ratio FROM d)')}""")
def _(t):
    return S.relative_volume(t.trades(), ["symbol"], "ts", "size")


# ---------------------------------------------------------------- what a splitter leaks
_R2 = f"""WITH {BARS_SQL}, y AS (SELECT symbol, rn, sum(ln(close / open)) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS y, count(*) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS m FROM b),
 z AS (SELECT symbol, rn, y, row_number() OVER (PARTITION BY symbol ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM y WHERE m = 20),
 f AS (SELECT *, 'shuffled' AS splitter, 0 AS gap, (rn * 7919 % 101) % 5 AS fold FROM z UNION ALL SELECT *, 'blocks', 0, rn // 300 FROM z UNION ALL SELECT *, 'purged blocks', 20, rn // 300 FROM z),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY symbol, splitter, fold ORDER BY i) AS run FROM f),
 e AS (SELECT *, min(i) OVER (PARTITION BY symbol, splitter, fold, run) - 1 - gap AS l, max(i) OVER (PARTITION BY symbol, splitter, fold, run) + 1 + gap AS r FROM g),
 p AS (SELECT e.symbol, e.splitter, e.y, CASE WHEN a.y IS NULL THEN c.y WHEN c.y IS NULL OR e.i - e.l <= e.r - e.i THEN a.y ELSE c.y END AS hat FROM e LEFT JOIN z a ON a.symbol = e.symbol AND a.i = e.l LEFT JOIN z c ON c.symbol = e.symbol AND c.i = e.r)
 {sel('symbol s, splitter s, n i, r2 f', '(SELECT symbol, splitter, count(*) AS n, 1 - sum((y - hat) * (y - hat)) / (var_pop(y) * count(*)) AS r2 FROM p WHERE hat IS NOT NULL GROUP BY 1, 2)')}"""


@query("nearest_row_r2", _R2)
def _(t):
    """R2 of the nearest-row model on 20-bar labels under a shuffled, a block and a purged block splitter."""
    s = bars(t, 0, 20)
    s = s.add(_r=F.log(C("close") / C("open")))
    w = s.rows(1, 20)
    s = s.add(y=F.when(F.count("_r").over(w) == 20, F.sum("_r").over(w)))
    out = None
    for name, fold, gap in (("shuffled", (C(RN) * 7919 % 101) % 5, 0), ("blocks", F.expr(f"{RN} div 300"), 0), ("purged blocks", F.expr(f"{RN} div 300"), 20)):
        r = S.nearest_row_r2(s, "y", fold, gap).withColumn("splitter", L(name))
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------- files
def _folder(t) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("partitioned_round_trip", f"WITH {TRADES_SQL} {sel('symbol s, date d, n i, high f, low f, volume i', '''(SELECT symbol, ts::DATE AS date, count(*) AS n, max(price) AS high, min(price) AS low, sum(size) * CASE WHEN symbol = 'click' THEN 2 ELSE 1 END AS volume FROM trades GROUP BY 1, 2)''')}")
def _(t):
    """Trades written by symbol and day; one symbol is then written again with sizes doubled, which leaves the others alone."""
    root, d = _folder(t), t.trades().select("symbol", "ts", "price", "size")
    M.write_partitioned(d, root)
    M.write_partitioned(d.where("symbol = 'click'").withColumn("size", C("size") * 2), root, mode="overwrite")
    r = M.read_partitioned(t.spark, root, d.schema)
    return r.groupBy("symbol", "date").agg(F.count(L(1)).alias("n"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("size").alias("volume"))


@query("sma_lazy", f"WITH {TRADES_SQL}, r AS (SELECT *, row_number() OVER w AS i, avg(price) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM trades WHERE symbol <> 'view' WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) {sel('symbol s, seq i, sma10 f', '(SELECT symbol, seq, CASE WHEN i >= 10 THEN m END AS sma10 FROM r)')}")
def _(t):
    """Mean of the last ten prices over a pruned scan of partitioned files."""
    root, d = _folder(t), t.trades().select("symbol", "ts", "seq", "price")
    M.write_partitioned(d, root)
    r = M.read_partitioned(t.spark, root, d.schema, "symbol <> 'view'").withColumnRenamed("price", "close")
    return M.sma_scan(r, 10, SeriesSpec(("symbol",), ("ts", "seq"))).select("symbol", "seq", "sma10")


@query("read_ticks", f"WITH {TRADES_SQL} {sel('date d, n i, volume f, high f', '(SELECT ts::DATE AS date, count(*) AS n, sum(size) AS volume, max(price) AS high FROM trades GROUP BY 1)')}")
def _(t):
    """Ticks through CSV files with times that carry an offset."""
    root = _folder(t)
    t.trades().select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), "price", C("size").cast("double").alias("size")).write.option("header", True).csv(root)
    return M.read_ticks(t.spark, root).groupBy(F.to_date("ts").alias("date")).agg(F.count(L(1)).alias("n"), F.sum("size").alias("volume"), F.max("price").alias("high"))
