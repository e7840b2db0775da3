"""Fills, lots, positions, reconciliation, order states and audit trails."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div, session_date
from ..scan import states
from ..series import RN, Series, SeriesSpec, kept, running_in_buckets


# ---------------------------------------------------------------- FIFO lots
def _lots(fills: DataFrame, spec: SeriesSpec, qty="qty") -> DataFrame:
    """Split every fill in a closing and an opening part and place both on cumulative quantity axes per side."""
    d = running_in_buckets(fills, spec, {RN: F.lit(1), "_pos": F.col(qty)}).withColumn(RN, F.col(RN) - 1)
    prev = F.col("_pos") - F.col(qty)
    opposite = (F.signum(prev) * F.signum(qty)) < 0
    close = F.when(opposite, F.least(F.abs(F.col(qty)), F.abs(prev))).otherwise(F.abs(F.col(qty)) * 0)
    d = kept(d.withColumn("_close", close).withColumn("_open", F.abs(F.col(qty)) - F.col("_close")).drop("_pos"))
    up = F.col(qty) > 0
    # a buy opens long lots and closes short ones
    return running_in_buckets(d, spec, {
        "_ol": F.when(up, F.col("_open")), "_os": F.when(~up, F.col("_open")),
        "_cl": F.when(~up, F.col("_close")), "_cs": F.when(up, F.col("_close"))}, [RN]).drop("_tb")


def fifo_match(fills: DataFrame, spec: SeriesSpec, qty="qty", price="price", per_bucket=16) -> DataFrame:
    """Matched lots: (keys, side, open row, close row, qty, open price, close price).

    The k-th share opened on a side is closed by the k-th share closed on it, so lots meet where their intervals on the
    cumulative quantity axis overlap.  Both sides are cut in buckets of that axis (about `per_bucket` fills each): an
    equality join with a residual, whatever the size of a symbol.
    """
    keys = list(spec.keys)
    fills = fills.select(*dict.fromkeys([*keys, "ts", *spec.order, qty, price]))
    width = fills.groupBy(*keys).agg((F.avg(F.abs(F.col(qty))) * per_bucket).cast("double").alias("_w"))
    d = kept(_lots(fills, spec, qty).join(width, keys))
    up = F.col(qty) > 0
    opens = d.where(F.col("_open") > 0).select(
        *keys, "_w", F.when(up, 1).otherwise(-1).alias("side"), F.col(RN).alias("open_rn"), F.col(price).alias("open_price"),
        F.col("ts").alias("open_ts"), (F.when(up, F.col("_ol")).otherwise(F.col("_os")) - F.col("_open")).alias("_a"),
        F.when(up, F.col("_ol")).otherwise(F.col("_os")).alias("_b"))
    closes = d.where(F.col("_close") > 0).select(
        *keys, "_w", F.when(up, -1).otherwise(1).alias("side"), F.col(RN).alias("close_rn"), F.col(price).alias("close_price"),
        F.col("ts").alias("close_ts"), (F.when(up, F.col("_cs")).otherwise(F.col("_cl")) - F.col("_close")).alias("_x"),
        F.when(up, F.col("_cs")).otherwise(F.col("_cl")).alias("_y"))

    def cut(df, lo, hi):
        first, last = F.floor(F.col(lo) / F.col("_w")).cast("bigint"), F.floor(F.col(hi) / F.col("_w")).cast("bigint")
        return df.withColumn("_f", first).withColumn("_k", F.explode(F.sequence(first, last)))
    o = cut(opens, "_a", "_b").withColumnRenamed("_f", "_fo")
    c = cut(closes, "_x", "_y").withColumnRenamed("_f", "_fc").drop("_w")
    j = o.join(c, [*keys, "side", "_k"])
    # a pair that shares several buckets counts in the first shared one
    j = j.where((F.col("_k") == F.greatest("_fo", "_fc")) & (F.col("_a") < F.col("_y")) & (F.col("_x") < F.col("_b")))
    return j.select(*keys, "side", "open_rn", "close_rn", (F.least("_b", "_y") - F.greatest("_a", "_x")).alias("qty"),
                    "open_price", "close_price", "open_ts", "close_ts")


def realized_pnl(fills: DataFrame, spec: SeriesSpec, multiplier=1, tz: str | None = "America/New_York") -> DataFrame:
    """FIFO profit per key and session day of the closing fill, less the fees of the day they were paid."""
    keys = list(spec.keys)
    day = (lambda c: session_date(F.col(c), tz)) if tz else (lambda c: F.to_date(c))
    m = fifo_match(fills, spec)
    gain = m.select(*keys, day("close_ts").alias("day"),
                    ((F.col("close_price") - F.col("open_price")) * F.col("qty") * F.col("side") * multiplier).alias("_v"))
    fee = fills.select(*keys, day("ts").alias("day"), (-F.col("fee")).alias("_v"))
    return gain.unionByName(fee).groupBy(*keys, "day").agg(F.sum("_v").alias("pnl"))


def open_lots(fills: DataFrame, spec: SeriesSpec, qty="qty", price="price") -> DataFrame:
    """What is left of every opening fill after all closes."""
    keys = list(spec.keys)
    d = _lots(fills, spec, qty)
    tot = d.groupBy(*keys).agg(F.max("_cl").alias("_tl"), F.max("_cs").alias("_ts"))
    up = F.col(qty) > 0
    d = d.where(F.col("_open") > 0).join(tot, keys)
    end = F.when(up, F.col("_ol")).otherwise(F.col("_os"))
    closed = F.coalesce(F.when(up, F.col("_tl")).otherwise(F.col("_ts")), F.lit(0))
    left = F.least(end - F.greatest(end - F.col("_open"), closed), F.col("_open"))
    return d.withColumn("_left", left).where(F.col("_left") > 0).select(
        *keys, F.col(RN).alias("open_rn"), (F.col("_left") * F.signum(qty)).alias("qty"), F.col(price).alias("price"))


def positions(lots: DataFrame, marks: DataFrame, keys: list[str], multiplier=1) -> DataFrame:
    """Net quantity, average price and unrealized profit of open lots at a mark."""
    g = lots.groupBy(*keys).agg(F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("price")).alias("_n"))
    return (g.join(marks, keys, "left").withColumn("avg_price", div(F.col("_n"), F.col("qty")))
            .withColumn("unrealized", (F.col("mark") * F.col("qty") - F.col("_n")) * multiplier).drop("_n"))


def positions_from_fills(fills: DataFrame, by: list[str], qty="qty") -> DataFrame:
    return fills.groupBy(*by).agg(F.sum(qty).alias("position"))


def book_once(fills: DataFrame, fill_id: str, symbol: str, qty="qty", arrival="seq") -> tuple[DataFrame, DataFrame]:
    """(positions from the first delivery of every fill, ids delivered again with the number of extra deliveries).

    A delivery without a symbol, a quantity or a time of arrival does not say which comes first for what it lacks.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c)
    g = fills.groupBy(fill_id).agg(first(symbol), first(qty), F.count(F.lit(1)).alias("_n"))
    pos = g.groupBy(symbol).agg(F.sum(qty).alias("position")).where(F.col("position") != 0)
    return pos, g.where(F.col("_n") > 1).select(fill_id, (F.col("_n") - 1).alias("extra"))


def rebuild(events: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot positions and cash plus every later fill, each sequence number once; one row per account and symbol."""
    acct = keys[0]
    last = snapshot.select(acct, "last_seq").distinct()
    new = (events.join(last, acct, "left").where(F.col("seq") > F.coalesce("last_seq", F.lit(-1))).drop("last_seq")
           .dropDuplicates([acct, "seq"]))
    add = new.select(*keys, F.col("qty"), (-F.col("qty") * F.col("price")).alias("cash"), "seq")
    old = snapshot.select(*keys, F.col("qty"), "cash", F.col("last_seq").alias("seq"))
    return add.unionByName(old).groupBy(*keys).agg(F.sum("qty").alias("position"), F.sum("cash").alias("cash"),
                                                   F.max("seq").alias("last_seq"))


def account_equity(fills: DataFrame, marks: DataFrame, spec: SeriesSpec, multiplier=1.0) -> DataFrame:
    """Position, cash and fees after every fill, and equity at the mark of that row (column `mark`)."""
    s = Series.of(fills, spec).running({"position": ("sum", F.col("qty")), "fees": ("sum", F.col("fee")),
                                        "_spent": ("sum", F.col("qty") * F.col("price") * multiplier)})
    d = s.done().join(marks, list(spec.keys), "left")
    cash = -F.col("_spent") - F.col("fees")
    return d.withColumn("cash", cash).withColumn("equity", cash + F.col("position") * F.col("mark") * multiplier).drop("_spent")


def flatten_plan(open_orders: DataFrame, pos: DataFrame) -> DataFrame:
    """Cancel every open order and close every position."""
    a = open_orders.select(F.lit("cancel").alias("action"), F.col("order_id").cast("string").alias("ref"),
                           F.lit(None).cast("double").alias("qty"))
    b = pos.where(F.col("position") != 0).select(F.lit("close").alias("action"), F.col("symbol").cast("string").alias("ref"),
                                                 (-F.col("position")).cast("double").alias("qty"))
    return a.unionByName(b)


# ---------------------------------------------------------------- reconciliation
def reconcile_positions(ours: DataFrame, broker: DataFrame, on: list[str], tol=1e-9) -> DataFrame:
    """Breaks over the union of symbols; a missing side counts as zero."""
    a = ours.select(*on, F.col("position").alias("internal"))
    b = broker.select(*on, F.col("position").alias("broker"))
    j = a.join(b, on, "full").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("internal", "broker")})
    return j.withColumn("diff", F.col("broker") - F.col("internal")).where(F.abs("diff") > tol)


def reconcile_orders(ours: DataFrame, broker: DataFrame, on="order_id") -> DataFrame:
    """Open orders on one side only."""
    a = ours.join(broker, on, "left_anti").select(on, F.lit("unknown_at_broker").alias("kind"))
    b = broker.join(ours, on, "left_anti").select(on, F.lit("orphan_at_broker").alias("kind"))
    return a.unionByName(b)


def reconcile(our_orders: DataFrame, broker_orders: DataFrame, our_pos: DataFrame, broker_pos: DataFrame) -> DataFrame:
    """Every difference between two books with its kind: only_internal, only_broker, qty_mismatch, position_mismatch."""
    o = (our_orders.select("order_id", F.col("qty").alias("ours"))
         .join(broker_orders.select("order_id", F.col("qty").alias("theirs")), "order_id", "full")
         .withColumn("kind", F.when(F.col("theirs").isNull(), "only_internal").when(F.col("ours").isNull(), "only_broker")
                     .when(F.col("ours") != F.col("theirs"), "qty_mismatch")))
    p = reconcile_positions(our_pos, broker_pos, ["symbol"], 0.0)
    return (o.where(F.col("kind").isNotNull()).select(F.col("order_id").cast("string").alias("key"), "kind", "ours", "theirs")
            .unionByName(p.select(F.col("symbol").cast("string").alias("key"), F.lit("position_mismatch").alias("kind"),
                                  F.col("internal").alias("ours"), F.col("broker").alias("theirs"))))


# ---------------------------------------------------------------- order states
STATES = ("PENDING_NEW", "ACCEPTED", "PARTIALLY_FILLED", "FILLED", "PENDING_CANCEL", "CANCELLED", "REJECTED", "EXPIRED")
NEXT = {   # fixed values: allowed moves between order states
    "PENDING_NEW": ("ACCEPTED", "REJECTED", "PARTIALLY_FILLED", "FILLED", "PENDING_CANCEL", "CANCELLED"),
    "ACCEPTED": ("PARTIALLY_FILLED", "FILLED", "PENDING_CANCEL", "CANCELLED", "EXPIRED"),
    "PARTIALLY_FILLED": ("PARTIALLY_FILLED", "FILLED", "PENDING_CANCEL", "CANCELLED", "EXPIRED"),
    "PENDING_CANCEL": ("CANCELLED", "FILLED", "PARTIALLY_FILLED"),
    "FILLED": (), "CANCELLED": (), "REJECTED": (), "EXPIRED": (),
}
VENDOR_A_STATUS = {   # fixed values: broker wording -> canonical state
    "PendingSubmit": "PENDING_NEW", "ApiPending": "PENDING_NEW", "PreSubmitted": "ACCEPTED", "Submitted": "ACCEPTED",
    "Filled": "FILLED", "PendingCancel": "PENDING_CANCEL", "Cancelled": "CANCELLED", "ApiCancelled": "CANCELLED",
    "Inactive": "REJECTED",
}
VENDOR_B_STATUS = {   # fixed values: broker wording -> canonical state
    "pending_new": "PENDING_NEW", "accepted": "PENDING_NEW", "new": "ACCEPTED", "partially_filled": "PARTIALLY_FILLED",
    "partial_fill": "PARTIALLY_FILLED", "filled": "FILLED", "fill": "FILLED", "pending_cancel": "PENDING_CANCEL",
    "canceled": "CANCELLED", "rejected": "REJECTED", "expired": "EXPIRED", "done_for_day": "EXPIRED",
}
CODE_CLASS = {   # fixed values: broker message code -> handling
    1100: "reconnect", 502: "reconnect", 504: "reconnect", 1101: "resubscribe", 1102: "ok", 2104: "ok", 2106: "ok",
    2158: "ok", 326: "fatal", 162: "retry_later",
}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]


def map_status_a(status: Column, filled: Column) -> Column:
    s = _lookup(VENDOR_A_STATUS, status)
    return F.when((s == "ACCEPTED") & (filled > 0), "PARTIALLY_FILLED").otherwise(s)


def map_status_b(status: Column) -> Column:
    return _lookup(VENDOR_B_STATUS, status)


def classify_code(code: Column) -> Column:
    return F.coalesce(_lookup(CODE_CLASS, code), F.lit("log"))


EVENT_SCHEMA = ("broker string, type string, orderRef string, status string, filled double, execId string, shares double, "
                "price string, event string, order struct<client_order_id: string, status: string>, execution_id string, qty string")


def normalize_events(df: DataFrame, raw: str) -> DataFrame:
    """Raw broker JSON to one record: coid, kind, state or exec_id/qty/price, or an `error`."""
    e = df.withColumn("_e", F.from_json(raw, EVENT_SCHEMA))
    x = F.col("_e")
    a, b = x["broker"] == "a", x["broker"] == "b"
    a_stat, a_fill = a & (x["type"] == "orderStatus"), a & (x["type"] == "execDetails")
    b_fill = b & x["event"].isin("fill", "partial_fill")
    state = F.when(a_stat, map_status_a(x["status"], x["filled"])).when(b & ~b_fill, map_status_b(x["event"]))
    fill = a_fill | b_fill
    kind = F.when(fill, "fill").when(a_stat | b, "status")
    error = (F.when(~F.coalesce(a | b, F.lit(False)), "unknown broker").when(kind.isNull(), "unknown type")
             .when(~fill & state.isNull(), "unknown status"))
    return e.select(*df.columns, F.when(a, x["orderRef"]).otherwise(x["order"]["client_order_id"]).alias("coid"), kind.alias("kind"),
                    state.alias("state"), F.when(a_fill, x["execId"]).when(b_fill, x["execution_id"]).alias("exec_id"),
                    F.when(a_fill, x["shares"].cast("decimal(18,6)")).when(b_fill, x["qty"].cast("decimal(18,6)")).alias("qty"),
                    F.when(fill, x["price"].cast("decimal(18,6)")).alias("price"), error.alias("error"))


def replay_orders(events: DataFrame, spec: SeriesSpec, order_qty="order_qty") -> Series:
    """Canonical state after every event of an order, from out-of-order and repeated broker events.

    Needs kind (status/fill), state, exec_id, qty, price.  Fills are the truth: a repeated execution id is ignored, the
    state follows the filled quantity, an impossible move is an anomaly.  Whether a fill completes the order is a running
    sum, so the rest is a finite-state machine and composes over blocks.
    """
    keys = list(spec.keys)
    order = F.struct(*spec.order)
    first = (events.where(F.col("kind") == "fill").groupBy(*keys, "exec_id").agg(F.min(order).alias("_first")))
    e = events.join(first, [*keys, "exec_id"], "left")
    fresh = (F.col("kind") == "fill") & (F.struct(*spec.order) == F.col("_first"))
    e = e.withColumn("_fresh", F.coalesce(fresh, F.lit(False))).drop("_first")
    s = Series.of(e, spec).running({"filled": ("sum", F.when(F.col("_fresh"), F.col("qty")).otherwise(F.col("qty") * 0)),
                                    "notional": ("sum", F.when(F.col("_fresh"), F.col("qty") * F.col("price")))})
    code = {n: i for i, n in enumerate(STATES)}
    want = _lookup(code, F.col("state"))
    full = F.col("filled") >= F.col(order_qty)
    target = F.when(F.col("kind") == "status", want).when(F.col("_fresh"), F.when(full, code["FILLED"]).otherwise(code["PARTIALLY_FILLED"]))
    s = s.add(_to=target)

    def nxt(prev: int) -> Column:
        ok = [code[n] for n in NEXT[STATES[prev]]]
        return F.when(F.col("_to").isin(ok), F.col("_to")).otherwise(F.lit(prev)) if ok else F.lit(prev)
    s = states(s, "_state", tuple(range(len(STATES))), nxt, start=0).halo(1)
    before = F.coalesce(s.lag("_state"), F.lit(0))
    s = s.add(_before=before)
    b, to = F.col("_before"), F.col("_to")
    moved = F.col("_state") == to
    status_bad = (F.col("kind") == "status") & to.isNotNull() & (to != b) & ~moved
    status_bad = status_bad | ((F.col("kind") == "status") & (to == b) & (b == code["PARTIALLY_FILLED"]) & F.lit(False))
    late = F.col("_fresh") & (b != code["FILLED"]) & ~(moved & (b.isin([code[n] for n in STATES if NEXT[n]])))
    over = F.col("_fresh") & (F.col("filled") > F.col(order_qty))
    names = F.array(*[F.lit(n) for n in STATES])
    return s.flat().add(order_state=names[F.col("_state")], anomalies=F.array_compact(F.array(
        F.when(over, "overfill"), F.when(late, "fill after terminal"),
        F.when(status_bad, F.concat(F.lit("illegal transition "), names[b], F.lit("->"), names[to]))))).drop(
            "_state", "_before", "_to", "_fresh")


def order_summary(s: Series) -> DataFrame:
    """Last state, filled quantity, average price and anomaly count per order."""
    return s.flat().df.groupBy(*s.keys).agg(
        F.max_by("order_state", RN).alias("state"), F.max_by("filled", RN).alias("filled"),
        F.round(F.try_divide(F.max_by("notional", RN), F.max_by("filled", RN)), 4).alias("avg_price"),
        F.sum(F.size("anomalies")).alias("anomalies"))


def illegal_moves(states_df: DataFrame, spec: SeriesSpec, state="state") -> DataFrame:
    """Consecutive state pairs that are not in the table of allowed moves."""
    s = Series.of(states_df, spec, back=1)
    d = s.add(_from=s.lag(state)).done().where(F.col("_from").isNotNull())
    allowed = d.sparkSession.createDataFrame([(a, b) for a, bs in NEXT.items() for b in bs], "_from string, _to string")
    # the table of moves is fixed and has fewer than 30 rows
    return (d.join(F.broadcast(allowed), (d["_from"] == allowed["_from"]) & (d[state] == allowed["_to"]), "left_anti")
            .withColumnRenamed("_from", "previous"))


# ---------------------------------------------------------------- audit
def canonical_record(*cols: str) -> Column:
    """JSON with sorted keys of the named columns."""
    return F.to_json(F.struct(*sorted(cols)))


def audit_breaks(records: DataFrame, spec: SeriesSpec, body: Column, genesis="0" * 64) -> DataFrame:
    """Records of a hash chain whose link or hash is wrong; the first one per chain is the break."""
    s = Series.of(records, spec, back=1)
    link = F.coalesce(s.lag("hash"), F.lit(genesis))
    d = s.add(_link=link).done(keep_rn=True)
    bad = d.where((F.col("prev") != F.col("_link")) | (F.sha2(body, 256) != F.col("hash")))
    return bad.groupBy(*spec.keys).agg(F.min(RN).alias("first_broken"), F.count(F.lit(1)).alias("n_broken"))


def orders_without_approval(records: DataFrame) -> DataFrame:
    """Orders with no earlier approved risk decision (columns event, order_id, approved, seq)."""
    g = records.groupBy("order_id").agg(
        F.min(F.when((F.col("event") == "risk_decision") & F.col("approved"), F.col("seq"))).alias("_ok"),
        F.min(F.when(F.col("event") == "order", F.col("seq"))).alias("order_seq"))
    return g.where(F.col("order_seq").isNotNull() & (F.col("_ok").isNull() | (F.col("_ok") > F.col("order_seq")))).select(
        "order_id", "order_seq")


def approval_violations(log: DataFrame) -> DataFrame:
    """Approval log audit: self-approval, and decisions on items already decided."""
    w = Window.partitionBy("item").orderBy("seq")
    d = log.where(F.col("event") == "decision").withColumn("_n", F.row_number().over(w))
    req = log.where(F.col("event") == "request").groupBy("item").agg(F.min_by("actor", "seq").alias("requester"))
    d = d.join(req, "item", "left")
    why = (F.when(F.col("requester").isNull(), "no request").when(F.col("_n") > 1, "already decided")
           .when(F.col("actor") == F.col("requester"), "four eyes"))
    return d.withColumn("violation", why).where(F.col("violation").isNotNull()).select("item", "seq", "violation")


PHASES = ("detected", "contained", "diagnosed", "recovered", "reconciled", "closed")
SLA_MINUTES = {   # fixed values: (severity, phase) -> minutes after detection
    ("sev1", "contained"): 5, ("sev1", "reconciled"): 60, ("sev2", "contained"): 30, ("sev2", "reconciled"): 240,
    ("sev3", "contained"): 240, ("sev3", "reconciled"): 1440,
}


def sla_breaches(events: DataFrame) -> DataFrame:
    """Phases reached later than their target (columns incident, severity, phase, at)."""
    sla = events.sparkSession.createDataFrame([(s, p, m) for (s, p), m in SLA_MINUTES.items()],
                                              "severity string, phase string, minutes int")
    t0 = events.where(F.col("phase") == "detected").groupBy("incident").agg(F.min("at").alias("_t0"))
    d = events.join(F.broadcast(sla), ["severity", "phase"]).join(t0, "incident")
    late = (F.unix_micros("at") - F.unix_micros("_t0")) / 6e7
    return d.withColumn("took", late).where(F.col("took") > F.col("minutes")).select("incident", "phase", "took")


def phase_violations(events: DataFrame) -> DataFrame:
    """Steps that skip a phase or go back in time."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    w = Window.partitionBy("incident").orderBy("seq")
    d = events.withColumn("_r", rank).withColumns({"_pr": F.lag("_r").over(w), "_pt": F.lag("at").over(w)})
    why = (F.when(F.coalesce("_pr", F.lit(0)) + 1 != F.col("_r"), "wrong phase").when(F.col("at") < F.col("_pt"), "time goes back"))
    return d.withColumn("violation", why).where(F.col("violation").isNotNull()).select("incident", "seq", "violation")
