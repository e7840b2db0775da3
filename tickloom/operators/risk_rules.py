"""Screens, pre-trade checks and risk limits as Column rules over order tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import col


# ---------------------------------------------------------------- universe screens
def min_adv(usd: float, c="adv_usd") -> Column:
    return col(c) >= usd


def price_between(lo: float, hi: float, c="price") -> Column:
    return col(c).between(lo, hi)


def max_spread(bps: float, c="spread_bps") -> Column:
    return col(c) <= bps


def sector_in(sectors, c="sector") -> Column:
    return col(c).isin(list(sectors))


def min_option_oi(oi: int, c="option_oi") -> Column:
    return col(c) >= oi


def shortable(c="shortable") -> Column:
    return F.coalesce(col(c).cast("boolean"), F.lit(False))


def screen(df: DataFrame, filters: list[Column], limit: int | None = None, adv="adv_usd", symbol="symbol") -> DataFrame:
    """All filters, largest traded value first; the limit is the top of that order."""
    d = df.where(reduce(lambda a, b: a & b, filters, F.lit(True))).orderBy(F.col(adv).desc(), symbol)
    return d if limit is None else d.limit(limit)


def liquidity_filter(chain: DataFrame, max_spread_pct=0.10, min_oi=0) -> DataFrame:
    c = chain.withColumn("spread_pct", F.try_divide(F.col("ask") - F.col("bid"), F.col("mid")))
    keep = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (F.col("spread_pct") <= max_spread_pct)
    if "oi" in chain.columns:
        keep = keep & (F.col("oi") >= min_oi)
    return c.where(keep)


def should_alert(relevance="relevance", sentiment="sentiment") -> Column:
    return (col(relevance) > 0.8) & (F.abs(col(sentiment)) > 0.6)


# ---------------------------------------------------------------- order checks
def pretrade_reason(fat_finger_pct=5.0, max_qty=1000.0) -> Column:
    """First failing check of an order joined with its context; NULL when it may go.

    Needs kill_switch, tradable, session_open, extended_hours, last, limit_price, qty, side, buying_power, position,
    can_short.
    """
    c = F.col
    ref = F.coalesce(c("limit_price"), c("last"))
    return (F.when(c("kill_switch"), "kill switch tripped")
            .when(~F.coalesce(c("tradable"), F.lit(False)), "not tradable")
            .when(~c("session_open") & ~c("extended_hours"), "session closed")
            .when(c("last").isNull(), "no last price")
            .when(c("limit_price").isNotNull() & (F.abs(c("limit_price") - c("last")) / c("last") * 100 > fat_finger_pct), "fat finger")
            .when(c("qty") > max_qty, "qty above max")
            .when((c("side") == "BUY") & (c("qty") * ref > c("buying_power")), "insufficient buying power")
            .when((c("side") == "SELL") & (F.coalesce(c("position"), F.lit(0.0)) - c("qty") < 0)
                  & ~F.coalesce(c("can_short"), F.lit(False)), "not shortable"))


def precautionary(max_qty: float, max_notional: float, band_pct: float, qty="qty", price="price", last="last") -> Column:
    q, p = F.abs(col(qty)), col(price)
    return F.array_compact(F.array(F.when(q > max_qty, "size"), F.when(q * p > max_notional, "notional"),
                                   F.when(F.abs(p / col(last) - 1) > band_pct, "price_band")))


def needs_approval(max_notional: float, qty="qty", price="price") -> Column:
    return F.abs(col(qty)) * col(price) > max_notional


def fat_tail_error(pnl, sigma, k=5.0) -> Column:
    return F.abs(col(pnl)) > k * col(sigma)


def _pct(x: Column, digits=1) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def max_notional(limit: float) -> tuple[str, Column, Column]:
    n = F.abs(F.col("qty") * F.col("price"))
    return "MaxNotional", n <= limit, F.concat(F.lit("notional "), F.format_number(n, 0), F.lit(f" > {limit:,.0f}"))


def max_gross(leverage: float) -> tuple[str, Column, Column]:
    g = F.col("gross") + F.abs(F.col("qty") * F.col("price"))
    return ("MaxGrossExposure", g <= leverage * F.col("equity"),
            F.concat(F.lit("gross "), F.format_number(g / F.col("equity"), 2), F.lit(f"x > {leverage}x")))


def max_weight(limit: float) -> tuple[str, Column, Column]:
    w = F.abs(F.coalesce(F.col("position_value"), F.lit(0.0)) + F.col("qty") * F.col("price")) / F.col("equity")
    return ("MaxPositionWeight", w <= limit,
            F.concat(F.col("symbol").cast("string"), F.lit(" weight "), _pct(w), F.lit(f" > {limit:.1%}")))


def max_sector(limit: float) -> tuple[str, Column, Column]:
    w = F.abs(F.coalesce(F.col("sector_exposure"), F.lit(0.0)) + F.col("qty") * F.col("price")) / F.col("equity")
    return ("MaxSectorExposure", F.col("sector").isNull() | (w <= limit),
            F.concat(F.lit("sector "), F.col("sector").cast("string"), F.lit(" "), _pct(w), F.lit(f" > {limit:.1%}")))


def max_adv(limit: float = 0.1) -> tuple[str, Column, Column]:
    f = F.abs(F.col("qty")) / F.col("adv")
    return ("MaxADVParticipation", f <= limit,
            F.concat(F.lit("qty "), F.format_number(F.abs(F.col("qty")), 0), F.lit(" is "), _pct(f), F.lit(f" of ADV > {limit:.1%}")))


def daily_loss(limit: float) -> tuple[str, Column, Column]:
    d = F.col("day_pnl") / F.col("start_equity")
    return "DailyLossLimit", d > -limit, F.concat(F.lit("daily loss "), _pct(d, 2), F.lit(f" breaches {-limit:.2%}"))


def max_position(limit: float) -> tuple[str, Column, Column]:
    p = F.coalesce(F.col("position"), F.lit(0.0)) + F.col("qty")
    return "MaxPosition", F.abs(p) <= limit, F.concat(F.lit("position "), F.format_number(p, 0), F.lit(f" > {limit:,.0f}"))


def risk_engine(orders: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """First rejecting rule wins; adds approved and reason.  The rejection log is a filter of the result."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{n}: "), F.coalesce(why, F.lit("no data"))))
                          for n, ok, why in rules])
    return orders.withColumn("reason", reason).withColumn("approved", F.col("reason").isNull())


SEVERITY = {"critical": 0, "warning": 1, "info": 2}    # fixed values: order of alert severities


def evaluate_alerts(state: DataFrame, by: list[str], rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Fired rules per state row, most severe first, then by name."""
    fired = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(
        F.lit(SEVERITY[sev]).alias("rank"), F.lit(name).alias("rule"), F.lit(sev).alias("severity"))) for name, cond, sev in rules]))
    return state.select(*by, F.posexplode(F.array_sort(fired)).alias("pos", "_f")).select(*by, "pos", "_f.rule", "_f.severity")


def option_action(tp=0.5, stop=2.0, roll_dte=21, max_delta=0.30) -> Column:
    """Management rule of a short-premium position, in priority order; NULL means hold.

    Needs value, credit, dte, short_call_itm, days_to_exdiv, short_deltas (array).
    """
    c = F.col
    return (F.when(c("value") >= c("credit") * (1 + stop), "close:stop")
            .when(c("value") <= c("credit") * (1 - tp), "close:take_profit")
            .when(c("dte") == 0, "close:expiry")
            .when(c("short_call_itm") & (c("days_to_exdiv") <= 1), "close:ex_dividend")
            .when(F.exists("short_deltas", lambda d: F.abs(d) > max_delta), "adjust:short_delta")
            .when(c("dte") <= roll_dte, "roll:dte"))
