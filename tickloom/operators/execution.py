"""Order books, schedules, shortfall, payoffs and order replay over recorded quotes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div, limit_price
from ..joins import first_match
from ..series import RN, Series, SeriesSpec, col


def walk_the_book(levels: DataFrame, book: str, qty: str, price="price", size="size", mid="mid") -> DataFrame:
    """Average fill and cost of sweeping each book from the best level; `complete` is false when the book is too thin."""
    w = Window.partitionBy(book).orderBy(price).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    take = F.greatest(F.least(F.col(size), F.col(qty) - before), F.lit(0))
    d = levels.withColumn("_t", take)
    g = d.groupBy(book).agg(div(F.sum(F.col("_t") * F.col(price)), F.sum("_t")).alias("avg_price"), F.sum("_t").alias("filled"),
                            F.first(mid).alias("_mid"), F.first(qty).alias("_q"))
    return g.select(book, "avg_price", ((F.col("avg_price") / F.col("_mid") - 1) * 1e4).alias("cost_bps"), "filled",
                    (F.col("filled") >= F.col("_q")).alias("complete"))


def best_bid_ask(book: DataFrame, by: list[str], side="side", price="price", size="size") -> DataFrame:
    live = F.col(size) > 0
    return book.groupBy(*by).agg(F.max(F.when(live & (F.col(side) == "bid"), F.col(price))).alias("bid"),
                                 F.min(F.when(live & (F.col(side) == "ask"), F.col(price))).alias("ask"))


def payoff_grid(legs: DataFrame, by: list[str], lo: float, hi: float, steps: int, multiplier=1.0) -> DataFrame:
    """Profit at expiry of multi-leg strategies on a price grid (kind call/put/stock, qty, strike, premium)."""
    g = legs.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("price", lo + (hi - lo) * F.col("_i") / steps)
    zero = F.lit(0.0)
    val = (F.when(F.col("kind") == "call", F.greatest(F.col("price") - F.col("strike"), zero) - F.col("premium"))
           .when(F.col("kind") == "put", F.greatest(F.col("strike") - F.col("price"), zero) - F.col("premium"))
           .when(F.col("kind") == "stock", F.col("price") - F.col("premium")))
    return g.groupBy(*by, "_i", "price").agg((F.sum(F.col("qty") * val) * multiplier).alias("pnl"))


def breakevens(grid: DataFrame, by: list[str]) -> DataFrame:
    """Zero crossings of a payoff grid by linear interpolation."""
    w = Window.partitionBy(*by).orderBy("_i")
    d = grid.withColumns({"_p0": F.lag("price").over(w), "_a": F.lag("pnl").over(w)})
    hit = F.when(F.col("_a") == 0, F.col("_p0")).when(
        F.col("_a") * F.col("pnl") < 0, F.col("_p0") + (F.col("price") - F.col("_p0")) * -F.col("_a") / (F.col("pnl") - F.col("_a")))
    return d.withColumn("breakeven", hit).where(F.col("breakeven").isNotNull()).select(*by, "breakeven")


# ---------------------------------------------------------------- schedules
def twap_size(qty: str, slices: int, slice="slice") -> Column:
    """Shares of one slice of an equal split, the remainder one each to the first slices."""
    base = F.floor(F.col(qty) / slices)
    return (base + (F.col(slice) < F.col(qty) - base * slices).cast("int")).cast("bigint")


def twap(orders: DataFrame, qty: str, slices: int, start: str, end: str) -> DataFrame:
    """Equal integer slices, the remainder one share each to the first slices."""
    d = orders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    at = F.unix_micros(start) + ((F.unix_micros(end) - F.unix_micros(start)) * F.col("slice") / slices).cast("bigint")
    return d.withColumn("at", F.timestamp_micros(at)).withColumn("child", twap_size(qty, slices))


def pov(session: DataFrame, spec: SeriesSpec, qty: str, volume: str, participation=0.1) -> DataFrame:
    """Child of a minute = floor(p x volume of the minute before), until the order is done (capped running sum)."""
    s = Series.of(session, spec, back=1)
    s = s.add(_want=F.coalesce(F.floor(participation * s.lag(volume)), F.lit(0))).running({"_cum": ("sum", F.col("_want"))})
    done = F.least(F.col("_cum"), F.col(qty))
    before = F.least(F.col("_cum") - F.col("_want"), F.col(qty))
    return s.add(child=(done - before).cast("bigint")).drop("_want", "_cum").done()


def almgren_chriss(orders: DataFrame, n: int, qty="qty", sigma="sigma", eta="eta", gamma="gamma", lam="lam") -> DataFrame:
    """Child sizes of the sinh profile; a vanishing urgency gives equal slices."""
    d = orders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    adj = F.col(eta) - F.col(gamma) / 2
    k = F.acosh(1 + F.col(lam) * F.col(sigma) * F.col(sigma) / adj / 2)

    def left(j):
        return F.col(qty) * F.sinh(k * (n - j)) / F.sinh(k * n)
    j = F.col("slice")
    return d.withColumn("child", F.when(k < 1e-9, F.col(qty) / n).otherwise(left(j) - left(j + 1)))


def cost_moments(schedules: DataFrame, by: list[str], sigma="sigma", eta="eta", gamma="gamma", child="child") -> DataFrame:
    """Mean and variance of the cost of a schedule (permanent and temporary impact, price risk of what remains).

    One row per schedule; `child` is the array of its sizes in slice order, so nothing is sorted or exchanged."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("sum"), zero.alias("squares"), zero.alias("risk"), F.lit(0).alias("n"))

    def add(a, c):                                            # from the last slice on: `sum` is what is left after this one
        x = F.coalesce(c, zero)
        return F.struct((a["sum"] + x).alias("sum"), (a["squares"] + x * x).alias("squares"),
                        (a["risk"] + a["sum"] * a["sum"]).alias("risk"), (a["n"] + c.isNotNull().cast("int")).alias("n"))
    d = schedules.withColumn("_a", F.aggregate(F.reverse(child), start, add))
    tot = F.col("_a.sum")
    mean = F.col(gamma) / 2 * tot * tot + (F.col(eta) - F.col(gamma) / 2) * F.col("_a.squares")
    return d.select(*by, F.when(F.col("_a.n") > 0, mean).alias("mean"), (F.col(sigma) * F.col(sigma) * F.col("_a.risk")).alias("variance"))


def execute_schedule(children: DataFrame, session: DataFrame, on: list[str], side: str, eta=0.02) -> DataFrame:
    """Fill every child at its minute's price moved by temporary impact."""
    sign = F.when(F.col(side) == "BUY", 1).otherwise(-1)
    j = children.where(F.col("child") > 0).join(session, on)
    return j.withColumn("fill_price", F.col("price") * (1 + sign * eta * F.col("child") / F.col("volume")))


def shortfall_bps(fills: DataFrame, by: list[str], side: str, decision: str, price="price", qty="qty", fees: Column | None = None) -> DataFrame:
    """Cost of the fills against the decision price, in basis points."""
    q = F.sum(qty)
    sign = F.first(F.when(F.col(side) == "BUY", 1).otherwise(-1))
    dec = F.first(decision)
    fee = F.sum(fees) if fees is not None else F.lit(0.0)
    avg = F.sum(col(price) * col(qty)) / q
    return fills.groupBy(*by).agg((1e4 * (sign * (avg - dec) * q + fee) / (dec * q)).alias("shortfall_bps"), avg.alias("avg_price"), q.alias("filled"))


def replay_chase(orders: DataFrame, quotes: DataFrame, on: list[str], schedule=(0.0, 0.33, 0.67, 1.0), wait=5, tick="0.01", markout=30) -> DataFrame:
    """First second in which a repriced limit order would have filled on recorded quotes.

    Orders have side and start (a row number of the quote path); every step of the schedule looks at the next `wait`
    rows.  All orders and steps are one equality join on the row number with the quotes, then one aggregate.
    """
    q = quotes.select(*on, F.col(RN).alias("_s"), "bid", "ask", "trade", ((F.col("bid") + F.col("ask")) / 2).alias("mid"))
    last = q.groupBy(*on).agg(F.max("_s").alias("_last"))
    o = orders.join(last, on).withColumn("_t0", F.col("start"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(a)).alias("aggr")) for i, a in enumerate(schedule)]))
    o = o.withColumn("_st", steps).withColumns({"k": F.col("_st.k"), "aggr": F.col("_st.aggr")}).drop("_st")
    o = o.withColumn("_t", F.least(F.col("start") + F.col("k") * wait, F.col("_last")))
    at = q.select(*on, F.col("_s").alias("_t"), F.col("bid").alias("b0"), F.col("ask").alias("a0"))
    o = o.join(at, [*on, "_t"]).withColumn("limit", limit_price("side", "b0", "a0", tick, F.col("aggr")).cast("double"))
    look = o.withColumn("_s", F.explode(F.sequence(F.col("_t") + 1, F.greatest(F.least(F.col("_t") + wait, F.col("_last")), F.col("_t") + 1))))
    j = look.join(q, [*on, "_s"])
    buy = F.col("side") == "BUY"
    hit = F.when(buy, (F.col("ask") <= F.col("limit")) | (F.col("trade") <= F.col("limit"))).otherwise(
        (F.col("bid") >= F.col("limit")) | (F.col("trade") >= F.col("limit")))
    first = first_match(j.where(hit).select("order_id", "k", "_s", "aggr", "limit"), ["order_id"], ["k", "_s"])
    base = orders.join(last, on)
    arrive = q.select(*on, F.col("_s").alias("start"), F.col("mid").alias("mid0"))
    end = q.select(*on, F.col("_s").alias("_e"), F.when(F.lit(True), F.col("bid")).alias("eb"), F.col("ask").alias("ea"))
    d = base.join(arrive, [*on, "start"]).join(first, "order_id", "left")
    d = d.withColumn("_e", F.least(F.col("start") + wait * len(schedule), F.col("_last"))).join(end, [*on, "_e"])
    later = q.select(*on, F.col("_s").alias("_m"), F.col("mid").alias("mid_later"))
    d = d.withColumn("_m", F.least(F.col("_s") + markout, F.col("_last"))).join(later, [*on, "_m"], "left")
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    # a move from a price of zero has no size in basis points: NULL
    moved = lambda to, base: sign * div(col(to) - F.col(base), base) * 1e4
    cost = moved("limit", "mid0")
    cross = F.when(F.col("side") == "BUY", F.col("ea")).otherwise(F.col("eb"))
    filled = F.col("limit").isNotNull()
    return d.select("order_id", *on, "side", filled.alias("filled"), F.col("limit").alias("price"),
                    F.when(filled, F.col("_s") - F.col("start")).otherwise(F.col("_e") - F.col("start")).alias("seconds"), "aggr",
                    cost.alias("cost_bps"), moved("mid_later", "limit").alias("markout_bps"),
                    F.when(filled, cost).otherwise(moved(cross, "mid0")).alias("all_in_bps"))


def chase_report(chases: DataFrame, by: list[str]) -> DataFrame:
    f = F.col("filled")
    return chases.groupBy(*by).agg(F.avg(f.cast("double")).alias("fill_rate"), F.avg(F.when(f, F.col("seconds"))).alias("avg_seconds"),
                                   F.avg("cost_bps").alias("avg_cost_bps"), F.avg("markout_bps").alias("avg_markout_bps"),
                                   F.avg("all_in_bps").alias("avg_all_in_bps"))


URGENCY = {   # fixed values: signal type -> aggressiveness steps
    "stop": (1.0,), "exit": (0.5, 1.0), "entry": (0.0, 0.33, 0.67, 1.0), "rebalance": (0.0, 0.0, 0.33, 0.67, 1.0),
}


def urgency_schedule(signal_type: Column) -> Column:
    m = F.create_map(*[x for k, v in URGENCY.items() for x in (F.lit(k), F.array(*[F.lit(float(a)) for a in v]))])
    return F.coalesce(m[signal_type], m[F.lit("rebalance")])


def combo_prices(legs: DataFrame, by: list[str], qty="qty", bid="bid", ask="ask") -> DataFrame:
    """Mid, natural and crossing cost of option combinations (positive quantity = bought)."""
    mid = F.sum(col(qty) * (col(bid) + col(ask)) / 2)
    natural = F.sum(F.when(col(qty) > 0, col(qty) * col(ask)).otherwise(col(qty) * col(bid)))
    return legs.groupBy(*by).agg(mid.alias("mid"), natural.alias("natural"), (natural - mid).alias("leg_cost"))


def select_structure(direction, ivr, term_slope, event=None, implied_move=None, expected_move=None) -> Column:
    """Option structure from direction, volatility rank and term slope."""
    d, r = col(direction), col(ivr)

    def tier(a, b, c):
        return F.when(r < 30, a).when(r < 70, b).otherwise(c)
    out = F.when(d > 0, tier("long_call", "bull_call_spread", "bull_put_spread")).when(
        d < 0, tier("long_put", "bear_put_spread", "bear_call_spread")).when(r >= 50, "iron_condor").when(
        col(term_slope) > 0, "calendar").otherwise("no_trade")
    if event is None:
        return out
    cheap = F.coalesce(col(event) & (col(implied_move) < col(expected_move)), F.lit(False))
    return F.when(cheap, "long_straddle").otherwise(out)
