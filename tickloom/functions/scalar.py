"""Scalar market functions as Column expressions: money, ticks, sessions, symbols, fills, sizing."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import normal_cdf

MONEY = "decimal(18,6)"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def div(a, b, fallback=None) -> Column:
    """a / b, `fallback` where b is zero or NULL-safe division fails."""
    return F.coalesce(F.try_divide(c(a), c(b)), F.lit(fallback)) if fallback is not None else F.try_divide(c(a), c(b))


def ln(a) -> Column:
    """Natural logarithm by IEEE rules: -infinity at zero and NaN below, where `F.log` gives NULL."""
    return F.when(c(a) > 0, F.log(c(a))).when(c(a) == 0, F.lit(float("-inf"))).when(c(a) < 0, F.lit(float("nan")))


def ratio(a, b) -> Column:
    """a / b of doubles by IEEE rules: a signed infinity or NaN over zero, where `/` fails."""
    n = c(a).cast("double")
    over = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))).when(n == 0, F.lit(float("nan")))
    return F.when(c(b) == 0, F.when(F.isnan(n), n).otherwise(over)).otherwise(F.try_divide(n, c(b).cast("double")))


# ------------------------------------------------------------------ ticks and money
def round_to_tick(price, tick: str) -> Column:
    """Nearest multiple of the tick, half up, exact decimals."""
    t = F.lit(tick).cast("decimal(18,6)")
    return (F.round(c(price).cast(MONEY) / t, 0) * t).cast(MONEY)


def round_limit_to_tick(price, tick: str, side) -> Column:
    """BUY limits round down to the tick, SELL limits round up."""
    t = F.lit(tick).cast("decimal(18,6)")
    steps = c(price).cast(MONEY) / t
    return (F.when(c(side) == "BUY", F.floor(steps)).otherwise(F.ceil(steps)).cast("decimal(18,0)") * t).cast(MONEY)


def limit_price(side, bid, ask, tick: str, aggressiveness=0.0) -> Column:
    """Limit inside the spread: 0 joins the own side, 1 crosses; rounded against the trader's cost."""
    b, a, g = c(bid).cast(MONEY), c(ask).cast(MONEY), c(aggressiveness).cast("decimal(9,6)")
    raw = F.when(c(side) == "BUY", b + (a - b) * g).otherwise(a - (a - b) * g)
    return round_limit_to_tick(raw, tick, side)


def fixed_commission(shares, price) -> Column:
    """Per-share fee with a floor of 1.00 and a cap of 1 % of trade value; zero shares cost nothing."""
    n, p = F.abs(c(shares)).cast("decimal(18,4)"), c(price).cast("decimal(18,6)")
    per_share = n * F.lit("0.005").cast("decimal(6,4)")
    cap = n * p * F.lit("0.01").cast("decimal(6,4)")
    fee = F.least(F.greatest(per_share, F.lit("1").cast("decimal(6,4)")), cap)
    return F.when(n == 0, F.lit("0").cast("decimal(18,2)")).otherwise(F.round(fee, 2).cast("decimal(18,2)"))


def price_tick_ok(price) -> Column:
    """At most two decimals from 1.00 up, at most four below."""
    p = c(price).cast("decimal(18,8)")
    return (p > 0) & F.when(p >= 1, p % F.lit("0.01").cast("decimal(8,4)") == 0).otherwise(
        p % F.lit("0.0001").cast("decimal(8,4)") == 0)


def tick_value(tick, multiplier) -> Column:
    return c(tick) * c(multiplier)


def futures_pnl(entry, exit_, qty, multiplier) -> Column:
    return (c(exit_) - c(entry)) * c(qty) * c(multiplier)


def pip_value_usd(pair, units, usd_per_quote=1.0) -> Column:
    pip = F.when(c(pair).endswith("JPY"), 0.01).otherwise(0.0001)
    return c(units) * pip * c(usd_per_quote)


# ------------------------------------------------------------------ calendars and sessions
def third_friday(day) -> Column:
    """Third Friday of the month of `day`."""
    first = F.trunc(c(day), "month")
    return F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 14)


def weekday(day) -> Column:
    """Monday 0 .. Sunday 6."""
    return F.weekday(c(day))


def minus_business_days(day, n: int) -> Column:
    """The date n weekdays (Mon-Fri) before `day`."""
    d = c(day)
    # a weekend day first steps back to Friday, which already is one business day
    wd = F.weekday(d)
    back = F.when(wd >= 5, wd - 4).otherwise(0)
    used = F.when(wd >= 5, 1).otherwise(0)
    rest = F.lit(n) - used
    base = F.date_sub(d, back.cast("int"))
    bwd = F.weekday(base)
    weeks = F.floor(rest / 5)
    odd = rest - weeks * 5
    extra = weeks * 7 + odd + F.when(odd > bwd, 2).otherwise(0)
    return F.date_sub(base, extra.cast("int"))


def roll_date(expiry, business_days_before: int = 8) -> Column:
    return minus_business_days(expiry, business_days_before)


def to_utc(local, zone) -> Column:
    return F.to_utc_timestamp(F.to_timestamp(c(local)), c(zone) if isinstance(zone, Column) else zone)


def market_open_utc(day) -> Column:
    local = F.make_timestamp_ntz(F.year(c(day)), F.month(c(day)), F.dayofmonth(c(day)), F.lit(9), F.lit(30), F.lit(0))
    return F.to_utc_timestamp(local.cast("timestamp"), "America/New_York")


def is_regular_hours(ts) -> Column:
    local = F.from_utc_timestamp(c(ts), "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) < 5) & (minute >= 570) & (minute < 960)


def session_date(ts, tz: str = "America/New_York") -> Column:
    return F.to_date(F.from_utc_timestamp(c(ts), tz))


def report_available_at(report_date) -> Column:
    """Positioning report of a Tuesday is public on Friday 15:30 New York."""
    d = F.date_add(c(report_date), 3)
    local = F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.lit(15), F.lit(30), F.lit(0))
    return F.to_utc_timestamp(local.cast("timestamp"), "America/New_York")


def year_fraction(now, expiry) -> Column:
    return (F.unix_micros(c(expiry)) - F.unix_micros(c(now))) / (365.0 * 86_400_000_000)


# ------------------------------------------------------------------ symbols
MONTH_CODES = "FGHJKMNQUVXZ"      # fixed value: futures month letters, January to December


def contract_code(root, expiry) -> Column:
    e = c(expiry)
    return F.concat(c(root), F.substring(F.lit(MONTH_CODES), F.month(e), F.lit(1)), (F.year(e) % 10).cast("string"))


def occ_symbol(root, expiry, cp, strike) -> Column:
    thousandths = F.round(c(strike).cast("decimal(18,6)") * 1000, 0).cast("bigint").cast("string")
    return F.concat(c(root), F.date_format(c(expiry), "yyMMdd"), c(cp), F.lpad(thousandths, 8, "0"))


OCC_PATTERN = r"^([A-Z.]{1,6})(\d{6})([CP])(\d{8})$"   # fixed value: option symbol layout


def parse_occ(symbol) -> Column:
    s = c(symbol)
    part = [F.regexp_extract(s, OCC_PATTERN, i) for i in range(1, 5)]
    return F.when(s.rlike(OCC_PATTERN), F.struct(
        part[0].alias("root"), F.to_date(part[1], "yyMMdd").alias("expiry"),
        F.when(part[2] == "C", 1).otherwise(-1).alias("cp"),
        (part[3].cast("bigint") / 1000.0).alias("strike")))


def canonical_symbol(asset_class, symbol, expiry=None, currency=None) -> Column:
    """One symbol per asset class; NULL for an unsupported class."""
    a, s = F.upper(c(asset_class)), c(symbol)
    out = F.when(a == "EQUITY", s).when(a == "FX", F.concat_ws(".", F.substring(s, 1, 3), F.substring(s, 4, 9)))
    if expiry is not None:
        out = out.when(a == "FUTURE", contract_code(symbol, expiry))
    if currency is not None:
        out = out.when(a == "CRYPTO", F.concat_ws("/", s, c(currency)))
    return out


# ------------------------------------------------------------------ fills, costs, sizing
def market_fill_price(qty, open_price, slippage_bps=0.0) -> Column:
    return c(open_price) * (1 + F.signum(c(qty)) * c(slippage_bps) / 1e4)


def limit_fill_price(qty, limit, open_, high, low) -> Column:
    """Filled only when the bar trades through the limit; a better open gives the open."""
    return (F.when((c(qty) > 0) & (c(low) < c(limit)), F.least(c(open_), c(limit)))
            .when((c(qty) < 0) & (c(high) > c(limit)), F.greatest(c(open_), c(limit))))


def stop_fill_price(qty, stop, open_, high, low) -> Column:
    """Stop price, or the open when the bar gaps past it."""
    return (F.when((c(qty) > 0) & (c(high) >= c(stop)), F.greatest(c(open_), c(stop)))
            .when((c(qty) < 0) & (c(low) <= c(stop)), F.least(c(open_), c(stop))))


def participation_cap(qty, bar_volume, max_participation=0.1) -> Column:
    return F.signum(c(qty)) * F.least(F.abs(c(qty)), c(max_participation) * c(bar_volume))


def sqrt_impact_bps(order_shares, adv_shares, daily_vol, k=1.0) -> Column:
    return 1e4 * c(k) * c(daily_vol) * F.sqrt(F.abs(c(order_shares)) / c(adv_shares))


def fair_value(spot, rate, div_yield, years) -> Column:
    return c(spot) * F.exp((c(rate) - c(div_yield)) * c(years))


def futures_fair_value(spot, rate, div_yield, days) -> Column:
    return c(spot) * F.exp((c(rate) - c(div_yield)) * c(days) / 365.0)


def implied_carry(f_near, f_far, t_near, t_far) -> Column:
    return F.log(c(f_far) / c(f_near)) / (c(t_far) - c(t_near))


def fed_funds_post_meeting_rate(futures_price, current_rate, meeting_day, days_in_month) -> Column:
    """Monthly average = (days before x current + days after x post) / days."""
    avg = 100 - c(futures_price)
    d, n = c(meeting_day), c(days_in_month)
    return (avg * n - d * c(current_rate)) / (n - d)


def move_probability(post_rate, current_rate, step=0.25) -> Column:
    return (c(post_rate) - c(current_rate)) / c(step)


def risk_per_trade_size(equity, risk_frac, entry, stop, multiplier=1.0) -> Column:
    return F.floor(c(equity) * c(risk_frac) / (F.abs(c(entry) - c(stop)) * c(multiplier)))


def turtle_units(equity, risk_frac, atr, point_value=1.0) -> Column:
    return F.floor(c(equity) * c(risk_frac) / (c(atr) * c(point_value)))


def kelly_discrete(p_win, win_loss_ratio) -> Column:
    return c(p_win) - (1 - c(p_win)) / c(win_loss_ratio)


def kelly_continuous(mu, sigma, r=0.0) -> Column:
    return (c(mu) - c(r)) / (c(sigma) * c(sigma))


def bet_size(prob, n_classes: int = 2) -> Column:
    p = c(prob)
    base = 1.0 / n_classes
    z = (p - base) / F.sqrt(p * (1 - p))
    return (F.when(p >= 1, 1.0).when(p <= 0, 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * normal_cdf(z) - 1))))


def discretize(size, step: float = 0.1) -> Column:
    return F.bround(c(size) / step) * step


def futures_hedge_contracts(portfolio_value, beta, fut_price, multiplier, hedge_ratio=1.0) -> Column:
    return F.bround(c(hedge_ratio) * c(beta) * c(portfolio_value) / (c(fut_price) * c(multiplier)))


def implied_move(straddle, spot) -> Column:
    return c(straddle) / c(spot)


def straddle_rule_of_thumb(spot, sigma, years) -> Column:
    return math.sqrt(2 / math.pi) * c(spot) * c(sigma) * F.sqrt(c(years))


def delta_gamma_pnl(delta, gamma, ds) -> Column:
    return c(delta) * c(ds) + 0.5 * c(gamma) * c(ds) * c(ds)


def bond_return_from_yield(yield_change_pct, duration=8.5) -> Column:
    return -c(duration) * c(yield_change_pct) / 100.0
