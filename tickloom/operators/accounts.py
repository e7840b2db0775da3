"""Broker account rows: summaries in one currency and warnings, as Column expressions and one pivot."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = ("NetLiquidation", "TotalCashValue", "BuyingPower", "MaintMarginReq")     # fixed values: tags of a summary
DAY_TRADES, LOW_EQUITY = 3, 25_000                                               # fixed values: day-trading levels


def account_summary(values: DataFrame, keys: list[str], currency: str = "USD", digits: str = "decimal(20,4)") -> DataFrame:
    """One row per account, one decimal per tag, from rows (keys, tag, value as text, currency); others do not count.

    Of a repeated tag the largest value stays; an account without a row in this currency has none here.
    """
    d = values.where((F.col("currency") == currency) & F.col("tag").isin(*TAGS))
    return d.groupBy(*keys).agg(*[F.max(F.when(F.col("tag") == t, F.expr(f"try_cast(value AS {digits})"))).alias(t) for t in TAGS])


def account_warnings(trading_blocked="trading_blocked", account_blocked="account_blocked", pattern="pattern_day_trader",
                     daytrades="daytrade_count", equity="equity") -> Column:
    """The warnings of an account row in order; an empty array where there is none. Null flags are false, null counts 0,
    a null equity is 0."""
    n = F.coalesce(F.col(daytrades).cast("int"), F.lit(0))
    low = F.coalesce(F.expr(f"try_cast({equity} AS decimal(20,4))"), F.lit(0)) < LOW_EQUITY
    found = F.array(F.when(F.coalesce(F.col(trading_blocked), F.lit(False)) | F.coalesce(F.col(account_blocked), F.lit(False)), "trading blocked"),
                    F.when(F.coalesce(F.col(pattern), F.lit(False)), "pattern day trader"),
                    F.when(n >= DAY_TRADES, F.concat(F.lit("day trades: "), n.cast("string"))),
                    F.when((n >= DAY_TRADES) & low, "low equity"))
    return F.filter(found, lambda w: w.isNotNull())


def by_currency(df: DataFrame, keys: list[str], amount: str, currency: str = "currency") -> DataFrame:
    """Sums of an amount per currency: amounts of different currencies never meet in one sum."""
    return df.groupBy(*keys, currency).agg(F.sum(amount).alias(amount), F.count(F.lit(1)).alias("n"))
