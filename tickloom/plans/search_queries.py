"""Parameter search and account rows."""
from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import search as S
from ..operators import text as X
from .base import BARS_SQL, query, sel
from .indicator_queries import bars

C, L = F.col, F.lit
FAST, SLOW = [3, 5, 8, 13], [20, 30, 45, 60]
OUT = "symbol s, rung i, config i, fast i, slow i, rows i, score f, kept b"


def _search_sql(configs: str, n: int, rungs: int, keep: float) -> str:
    """Means of all windows, P&L of every trial, and one pair of CTEs a rung over all rows so far."""
    means = ", ".join(f"CASE WHEN rn >= {w - 1} THEN avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS {w - 1} PRECEDING) END AS m{w}" for w in FAST + SLOW)
    fast, slow = (f"CASE {side} {' '.join(f'WHEN {w} THEN m{w}' for w in ws)} END" for side, ws in (("fast", FAST), ("slow", SLOW)))
    ctes, last = "", "(SELECT symbol, config FROM x GROUP BY 1, 2)"
    for k, left in enumerate(S.survivors(n, rungs, keep), 1):
        ctes += f""", r{k} AS (SELECT symbol, {k} AS rung, config, fast, slow, count(pnl) AS rows, sum(pnl) / nullif(count(pnl), 0) AS score FROM (SELECT x.symbol, config, fast, slow, CASE WHEN rn < floor(n * {2.0 ** (k - rungs)}) THEN pnl END AS pnl FROM x JOIN {last} l USING (symbol, config)) GROUP BY 1, 3, 4, 5),
 q{k} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 12) DESC NULLS LAST, config) <= {left} AS kept FROM r{k})"""
        last = f"(SELECT symbol, config FROM q{k} WHERE kept)"
    every = " UNION ALL ".join(f"SELECT * FROM q{k}" for k in range(1, rungs + 1))
    return f"""WITH {BARS_SQL}, c AS ({configs}), m AS (SELECT symbol, rn, count(*) OVER (PARTITION BY symbol) AS n, lead(close) OVER (PARTITION BY symbol ORDER BY rn) / close - 1 AS ret, {means} FROM b),
 x AS (SELECT symbol, rn, n, config, fast, slow, CASE WHEN {fast} > {slow} THEN ret WHEN {fast} <= {slow} THEN -ret END AS pnl FROM m, c){ctes} {sel(OUT, f'({every})')}"""


_GRID = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {f}, {s})" for i, (f, s) in enumerate(itertools.product(FAST, SLOW))) + ") v(config, fast, slow)"


def _pick(name: str, vals: list[int]) -> str:
    return f"([{', '.join(map(str, vals))}])[((('0x' || substr(md5('7|{name}|' || i), 1, 8))::BIGINT * {len(vals)}) >> 32) + 1]"


_RANDOM = f"SELECT i AS config, {_pick('fast', FAST)} AS fast, {_pick('slow', SLOW)} AS slow FROM range(12) r(i)"


@query("halving_search", _search_sql(_GRID, len(FAST) * len(SLOW), 3, 0.5))
def _(t):
    """Crossovers of two means: 16 on the first quarter of a symbol, 8 on the half, 4 on the whole; all trials listed."""
    rows = S.crossover_rows(bars(t), FAST + SLOW)
    return S.halving(rows, ["symbol"], S.grid(fast=FAST, slow=SLOW), S.crossover_pnl(), 3, 0.5)


@query("random_search", _search_sql(_RANDOM, 12, 1, 1 / 12))
def _(t):
    """Twelve seeded trials on the whole series, every one listed, the best marked."""
    rows = S.crossover_rows(bars(t), FAST + SLOW)
    return S.halving(rows, ["symbol"], S.random_picks(12, 7, fast=FAST, slow=SLOW), S.crossover_pnl(), 1, 1 / 12)


# ---------------------------------------------------------------- account rows
@query("account_summary", sel("account i, NetLiquidation f, TotalCashValue f, BuyingPower f, MaintMarginReq f",
       "(SELECT c_custkey AS account, c_acctbal AS NetLiquidation, round(c_acctbal / 2, 4) AS TotalCashValue, round(c_acctbal * 4, 4) AS BuyingPower, CASE WHEN c_mktsegment <> 'BUILDING' THEN round(c_acctbal / 4, 4) END AS MaintMarginReq FROM customer WHERE c_nationkey % 2 = 0)"))
def _(t):
    """Customers as accounts, a row per tag and currency, values as text; USD accounts only."""
    v = lambda tag, x: F.struct(L(tag).alias("tag"), F.format_string("%.4f", F.round(x, 4)).alias("value"))
    bal = C("c_acctbal")
    tags = F.array(v("NetLiquidation", bal), v("TotalCashValue", bal / 2), v("BuyingPower", bal * 4), v("Leverage", bal),
                   F.when(C("c_mktsegment") != "BUILDING", v("MaintMarginReq", bal / 4)))
    rows = t.customer.select(C("c_custkey").alias("account"), F.when(C("c_nationkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"), F.inline(F.array_compact(tags)))
    return A.account_summary(rows, ["account"])


@query("account_warnings", f"""WITH o AS (SELECT o_custkey, (count(*) FILTER (WHERE o_orderstatus = 'P'))::BIGINT AS n, sum(o_totalprice) / 100 AS equity FROM orders GROUP BY 1),
 a AS (SELECT o_custkey AS account, list_filter([CASE WHEN o_custkey % 7 = 0 OR o_custkey % 11 = 0 THEN 'trading blocked' END, CASE WHEN o_custkey % 5 = 0 THEN 'pattern day trader' END, CASE WHEN n >= 3 THEN 'day trades: ' || n END, CASE WHEN n >= 3 AND round(equity, 4) < 25000 THEN 'low equity' END], lambda x: x IS NOT NULL) AS w FROM o)
 {sel('account i, warnings s, n i', "(SELECT account, array_to_string(w, '; ') AS warnings, len(w) AS n FROM a)")}""")
def _(t):
    """Accounts whose day trades and equity come from their orders."""
    d = t.orders.groupBy(C("o_custkey").alias("account")).agg(F.count_if(C("o_orderstatus") == "P").alias("daytrade_count"), (F.sum("o_totalprice") / 100).alias("e"))
    d = d.select("account", "daytrade_count", F.format_string("%.4f", "e").alias("equity"), (C("account") % 7 == 0).alias("trading_blocked"),
                 (C("account") % 11 == 0).alias("account_blocked"), (C("account") % 5 == 0).alias("pattern_day_trader")).withColumn("w", A.account_warnings())
    return d.select("account", F.array_join("w", "; ").alias("warnings"), F.size("w").alias("n"))


@query("currency_sums", sel("segment s, currency s, balance f, n i",
       "(SELECT c_mktsegment AS segment, n_name AS currency, sum(c_acctbal::DECIMAL(20, 2)) AS balance, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"))
def _(t):
    """Balances per segment, each nation's in its own currency."""
    d = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey"))
    d = d.select(C("c_mktsegment").alias("segment"), C("n_name").alias("currency"), C("c_acctbal").cast("decimal(20,2)").alias("balance"))
    return A.by_currency(d, ["segment"], "balance")


@query("first_amounts", sel("doc_id i, amount f", r"(SELECT doc_id, replace(nullif(regexp_extract(text, '\$([0-9][0-9,]*(?:\.[0-9]+)?) million', 1), ''), ',', '')::DOUBLE AS amount FROM documents)"))
def _(t):
    return t.documents.select("doc_id", X.first_amount("text").alias("amount"))
