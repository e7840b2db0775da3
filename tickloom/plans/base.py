"""Registered queries over the driver tables, each with the SQL it must agree with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import SeriesSpec
from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# fields the driver tables must have; declared, never inferred
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """Driver tables and the market views built on them."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        df = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf}/{name}.parquet")
        return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields
                               if isinstance(f.dataType, T.TimestampNTZType)})

    # daily bars: one symbol per order priority
    def bars(self) -> DataFrame:
        p = F.col("o_totalprice") / 997.0
        return self.orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(
            F.min_by(p, "o_orderkey").alias("open"), F.max(p).alias("high"),
            F.min(p).alias("low"), F.max_by(p, "o_orderkey").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"))

    # ticks: one symbol per event type
    def trades(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"),
                                  F.col("value").alias("price"), (1 + F.col("user_id") % 10).alias("size"), "user_id")

    # daily closes of 25 symbols: mean order value per nation
    def panel(self) -> DataFrame:
        c = self.customer.select("c_custkey", "c_nationkey")
        n = self.nation.select("n_nationkey", F.col("n_name").alias("symbol"), "n_regionkey")
        return (self.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
                .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
                .groupBy("symbol", F.col("n_regionkey").alias("sector"), F.trunc("o_orderdate", "month").alias("month"))
                .agg(F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).alias("n")))

    # fills: one symbol per supplier
    def fills(self) -> DataFrame:
        side = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
        return self.lineitem.select(
            F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), side.alias("side"),
            (F.col("l_quantity") * side).alias("qty"),
            F.col("l_extendedprice").alias("price"),
            F.round(F.col("l_tax") * 10, 2).alias("fee"))


BARS_SPEC = SeriesSpec(("symbol",), ("ts",), "year(ts)")
TICKS_SPEC = SeriesSpec(("symbol",), ("ts", "seq"))
PANEL_SPEC = SeriesSpec(("symbol",), ("month",), "year(month)")

BARS_SQL = """bars AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(p, o_orderkey) AS open,
 max(p) AS high, min(p) AS low, arg_max(p, o_orderkey) AS close,
 count(*)::DOUBLE AS volume FROM (SELECT *, o_totalprice / 997.0::DOUBLE AS p FROM orders) GROUP BY 1, 2),
b AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::BIGINT AS rn FROM bars)"""
TRADES_SQL = """trades AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
 (1 + user_id % 10)::BIGINT AS size, user_id FROM events)"""
PANEL_SQL = """panel AS (SELECT n_name AS symbol, n_regionkey AS sector, date_trunc('month', o_orderdate)::DATE AS month,
 avg(o_totalprice) AS close, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""
FILLS_SQL = """fills AS (SELECT l_suppkey AS symbol, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq,
 CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side,
 l_quantity * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS qty,
 l_extendedprice AS price, round(l_tax * 10, 2) AS fee FROM lineitem)"""


def finish(df: DataFrame) -> DataFrame:
    """Comparable output: doubles rounded, integers wide, times as text."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, STAMP)
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def sel(spec: str, source: str, where: str = "") -> str:
    """SELECT list in the types of `finish`: 'name kind, ...' with kind f(loat) i(nt) t(ime) d(ate) s(tring) b(ool)."""
    parts = []
    for item in spec.split(","):
        n, k = item.split()
        parts.append({"f": f"round({n}::DOUBLE, {DIGITS}) + 0.0 AS {n}", "i": f"{n}::BIGINT AS {n}",
                      "t": f"strftime({n}, '%Y-%m-%d %H:%M:%S.%f') AS {n}", "d": f"strftime({n}, '%Y-%m-%d') AS {n}",
                      "s": f"{n}::VARCHAR AS {n}", "b": f"{n}::BOOLEAN AS {n}"}[k])
    return f"SELECT {', '.join(parts)} FROM {source}" + (f" WHERE {where}" if where else "")


def query(name: str, sql: str | None = None):
    """Register `fn(Tables) -> DataFrame` under `name`, with its SQL where there is one."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} already registered")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return finish(fn(Tables(prepare(spark), sf)))
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def decay_sql(name: str, src: str, a: str, b: str, at: int, seed: str) -> str:
    """CTE body: y_t = a^(t-at) seed + sum over at < i <= t of a^(t-i) b_i, as a closed form."""
    return f"""{name} AS (SELECT t.symbol, t.rn, pow({a}, t.rn - {at}) * min(s.sd) + coalesce(sum(pow({a}, t.rn - i.rn)
 * i.bb), 0) AS y FROM {src} t JOIN (SELECT symbol, {seed} AS sd FROM {src} WHERE rn = {at}) s ON s.symbol = t.symbol
 LEFT JOIN (SELECT symbol, rn, {b} AS bb FROM {src}) i ON i.symbol = t.symbol AND i.rn > {at} AND i.rn <= t.rn
 WHERE t.rn >= {at} GROUP BY t.symbol, t.rn)"""


def walk_sql(ctes: str, src: str, cols: dict[str, tuple[str, str]], spec: str, where: str = "") -> str:
    """Row-by-row state machine as a recursive CTE: column -> (expression on row 0, expression from p.<column>)."""
    first = ", ".join(f"{e0} AS {c}" for c, (e0, _) in cols.items())
    step = ", ".join(e1 for _, e1 in cols.values())
    return f"""WITH RECURSIVE {ctes}, walk AS (SELECT s.symbol, s.ts, s.rn, {first} FROM {src} s WHERE s.rn = 0
 UNION ALL SELECT s.symbol, s.ts, s.rn, {step} FROM walk p JOIN {src} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)
 {sel(spec, "walk", where)}"""
