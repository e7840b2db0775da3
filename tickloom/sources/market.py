"""Reading and writing market data: declared schemas, partitioned bars, vendor shapes, fills with reject rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import OCC_PATTERN, parse_occ
from ..series import Series, SeriesSpec, index_rows

BAR_COLUMNS = ["ts", "symbol", "open", "high", "low", "close", "volume", "vwap", "trade_count", "timeframe", "source",
               "adjusted"]
TICK_SCHEMA = "ts timestamp, price double, size double"
FILL_SCHEMA = "ts string, tz string, symbol string, side string, qty string, price string, fee string"
VINTAGE_SCHEMA = "date date, value string, realtime_start date, realtime_end date"
OPEN_END = "9999-12-31"


# ------------------------------------------------------------------ bars on disk
def write_partitioned(bars: DataFrame, root: str, mode="append", files_per_day: int | None = None) -> None:
    """Hive layout symbol=/date= (UTC day).  `files_per_day` salts a day so that a hot symbol is not one file."""
    d = bars.withColumn("date", F.to_date("ts"))
    if files_per_day:
        d = d.repartition(F.col("symbol"), F.col("date"), F.pmod(F.xxhash64("ts"), F.lit(files_per_day)))
    else:
        d = d.repartition("symbol", "date")
    w = d.sortWithinPartitions("symbol", "date", "ts").write.mode(mode)
    if mode == "overwrite":                      # only the partitions that `bars` has are replaced
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy("symbol", "date").parquet(root)


def read_partitioned(spark: SparkSession, root: str, schema: T.StructType, where: str | None = None) -> DataFrame:
    """Rows of a partitioned folder with declared types; a condition on symbol or date prunes folders before any file is read."""
    fields = [f for f in schema.fields if f.name not in ("symbol", "date")]
    d = spark.read.schema(T.StructType([*fields, T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())])).parquet(root)
    return d.where(where) if where else d


def daily_summary(bars: DataFrame) -> DataFrame:
    """One row per symbol and day: bars, high, low, volume."""
    return bars.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("bars"), F.max("high").alias("high"),
                                              F.min("low").alias("low"), F.sum("volume").alias("volume"))


def sma_scan(bars: DataFrame, n: int, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    s = Series.of(bars, spec, back=n - 1)
    return s.add({f"sma{n}": s.mean("close", n)}).done()


def read_ticks(spark: SparkSession, path: str, stream=False) -> DataFrame:
    r = spark.readStream if stream else spark.read
    return r.schema(TICK_SCHEMA).option("header", True).csv(path)


def read_vintages(spark: SparkSession, path: str) -> DataFrame:
    """Vintage table; a non-numeric value is NULL, the open end stays 9999-12-31."""
    d = spark.read.schema(VINTAGE_SCHEMA).option("header", True).csv(path)
    return d.withColumn("value", F.expr("try_cast(value as double)"))


def read_series(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    d = spark.read.schema("date date, value double").option("header", True).option("nullValue", ".").csv(path)
    return d.where(F.col("date") >= start) if start else d


def wide_to_long(df: DataFrame, ts: str, tickers: list[str] | None = None, value="close") -> DataFrame:
    """Wide daily closes to (ts, symbol, close); only the wanted columns are read."""
    names = tickers or [c for c in df.columns if c != ts]
    return df.select(ts, *names).unpivot(ts, names, "symbol", value).where(F.col(value).isNotNull())


# ------------------------------------------------------------------ vendors to one schema
def _non_negative(c: str) -> Column:
    return F.when(F.col(c).cast("double") >= 0, F.col(c).cast("double"))


def normalize_vendor_a(df: DataFrame, symbol: Column, timeframe: str, source="vendor_a", adjusted=False, arrival="seq") -> DataFrame:
    """Negative volume, vwap and trade count are missing; of two rows with one time the first to arrive stays."""
    d = df.select(
        F.col("ts").cast("timestamp").alias("ts"), symbol.alias("symbol"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        _non_negative("volume").alias("volume"), _non_negative("vwap").alias("vwap"),
        _non_negative("trade_count").alias("trade_count"), F.lit(timeframe).alias("timeframe"),
        F.lit(source).alias("source"), F.lit(adjusted).alias("adjusted"), F.col(arrival).alias("_a"))
    rest = [c for c in BAR_COLUMNS if c not in ("ts", "symbol")]
    return (d.groupBy("ts", "symbol").agg(F.min_by(F.struct(*rest), "_a").alias("_m"))
            .select("ts", "symbol", *[F.col(f"_m.{c}").alias(c) for c in rest]).select(*BAR_COLUMNS))


def normalize_vendor_b(df: DataFrame, timeframe: str, feed="iex", adjusted=True) -> DataFrame:
    return df.select(F.col("timestamp").cast("timestamp").alias("ts"), "symbol",
                     *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "vwap", "trade_count")],
                     F.lit(timeframe).alias("timeframe"), F.concat(F.lit("vendor_b_"), F.lit(feed)).alias("source"),
                     F.lit(adjusted).alias("adjusted")).select(*BAR_COLUMNS)


CHAIN_COLUMNS = ["expiry", "strike", "cp", "bid", "ask", "mid", "iv", "delta", "source"]


def chain_from_rows(df: DataFrame, source="vendor_a") -> DataFrame:
    """Flat quote rows (expiry as yyyyMMdd, right C/P); a negative quote is missing."""
    bid, ask = _non_negative("bid"), _non_negative("ask")
    return df.select(F.to_date("expiry", "yyyyMMdd").alias("expiry"), F.col("strike").cast("double").alias("strike"),
                     F.when(F.col("right") == "C", 1).otherwise(-1).alias("cp"), bid.alias("bid"), ask.alias("ask"),
                     ((bid + ask) / 2).alias("mid"), F.col("iv").cast("double").alias("iv"),
                     F.col("delta").cast("double").alias("delta"), F.lit(source).alias("source"))


SNAPSHOT_SCHEMA = ("map<string, struct<latest_quote: struct<bid_price: double, ask_price: double>, "
                   "implied_volatility: double, greeks: struct<delta: double>>>")


def chain_from_snapshots(df: DataFrame, snapshots: str, source="vendor_b") -> tuple[DataFrame, DataFrame]:
    """Map of option code to nested snapshot -> (chain rows, rejected codes)."""
    e = df.select(F.explode(snapshots).alias("code", "s"))
    good = e.where(F.col("code").rlike(OCC_PATTERN)).withColumn("p", parse_occ("code"))
    q = F.col("s.latest_quote")
    chain = good.select("p.expiry", "p.strike", "p.cp", q["bid_price"].alias("bid"), q["ask_price"].alias("ask"),
                        ((q["bid_price"] + q["ask_price"]) / 2).alias("mid"),
                        F.col("s.implied_volatility").alias("iv"), F.col("s.greeks.delta").alias("delta"),
                        F.lit(source).alias("source"))
    return chain, e.where(~F.col("code").rlike(OCC_PATTERN)).select("code")


# ------------------------------------------------------------------ fills with reasons instead of failures
def check_fills(raw: DataFrame, zones: DataFrame) -> DataFrame:
    """Add parsed columns and `error`, the first broken rule in a fixed order; a bad row never fails the job."""
    # the zone list is a fixed table of a few hundred names
    z = F.broadcast(zones.select(F.col("zone").alias("_zone")))
    d = raw.join(z, F.col("tz") == F.col("_zone"), "left")
    zone = F.coalesce("_zone", F.lit("UTC"))
    local = F.try_to_timestamp(F.col("ts"), F.lit("yyyy-MM-dd HH:mm:ss"))
    side = F.upper(F.trim("side"))

    def dec(name: str) -> Column:
        return F.expr(f"try_cast(trim({name}) as decimal(18,6))")
    qty, price = dec("qty"), dec("price")
    fee = F.when(F.coalesce(F.trim("fee"), F.lit("")) == "", F.lit(0).cast("decimal(18,6)")).otherwise(dec("fee"))
    error = (F.when(F.col("_zone").isNull(), "unknown time zone").when(local.isNull(), "bad timestamp")
             .when(side.isNull() | ~side.isin("BUY", "SELL"), "bad side").when(qty.isNull() | (qty <= 0), "bad qty")
             .when(price.isNull() | (price <= 0), "bad price").when(fee.isNull() | (fee < 0), "bad fee"))
    return d.select(*[F.col(c) for c in raw.columns if c not in ("ts", "symbol", "side", "qty", "price", "fee")],
                    F.to_utc_timestamp(local, zone).alias("ts"), F.upper(F.trim("symbol")).alias("symbol"),
                    F.when(side == "BUY", qty).otherwise(-qty).alias("qty"), price.alias("price"), fee.alias("fee"),
                    error.alias("error"))


def read_fills(spark: SparkSession, path: str, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good fills, 'line N: reason' rows).  Line numbers come from the byte order of the rows of each file."""
    text = spark.read.text(path).select("value", F.input_file_name().alias("file"),
                                        F.monotonically_increasing_id().alias("_mid"))
    spec = SeriesSpec(("file",), ("_mid",), "_mid div 1000000")
    numbered = index_rows(text, spec, "_line").withColumn("line", F.col("_line") + 1)
    raw = (numbered.where(F.col("line") > 1).withColumn("_v", F.from_csv("value", FILL_SCHEMA))
           .select("file", "line", "_v.*"))
    checked = check_fills(raw, zones)
    bad = checked.where(F.col("error").isNotNull()).select(
        "file", "line", F.format_string("line %d: %s", F.col("line"), F.col("error")).alias("message"))
    return checked.where(F.col("error").isNull()).drop("error"), bad


def pnl_report(pnl: DataFrame, symbol="symbol", day="day", value="pnl") -> DataFrame:
    """One JSON object per symbol with exact decimal text per day."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(day).cast("string"), F.col(value).cast("string")))))
    return pnl.groupBy(symbol).agg(F.to_json(entries).alias("pnl"))


# ------------------------------------------------------------------ coverage and incremental load
def missing_ranges(have: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of [start, end) not covered by half-open intervals; both tables have lo and hi (numbers)."""
    inside = (have.join(want.select(*keys, F.col("lo").alias("_a"), F.col("hi").alias("_b")), keys)
              .where((F.col("hi") > F.col("_a")) & (F.col("lo") < F.col("_b")) & (F.col("hi") > F.col("lo")))
              .select(*keys, "_a", "_b", "lo", "hi"))
    ends = want.select(*keys, F.col("lo").alias("_a"), F.col("hi").alias("_b"), F.col("hi").alias("lo"), F.col("hi").alias("hi"))
    spec = SeriesSpec((*keys, "_a", "_b"), ("lo", "hi"), "cast(floor(lo / 86400000000) as bigint)")
    s = Series.of(inside.unionByName(ends), spec).running({"_reach": ("max", F.col("hi"))}).halo(1)
    d = s.add(_from=F.greatest(F.coalesce(s.lag("_reach"), F.col("_a")), F.col("_a"))).done()
    return d.where(F.col("lo") > F.col("_from")).select(*keys, F.col("_from").alias("lo"), F.col("lo").alias("hi"))


def new_rows(source: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Incremental load: rows of the source that are not stored yet, once each."""
    return source.join(stored.select(*on), on, "left_anti").dropDuplicates(on)


# ------------------------------------------------------------------ stable ids
def config_hash(entries: Column) -> Column:
    """12 hex characters of the SHA-256 of canonical JSON: `entries` is a map of text to text."""
    return F.substring(F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256), 1, 12)


def story_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("/", *parts)), 1, 32)
