"""Joins Spark has no public operator for: as-of and interval joins, both safe for hot keys."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
              bring: Sequence[str], *, right_order: Sequence[str] = (), direction: str = "backward",
              strict: bool = False, tolerance: str | None = None, bucket_us: int = 24 * HOUR_US,
              prefix: str = "") -> DataFrame:
    """Every left row with the nearest right row in time, NULL where there is none.

    Both sides are tagged and united, then solved inside (key, time bucket); the last right row of all earlier
    buckets comes from the small bucket table, so no task ever holds a whole key.  At equal times the right row
    counts unless `strict`.  `direction` is backward, forward or nearest (ties go backward).
    """
    if direction == "nearest":
        b = asof_join(left, right, on, left_time, right_time, [*bring, right_time], right_order=right_order,
                      bucket_us=bucket_us, prefix="_bk_")
        f = asof_join(b, right, on, left_time, right_time, [*bring, right_time], right_order=right_order,
                      direction="forward", bucket_us=bucket_us, prefix="_fw_")
        lt, bt, ft = F.col(left_time), F.col(f"_bk_{right_time}"), F.col(f"_fw_{right_time}")
        fwd = ft.isNotNull() & (bt.isNull() | ((_micros(ft) - _micros(lt)) < (_micros(lt) - _micros(bt))))
        out = f.withColumns({prefix + c: F.when(fwd, F.col(f"_fw_{c}")).otherwise(F.col(f"_bk_{c}")) for c in bring})
        return out.drop(*[f"{p}{c}" for p in ("_bk_", "_fw_") for c in [*bring, right_time]])
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    back = direction == "backward"
    on = list(on)
    fields = list(dict.fromkeys([*bring, right_time]))
    lcols = left.columns
    # a monotone time key: forward search is backward search on negated time
    sign = 1 if back else -1
    order_cols = [F.col(c) for c in right_order]
    lsel = left.select(*on, (_micros(F.col(left_time)) * sign).alias("_t"),
                       F.lit(0 if strict else 1).alias("_side"),
                       F.lit(None).cast("bigint").alias("_q"),
                       F.struct(*lcols).alias("_l"), F.lit(None).alias("_r"))
    rank = (F.col("_q") if not order_cols else None)
    rstruct = F.struct(*fields)
    rsel = right.select(*on, (_micros(F.col(right_time)) * sign).alias("_t"),
                        F.lit(1 if strict else 0).alias("_side"),
                        ((order_cols[0].cast("bigint") * sign) if order_cols else F.lit(0).cast("bigint")).alias("_q"),
                        F.lit(None).alias("_l"), rstruct.alias("_r"))
    del rank
    u = lsel.unionByName(rsel).withColumn("_tb", F.expr(f"cast(floor(_t / {bucket_us}) as bigint)"))
    w = (Window.partitionBy(*on, "_tb").orderBy("_t", "_side", "_q")
         .rowsBetween(Window.unboundedPreceding, 0))
    local = u.withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
    before = Window.partitionBy(*on).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    tails = (u.groupBy(*on, "_tb")
             .agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_q"))).alias("_last"))
             .withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last"))
    res = (local.where(F.col("_l").isNotNull()).join(tails, [*on, "_tb"])
           .withColumn("_hit", F.coalesce("_hit", "_carry")))
    if tolerance is not None:
        near = F.abs(_micros(F.col(f"_hit.{right_time}")) - _micros(F.col(f"_l.{left_time}")))
        res = res.withColumn("_hit", F.when(near <= F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00' + "
                                                           f"interval {tolerance}) - "
                                                           f"unix_micros(timestamp'1970-01-01 00:00:00')"),
                                            F.col("_hit")))
    return res.select(*[F.col(f"_l.{c}").alias(c) for c in lcols],
                      *[F.col(f"_hit.{c}").alias(prefix + c) for c in bring])


def interval_join(points: DataFrame, spans: DataFrame, on: Sequence[str], point: str, lo: str, hi: str, *,
                  width: float, how: str = "inner", closed: str = "both") -> DataFrame:
    """Points inside spans: spans are copied to every bucket of `width` they touch, then joined by equality.

    `point`, `lo`, `hi` are numbers (epoch micros, row numbers).  closed: both, left ([lo, hi)), right ((lo, hi]).
    """
    a = points.withColumn("_b", F.floor(F.col(point) / F.lit(width)).cast("bigint"))
    b = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / F.lit(width)).cast("bigint"),
                                                    F.floor(F.col(hi) / F.lit(width)).cast("bigint"))))
    p, x, y = F.col(point), F.col(lo), F.col(hi)
    inside = {"both": (p >= x) & (p <= y), "left": (p >= x) & (p < y), "right": (p > x) & (p <= y)}[closed]
    keyed = F.col("a._b") == F.col("b._b")
    for k in on:
        keyed = keyed & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = a.alias("a").join(b.alias("b"), keyed & inside, how)
    keep_b = [F.col(f"b.{c}") for c in spans.columns if c not in on]
    return joined.select(*[F.col(f"a.{c}") for c in points.columns], *keep_b)


def first_match(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every group in `order`, as one aggregation with map-side combine (no sort of the group)."""
    rest = [c for c in df.columns if c not in by]
    return (df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m"))
            .select(*by, *[F.col(f"_m.{c}").alias(c) for c in rest]))
