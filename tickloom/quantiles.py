"""Exact quantiles and order statistics without sorting a group in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float],
                names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles per key, one row per key.

    A sketch brackets each wanted rank; one aggregation counts what lies below the bracket and how often each value
    inside it occurs; the wanted order statistics are read off that small table.  Exact, and every step combines
    before the shuffle.
    """
    keys = list(keys)
    names = list(names or [f"p{i}" for i in range(len(ps))])
    eps = 3.0 / ACCURACY
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    edges = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.percentile_approx("_x", F.array(F.lit(max(p - eps, 0.0)), F.lit(min(p + eps, 1.0))),
                              ACCURACY).alias(f"_e{i}") for i, p in enumerate(ps)])
    want = edges.select(*keys, "_n", F.posexplode(F.array(*[
        F.struct(F.col(f"_e{i}")[0].alias("a"), F.col(f"_e{i}")[1].alias("b"), F.lit(float(p)).alias("p"))
        for i, p in enumerate(ps)])).alias("_i", "_q")).select(
            *keys, "_n", "_i", "_q.*").withColumn("_h", (F.col("_n") - 1) * F.col("p"))
    hit = v.join(want, keys) if keys else v.crossJoin(F.broadcast(want))
    # value class: below the bracket and above it only the nearest value and the count matter
    cls = F.when(F.col("_x") < F.col("a"), -1).when(F.col("_x") > F.col("b"), 1).otherwise(0)
    grp = (hit.withColumn("_c", cls)
           .groupBy(*keys, "_i", "_n", "_h", "_c", F.when(F.col("_c") == 0, F.col("_x")).alias("_k"))
           .agg(F.count(F.lit(1)).alias("_m"), F.max("_x").alias("_hi"), F.min("_x").alias("_lo"))
           .withColumn("_val", F.when(F.col("_c") == 1, F.col("_lo")).otherwise(F.col("_hi"))))
    w = Window.partitionBy(*keys, "_i").orderBy("_val").rowsBetween(Window.unboundedPreceding, 0)
    cum = grp.withColumn("_upto", F.sum("_m").over(w))
    lo_rank, hi_rank = F.floor("_h"), F.ceil("_h")
    stat = cum.groupBy(*keys, "_i", "_h").agg(
        F.min(F.when(F.col("_upto") > lo_rank, F.col("_val"))).alias("_v0"),
        F.min(F.when(F.col("_upto") > hi_rank, F.col("_val"))).alias("_v1"))
    val = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_h") - F.floor("_h"))
    return stat.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, val)).alias(n) for i, n in enumerate(names)])


def kth_smallest(df: DataFrame, keys: Sequence[str], value: str, k: str) -> DataFrame:
    """k-th smallest value per key (k: SQL expression of the group size `n`, 1-based; NULL when k > n)."""
    keys = list(keys)
    cnt = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_m"))
    tot = cnt.groupBy(*keys).agg(F.sum("_m").alias("n")).withColumn("_k", F.expr(k)).drop("n")
    joined = cnt.join(tot, keys) if keys else cnt.crossJoin(F.broadcast(tot))
    w = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    return (joined.withColumn("_u", F.sum("_m").over(w)).groupBy(*keys)
            .agg(F.min(F.when(F.col("_u") >= F.col("_k"), F.col("_x"))).alias("kth")))
