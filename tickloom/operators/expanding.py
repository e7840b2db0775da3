"""Exact expanding medians over long series, and the regimes that are told with them.

The median of the rows up to t is an order statistic of all earlier rows, which no block holds.  A block of B rows moves it by at
most B / 2 ranks, though, so of all earlier rows a block needs only those near their middle and the number of rows below.
Value ranges (a sketch of the key's values) are counted per block, prefix sums of the counts give the ranges that hold the
middle ranks of what came before each block, and only rows of those ranges are sent to it.  The sketch decides how many rows
travel, never what the median is.
"""
from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import RN, Series, kept
from .indicators import adx

BLOCK, RANGES = 1 << 12, 512
_ARR = T.ArrayType(T.DoubleType())


def expanding_median(s: Series, x: str, out: str = "median", block: int = BLOCK, ranges: int = RANGES) -> DataFrame:
    """keys, row number and the median of `x` over all rows of the key up to this one; rows with a null x have none.

    A key has at most `ranges` blocks (longer keys get longer ones), so a row of a middle range is sent to at most that many.
    """
    keys = s.keys
    d = s.flat().df.select(*keys, RN, F.col(x).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    step = 1.0 / ranges
    stat = d.groupBy(*keys).agg(F.greatest(F.lit(block), F.ceil((F.max(RN) + 1) / ranges)).cast("long").alias("_b"),
                                F.percentile_approx("_x", F.array(*[F.lit(i * step) for i in range(1, ranges)]), 4 * ranges).alias("_edges"))
    both = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))
    rows = kept(both(d, stat.select(*keys, "_b")).withColumn("_blk", F.expr(f"{RN} div _b")).drop("_b").repartition(*keys, "_blk"))
    blocks = both(rows.select(*keys, "_blk").distinct(), stat.select(*keys, "_edges"))
    own = [d.schema[k] for k in keys]
    schema = lambda *more: T.StructType([*own, *[T.StructField(n, t) for n, t in more]])

    def blockwise(info: DataFrame, fn, *cols):
        names = [*keys, *[n for n, _ in cols]]
        info = info.select(*[F.col(c).alias(c) for c in info.columns])

        def run(left, right):
            if not len(left) or not len(right):
                return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
            made = fn(left.sort_values(RN), right)
            for k in keys:
                made[k] = left[k].iloc[0]
            return made[names]
        return rows.groupBy(*keys, "_blk").cogroup(info.groupBy(*keys, "_blk")).applyInPandas(run, schema(*cols))

    def histogram(left, right):
        edges = np.asarray(right["_edges"].iloc[0], float)
        h = np.bincount(np.searchsorted(edges, left["_x"].to_numpy(), side="right"), minlength=ranges)
        return pd.DataFrame({"_blk": left["_blk"].iloc[:1].to_numpy(), "_h": [h.tolist()], "_edges": [edges]})

    def middles(pdf):
        """For each block the ranges lo..hi that hold the middle ranks of all earlier rows."""
        pdf = pdf.sort_values("_blk")
        h = np.array(pdf["_h"].tolist(), np.int64)
        before = np.cumsum(h, axis=0) - h
        n, size = before.sum(axis=1), h.sum(axis=1)
        upto = np.cumsum(before, axis=1)
        first, last = (n - size - 1) // 2, (n + size) // 2 + 1             # ranks; beyond the earlier rows, any own row may be the median
        lo = np.array([int(np.searchsorted(u, r, side="right")) if r >= 0 else 0 for u, r in zip(upto, first)])
        hi = np.array([int(np.searchsorted(u, r, side="right")) if r < a else ranges - 1 for u, r, a in zip(upto, last, n)])
        under = np.array([u[a - 1] if a else 0 for u, a in zip(upto, lo)])
        out = pd.DataFrame({"_blk": pdf["_blk"].to_numpy(), "_lo": lo, "_hi": hi, "_under": under, "_n": n, "_edges": list(pdf["_edges"])})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_blk", "_lo", "_hi", "_under", "_n", "_edges"]]

    long = T.LongType()
    hist = blockwise(blocks, histogram, ("_blk", long), ("_h", T.ArrayType(long)), ("_edges", _ARR))
    info = kept(hist.groupBy(*keys).applyInPandas(middles, schema(("_blk", long), ("_lo", long), ("_hi", long), ("_under", long), ("_n", long), ("_edges", _ARR))))
    span = both(info.select(*keys, "_blk", "_edges"), info.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))

    def middle_rows(left, right):
        r = right.iloc[0]
        at = np.searchsorted(np.asarray(r["_edges"], float), left["_x"].to_numpy(), side="right")
        held = (at >= r["_lo"]) & (at <= r["_hi"])
        return pd.DataFrame({"_from": left["_blk"].to_numpy()[held], "_range": at[held], "_x": left["_x"].to_numpy()[held]})

    sent = blockwise(span, middle_rows, ("_from", long), ("_range", long), ("_x", T.DoubleType()))
    wants = info.where("_n > 0").select(*keys, F.col("_blk"), F.explode(F.sequence("_lo", "_hi")).alias("_range"))
    sent = sent.join(wants, [*keys, "_range"]).where("_from < _blk").select(*keys, "_blk", "_x")
    # what a block gets: one row with its bracket, and the middle rows of earlier blocks
    given = info.select(*keys, "_blk", "_lo", "_hi", "_under", "_n", "_edges", F.lit(None).cast("double").alias("_x")).unionByName(sent, allowMissingColumns=True)

    def medians(left, right):
        r = right[right["_x"].isna()].iloc[0]
        held = sorted(right["_x"].dropna())
        lo, hi, under, n = int(r["_lo"]), int(r["_hi"]), int(r["_under"]), int(r["_n"])
        v = left["_x"].to_numpy()
        at = np.searchsorted(np.asarray(r["_edges"], float), v, side="right")
        out = np.empty(len(v))
        for i, (value, place) in enumerate(zip(v.tolist(), at.tolist())):
            if lo <= place <= hi:
                insort(held, value)
            elif place < lo:
                under += 1
            n += 1
            a, b = (n - 1) // 2 - under, n // 2 - under
            out[i] = (held[a] + held[b]) / 2
        return pd.DataFrame({RN: left[RN].to_numpy(), out_name: out})

    out_name = out
    return blockwise(given, medians, (RN, long), (out, T.DoubleType()))


def estimate_regimes(s: Series, adx_n: int = 14, adx_trend: float = 25.0, vol_n: int = 20, block: int = BLOCK) -> DataFrame:
    """Rows with `trend` (ADX above a level), `high_vol` (deviation of log returns above its expanding median), both 0 or 1 and
    known at the close, and the name of the regime."""
    s = s.halo(vol_n + 1)
    s = s.add(_lr=F.log(F.col("close") / s.lag("close")), back=1, uses=["close"])
    s = s.add(vol=s.std("_lr", vol_n), back=vol_n - 1, uses=["_lr"])
    d = adx(s, adx_n)
    rows = kept(d.flat().df.select(*s.keys, *[c for c in s.spec.order if c not in s.keys], RN, "adx", "vol"))
    vols = Series(rows.withColumn("_blk", F.lit(0)), s.spec, s.block)
    med = expanding_median(vols, "vol", "vol_median", block)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    out = rows.join(med, [*s.keys, RN], "left").withColumn("trend", flag(F.col("adx") > adx_trend)).withColumn("high_vol", flag(F.col("vol") > F.col("vol_median")))
    return out.withColumn("regime", regime_name("trend", "high_vol"))


def regime_name(trend: str, high_vol: str):
    return F.concat(F.when(F.col(trend) == 1, "trend").otherwise("range"), F.lit("/"), F.when(F.col(high_vol) == 1, "high vol").otherwise("low vol"))
