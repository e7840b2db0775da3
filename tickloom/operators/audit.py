"""Property audits of registered indicators: length, warm-up, no look-ahead, scale invariance."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import RN, Series, SeriesSpec
from .registry import REGISTRY, compute, lookback


def truncation_diff(df: DataFrame, spec: SeriesSpec, job, cut, columns: list[str] | None = None, tol=1e-9) -> DataFrame:
    """Rows whose value changes when all later rows are removed.  `job(df) -> df` keeps the keys and the order columns.

    A prefix-only operator gives the same values on the frame cut at `cut` (a value of the first order column).
    """
    on = [*spec.keys, *spec.order]
    full = job(df).where(F.col(spec.order[0]) <= cut)
    part = job(df.where(F.col(spec.order[0]) <= cut))
    cols = columns or [c for c in full.columns if c not in df.columns]
    j = full.select(*on, *[F.col(c).alias(f"a_{c}") for c in cols]).join(part.select(*on, *[F.col(c).alias(f"b_{c}") for c in cols]), on)
    bad = F.lit(False)
    for c in cols:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        same = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= tol * (1 + F.abs(a.cast("double"))), F.lit(False))
        bad = bad | ~same
    return j.where(bad)


def audit_indicator(df: DataFrame, spec: SeriesSpec, name: str, cut, **params) -> DataFrame:
    """One row: rows in and out, nulls beyond the look-back, look-ahead differences."""
    out = compute(df, spec, (name, params), keep_rn=True)
    cols = [c for c in out.columns if c not in (*df.columns, RN)]
    back = lookback(name, **params)
    late = None
    for c in cols:
        x = F.col(c).isNull() & (F.col(RN) >= back)
        late = x if late is None else late | x
    n_in = df.agg(F.count(F.lit(1)).alias("rows_in"))
    g = out.agg(F.count(F.lit(1)).alias("rows_out"), F.count(F.when(late, 1)).alias("late_nulls"))
    diff = truncation_diff(df, spec, lambda d: compute(d, spec, (name, params)), cut, cols).agg(F.count(F.lit(1)).alias("look_ahead"))
    ok = (F.col("rows_in") == F.col("rows_out")) & (F.col("look_ahead") == 0)
    return n_in.crossJoin(g).crossJoin(diff).select(F.lit(name).alias("name"), "rows_in", "rows_out", "late_nulls", "look_ahead", ok.alias("passed"))


def scale_diff(df: DataFrame, spec: SeriesSpec, job, prices: list[str], factor=10.0) -> DataFrame:
    """Rows whose value depends on the price unit (for operators that claim not to)."""
    on = [*spec.keys, *spec.order]
    a = job(df)
    cols = [c for c in a.columns if c not in df.columns]
    b = job(df.withColumns({p: F.col(p) * factor for p in prices}))
    j = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(*on, *[F.col(c).alias(f"b_{c}") for c in cols]), on)
    bad = F.lit(False)
    for c in cols:
        bad = bad | (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > 1e-7 * (1 + F.abs(F.col(f"a_{c}"))))
    return j.where(bad)


def leaky_smooth(s: Series, x="close", n=5, out="leak") -> Series:
    """Centred mean: uses later rows.  Kept as the operator every audit must catch."""
    h = n // 2
    s = s.ready([x], h, h)
    return s.add({out: F.avg(x).over(s.rows(-h, h))})


def registered() -> list[str]:
    return [n for n, s in REGISTRY.items() if s.prefix_only]
