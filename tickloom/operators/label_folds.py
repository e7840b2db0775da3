"""Folds and walk-forward fits over labels that take time to resolve.

A label starts at t0 and is known at t1.  Both procedures here keep a row out of every fit whose test rows its span touches,
without making rows times folds: a row carries the few folds that leave it out, or the first window that may use it.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import bet_size
from ..joins import asof_join
from ..series import Series, SeriesSpec, index_rows, kept

POS = "pos"


def positions(labels: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Position of each label in its key, and the labels of the key (`n`)."""
    return index_rows(labels, spec, POS, "n")


def fold_of(pos: Column, n: Column, k: int) -> Column:
    """Contiguous folds of nearly equal size, the longer ones first."""
    base, extra = F.floor(n / k), n % k
    head = extra * (base + 1)
    return F.when(pos < head, F.floor(pos / (base + 1))).otherwise(extra + F.floor((pos - head) / F.greatest(base, F.lit(1)))).cast("int")


def purged_kfold(labels: DataFrame, spec: SeriesSpec, t0: str, t1: str, k: int = 5, embargo: float = 0.01) -> DataFrame:
    """Each label with its test fold and `purged`, the other folds whose training set leaves it out.

    A label trains for a fold if it is known before the first test label starts, or starts after the last test label is known
    and after the embargo: the label ceil(embargo * n) places behind the test fold.  The spans of the k folds are one row a
    key, so rows meet an array of k spans and nothing is multiplied.
    """
    keys = list(spec.keys)
    d = positions(labels, spec).withColumn("fold", fold_of(F.col(POS), F.col("n"), k))
    d = kept(d)
    base, extra = F.floor(F.col("n") / k), F.col("n") % k
    last = lambda f: (f + 1) * base + F.least(f + 1, extra) - 1
    wait = F.ceil(F.lit(embargo) * F.col("n"))
    ends = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.least(last(f) + wait, F.col("n") - 1) == F.col(POS))
    quiet = d.select(*keys, F.explode(ends).alias("fold"), F.col(t0).alias("_quiet"))          # k rows a key
    spans = d.groupBy(*keys, "fold").agg(F.min(t0).alias("_from"), F.max(t1).alias("_to")).join(quiet, [*keys, "fold"])
    spans = spans.groupBy(*keys).agg(F.collect_list(F.struct("fold", F.col("_from").alias("a"), F.greatest("_to", "_quiet").alias("b"))).alias("_spans"))
    hit = F.filter("_spans", lambda s: (s["fold"] != F.col("fold")) & (F.col(t1) >= s["a"]) & (F.col(t0) <= s["b"]))
    return d.join(spans, keys).withColumn("purged", F.array_sort(F.transform(hit, lambda s: s["fold"]))).drop("_spans", "n")


def purged_training(folds: DataFrame, fold: int) -> tuple[Column, Column]:
    """(train, test) predicates of one fold on rows of `purged_kfold`."""
    test = F.col("fold") == fold
    return ~test & ~F.array_contains("purged", fold), test


# ---------------------------------------------------------------- walk-forward meta labels
def discriminant(sums: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted linear discriminants from sums a row: weights of the classes 0 and 1, sums of x of each, sums of x x'.

    Returns coefficients (rows, m) and intercepts; with one class only, the intercept is plus or minus infinity; without any
    known label, NaN.
    """
    w0, w1 = sums[:, 0], sums[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m0, m1 = sums[:, 2:2 + m] / w0[:, None], sums[:, 2 + m:2 + 2 * m] / w1[:, None]
        upper = np.triu_indices(m)
        xx = np.zeros((len(sums), m, m))
        xx[:, upper[0], upper[1]] = sums[:, 2 + 2 * m:]
        xx[:, upper[1], upper[0]] = sums[:, 2 + 2 * m:]
        cov = (xx - w0[:, None, None] * m0[:, :, None] * m0[:, None, :] - w1[:, None, None] * m1[:, :, None] * m1[:, None, :]) / (w0 + w1)[:, None, None]
        prior = np.log(w1) - np.log(w0)
    both = (w0 > 0) & (w1 > 0)
    coef = np.zeros((len(sums), m))
    if both.any():
        coef[both] = (np.linalg.pinv(cov[both], hermitian=True) @ (m1 - m0)[both][:, :, None])[:, :, 0]
    bias = np.where(both, prior - 0.5 * (np.where(both[:, None], m0 + m1, 0) * coef).sum(axis=1), np.where((w0 <= 0) & (w1 <= 0), np.nan, prior))
    return coef, bias


def walk_forward_meta(labels: DataFrame, spec: SeriesSpec, t0: str, t1: str, features: list[str], y: str = "y", ret: str = "ret", w: str | None = None,
                      start: float = 1 / 3, retrain_every: int = 100, cost_bps: float = 5.0) -> DataFrame:
    """Out-of-sample probability that the primary side is right, bet size, and profit of both arms, for each label from
    position floor(start * n) on.

    Windows of `retrain_every` labels; the fit of a window uses the labels known strictly before its first label starts.  A
    label enters at one window, so the sums that fit a window are running sums over windows and all windows are fitted at
    once: rows are read once, not once a window.  The fit is a weighted linear discriminant, whose sums add; `known` is the
    number of labels behind it.  t0 and t1 are row numbers or times in whole seconds.
    """
    keys, m = list(spec.keys), len(features)
    first = F.floor(F.lit(start) * F.col("n"))
    d = kept(positions(labels, spec).withColumn("window", F.when(F.col(POS) >= first, F.floor((F.col(POS) - first) / retrain_every)).cast("long"))
             .withColumn("_begins", F.coalesce(((F.col(POS) - first) % retrain_every == 0) & F.col("window").isNotNull(), F.lit(False))))
    at = lambda c: F.col(c).cast("timestamp")
    windows = d.where("_begins").select(*keys, "window", at(t0).alias("_at"))
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    x = [F.col(f).cast("double") for f in features]
    is1 = F.col(y).cast("int") == 1
    cols = [F.when(is1, 0.0).otherwise(weight), F.when(is1, weight).otherwise(0.0),
            *[F.when(is1, 0.0).otherwise(weight * c) for c in x], *[F.when(is1, weight * c).otherwise(0.0) for c in x],
            *[weight * x[i] * x[j] for i in range(m) for j in range(i, m)]]
    rows = d.select(*keys, at(t1).alias("_known"), *[c.alias(f"s{i}") for i, c in enumerate(cols)])
    rows = asof_join(rows, windows, keys, "_known", "_at", ["window"], right_order=["window"])
    names = [f"s{i}" for i in range(len(cols))]
    sums = rows.groupBy(*keys, F.coalesce(F.col("window") + 1, F.lit(0)).cast("long").alias("window")).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(s).alias(s) for s in names])
    sums = windows.select(*keys, "window").join(sums, [*keys, "window"], "left").na.fill(0, ["_c", *names])
    run = Series.of(sums, SeriesSpec(tuple(keys), ("window",), "window div 65536")).running({"known": ("sum", F.col("_c")), **{f"t{i}": ("sum", F.col(s)) for i, s in enumerate(names)}})
    run = run.done().select(*keys, "window", "known", *[f"t{i}" for i in range(len(names))])

    def fit(batches):
        for b in batches:
            coef, bias = discriminant(b[[f"t{i}" for i in range(len(names))]].to_numpy(float), m)
            yield b[[*keys, "window", "known"]].assign(coef=list(coef), bias=bias)

    schema = T.StructType([*[run.schema[k] for k in keys], T.StructField("window", T.LongType()), T.StructField("known", T.LongType()),
                           T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("bias", T.DoubleType())])
    fits = run.mapInPandas(fit, schema)
    o = d.where("window is not null").join(fits, [*keys, "window"])
    score = sum((F.col("coef")[i] * c for i, c in enumerate(x)), F.col("bias"))
    o = o.withColumn("prob", F.when(F.isnan("bias"), F.lit(None)).when(F.col("bias") == float("inf"), 1.0).when(F.col("bias") == float("-inf"), 0.0).otherwise(1 / (1 + F.exp(-score))))
    cost = 2 * cost_bps / 1e4
    return (o.withColumn("size", bet_size("prob")).withColumn("primary", F.col(ret) - cost).withColumn("meta", F.col("size") * F.col(ret) - cost * F.col("size"))
            .select(*keys, POS, "window", "known", t0, t1, "prob", "size", F.col(y).alias("y"), "primary", "meta"))


def meta_summary(oos: DataFrame, keys: list[str], years: float) -> DataFrame:
    """Trades, precision, total and yearly Sharpe ratio of the primary and the meta arm."""
    arm = lambda name, taken: F.struct(F.lit(name).alias("arm"), F.col(name).alias("pnl"), taken.alias("taken"))
    d = oos.select(*keys, "y", F.inline(F.array(arm("primary", F.lit(True)), arm("meta", F.coalesce(F.col("size") > 0, F.lit(False))))))
    per_year = F.sqrt(F.count(F.lit(1)) / years)
    return d.groupBy(*keys, "arm").agg(
        F.sum(F.col("taken").cast("int")).alias("trades"), F.avg(F.when(F.col("taken"), F.col("y").cast("double"))).alias("precision"),
        F.sum("pnl").alias("total"), (F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")) * per_year).alias("sharpe"))
