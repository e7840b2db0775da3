"""Labels, folds and models over tables with pyspark.ml."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import interval_join
from ..series import RN, Series, SeriesSpec, kept
from .patterns import cusum_events


def triple_barrier(bars: DataFrame, events: DataFrame, keys: list[str], pt=1.0, sl=1.0, max_hold=10, close="close") -> DataFrame:
    """First touch of a volatility barrier in the next bars, else the last bar of the path: t1, return, label.

    bars: keys, rn, close.  events: keys, t0_rn, entry price `c0`, `vol`.  One bucketed range join, one aggregation.
    """
    e = events.where(F.col("vol").isNotNull()).withColumns({"_lo": F.col("t0_rn") + 1, "_hi": F.col("t0_rn") + max_hold})
    j = interval_join(bars.select(*keys, RN, F.col(close).alias("_c")), e, keys, RN, "_lo", "_hi", width=max(4 * max_hold, 64))
    ret = F.col("_c") / F.col("c0") - 1
    j = j.withColumn("_r", ret)
    hit = (F.col("_r") >= pt * F.col("vol")) | (F.col("_r") <= -sl * F.col("vol"))
    # touched rows come before untouched ones; untouched rows prefer the last
    order = F.struct(F.when(hit, 0).otherwise(1), F.when(hit, F.col(RN)).otherwise(-F.col(RN)))
    g = j.groupBy(*keys, "t0_rn", "vol").agg(F.min_by(F.struct(F.col(RN).alias("t1_rn"), F.col("_r").alias("ret")), order).alias("_m"))
    g = g.select(*keys, "t0_rn", "vol", "_m.*")
    return g.withColumn("label", F.when(F.col("ret") >= pt * F.col("vol"), 1).when(F.col("ret") <= -sl * F.col("vol"), -1).otherwise(0)).drop("vol")


def meta_labels(side: str, ret: str) -> Column:
    return (F.col(side) * F.col(ret) > 0).cast("int")


def meta_dataset(s: Series, h=0.015, max_hold=10, span=50) -> DataFrame:
    """Events of the CUSUM filter with barriers, features, side and label joined at t0."""
    from .indicators import daily_vol, ml_features, momentum_side
    keys = s.keys
    s = momentum_side(ml_features(s), lookback=20)
    s = cusum_events(daily_vol(s, "close", span, "_vol"), h, out="_event")
    d = kept(s.flat().df)
    ev = d.where("_event").select(*keys, F.col(RN).alias("t0_rn"), F.col("close").alias("c0"), F.col("_vol").alias("vol"))
    tb = triple_barrier(d, ev, keys, max_hold=max_hold)
    feats = d.select(*keys, F.col(RN).alias("t0_rn"), "ret5", "ret20", "vol20", "vol_ratio", "er10", "volume_z", "side")
    return tb.join(feats, [*keys, "t0_rn"]).withColumn("y", meta_labels("side", "ret"))


def assemble(df: DataFrame, cols: list[str], out="features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df.dropna(subset=cols))


def make_model(kind: str, seed=0, n: int | None = None, weight: str | None = None, label="y"):
    """logit (penalty of C = 1 on n rows), forest or boosting estimators with an optional weight column."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    if kind == "logit":
        m = LogisticRegression(labelCol=label, regParam=1.0 / n if n else 0.0, standardization=False, maxIter=100)
    elif kind == "rf":
        m = RandomForestClassifier(labelCol=label, numTrees=50, maxDepth=5, seed=seed)
    elif kind == "gbt":
        m = GBTClassifier(labelCol=label, maxIter=20, maxDepth=3, seed=seed)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return m.setWeightCol(weight) if weight else m


def prob1(model, df: DataFrame, out="prob") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).withColumn(out, vector_to_array("probability")[1])


def auc(df: DataFrame, score="prob", label="y", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks of the distinct scores."""
    c = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(label)).cast("double").alias("_p"), F.count(F.lit(1)).cast("double").alias("_n"))
    s = Series.of(c, SeriesSpec(by, ("_s",), "cast(floor(_s * 4096) as bigint)")).running({"_cn": ("sum", F.col("_n"))})
    avg_rank = F.col("_cn") - (F.col("_n") - 1) / 2
    g = s.df.groupBy(*by).agg(F.sum(F.col("_p") * avg_rank).alias("_rs"), F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
    P, N = F.col("_P"), F.col("_N") - F.col("_P")
    return g.select(*by, F.try_divide(F.col("_rs") - P * (P + 1) / 2, P * N).alias("auc"))


def log_loss(df: DataFrame, score="prob", label="y") -> Column:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    return F.avg(-(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p)))


def cv_predictions(df: DataFrame, folds: list[tuple[Column, Column]], kind="logit", features="features", label="y", weight: str | None = None, seed=0) -> DataFrame:
    """Out-of-fold probabilities.  A fold is a pair of row predicates (train, test); models of the folds are independent jobs."""
    out = None
    for i, (tr, te) in enumerate(folds):
        train = df.where(tr)
        n = train.count() if kind == "logit" else None
        m = make_model(kind, seed, n, weight, label).fit(train)
        p = prob1(m, df.where(te)).withColumn("fold", F.lit(i)).drop("rawPrediction", "probability", "prediction")
        out = p if out is None else out.unionByName(p)
    return out


def walk_forward_logit(df: DataFrame, keys: list[str], rn: str, place: str, cuts: list[float], label="y", fwd="fwd", cost_bps=5.0) -> DataFrame:
    """Expanding refits at the shares `cuts` of each key's rows (`place`: row number over row count); the model is pooled over
    the keys.  Sign positions, next return less the cost of position changes."""
    ends = [*cuts[1:], 2.0]
    folds = [(F.col(place) < lo, (F.col(place) >= lo) & (F.col(place) < hi)) for lo, hi in zip(cuts, ends)]
    p = cv_predictions(df, folds, "logit", label=label).withColumn("pos", F.when(F.col("prob") > 0.5, 1.0).otherwise(-1.0))
    s = Series.of(kept(p.select(*keys, rn, "pos", fwd, label)), SeriesSpec(tuple(keys), (rn,), f"{rn} div 100000"), 1)
    return s.add(net=F.col("pos") * F.col(fwd) - cost_bps / 1e4 * F.abs(F.col("pos") - F.coalesce(s.lag("pos"), F.lit(0.0)))).done()


def purged_predicates(rn: str, n: str, k=5, horizon=5, embargo=0.01) -> list[tuple[Column, Column]]:
    """(train, test) of k contiguous folds from each row's number and the row count of its key."""
    from .resample import equal_blocks
    out = []
    for i in range(k):
        lo, hi = equal_blocks(F.col(n), k, F.lit(i))
        test = F.col(rn).between(lo, hi)
        out.append(((F.col(rn) + horizon < lo) | (F.col(rn) > hi + F.ceil(embargo * F.col(n))), test))
    return out


def calibrate(cal: DataFrame, apply_to: DataFrame, score="prob", label="y", method="isotonic") -> DataFrame:
    """Calibrated probability from a later set: isotonic regression or a one-variable logit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import IsotonicRegression
    if method == "isotonic":
        m = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(cal.withColumn(label, F.col(label).cast("double")))
        return m.transform(apply_to)
    m = LogisticRegression(labelCol=label).fit(assemble(cal, [score], "_f").withColumnRenamed("_f", "features").withColumn(label, F.col(label).cast("double")))
    return prob1(m, assemble(apply_to, [score], "features"), "calibrated")


def gmm_regimes(df: DataFrame, cols: list[str], n=2, seed=0) -> DataFrame:
    """Mixture states on standardized features, numbered by the mean of the first feature."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler
    x = assemble(df, cols, "_raw")
    x = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(x).transform(x)
    d = GaussianMixture(k=n, seed=seed).fit(x).transform(x)
    from pyspark.sql import Window
    order = d.groupBy("prediction").agg(F.avg(cols[0]).alias("_m")).withColumn("state", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_m")) - 1)
    return d.join(F.broadcast(order.select("prediction", "state")), "prediction").drop("_raw", "features", "prediction", "probability")


def permuted(df: DataFrame, cols: list[str], row: str, seed: int) -> DataFrame:
    """Columns shuffled together over the rows by matching two hash orders."""
    from ..series import index_rows
    a = index_rows(df.withColumn("_h1", F.xxhash64(F.lit(seed), row)), SeriesSpec((), ("_h1", row), "shiftright(_h1, 54)"), "_i").drop("_h1", *cols)
    b = index_rows(df.select(row, *cols).withColumn("_h2", F.xxhash64(F.lit(seed + 1), row)), SeriesSpec((), ("_h2", row), "shiftright(_h2, 54)"), "_i").select("_i", *cols)
    return a.join(b, "_i").drop("_i")


def mda_importance(df: DataFrame, cols: list[str], groups: dict[str, list[str]], train: Column, test: Column, row: str, kind="logit", seed=0) -> DataFrame:
    """Log-loss increase on the test rows when a feature (or group) is permuted."""
    x = df.dropna(subset=cols)
    tr = assemble(x.where(train), cols)
    m = make_model(kind, seed, tr.count()).fit(tr)
    te = kept(x.where(test))
    base = prob1(m, assemble(te, cols)).agg(log_loss(te).alias("_b"))
    out = None
    for name, members in groups.items():
        p = prob1(m, assemble(permuted(te, members, row, seed), cols)).agg(log_loss(te).alias("_l")).withColumn("feature", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out.crossJoin(F.broadcast(base)).select("feature", (F.col("_l") - F.col("_b")).alias("importance"))


def mdi_importance(df: DataFrame, cols: list[str], label="y", seed=0) -> DataFrame:
    m = make_model("rf", seed, label=label).fit(assemble(df, cols))
    v = m.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(cols, v)], "feature string, importance double")


def sfi_importance(df: DataFrame, cols: list[str], train: Column, test: Column, kind="logit") -> DataFrame:
    """AUC of single-feature models."""
    out = None
    for c in cols:
        x = assemble(df, [c])
        tr = x.where(train)
        p = auc(prob1(make_model(kind, 0, tr.count()).fit(tr), x.where(test))).withColumn("feature", F.lit(c))
        out = p if out is None else out.unionByName(p)
    return out


def cluster_features(df: DataFrame, cols: list[str], threshold=0.5) -> DataFrame:
    """Average-linkage clusters on 1 - |corr|; the correlation matrix is one aggregation, linkage runs on that matrix."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = df.agg(*[F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    d = {(i, j): 1 - abs(row[f"c{i}_{j}"] or 0.0) for i, j in pairs}
    cl = [[i] for i in range(len(cols))]
    dist = lambda a, b: float(np.mean([d[min(i, j), max(i, j)] for i in a for j in b]))
    while len(cl) > 1:
        v, i, j = min((dist(cl[i], cl[j]), i, j) for i in range(len(cl)) for j in range(i + 1, len(cl)))
        if v > threshold:
            break
        cl[i] += cl.pop(j)
    return df.sparkSession.createDataFrame([(cols[i], k) for k, c in enumerate(cl) for i in c], "feature string, cluster int")


def leakage_audit(df: DataFrame, cols: list[str], train: Column, test: Column, row: str, label="y", kind="logit", seed=0, tol=0.05) -> DataFrame:
    """Shuffled labels must score about 0.5; a planted leak must be found; overlap of train and test spans is counted elsewhere."""
    def score(x, c):
        a = assemble(x, c)
        tr = a.where(train)
        return auc(prob1(make_model(kind, seed, tr.count(), label=label).fit(tr), a.where(test)), label=label)
    base = df.dropna(subset=cols)
    shuf = score(permuted(base, [label], row, seed), cols).select(F.lit("shuffled_labels").alias("check"), "auc")
    canary = base.withColumn("_leak", F.col(label) + F.randn(seed) * 0.3)
    can = score(canary, [*cols, "_leak"]).select(F.lit("canary").alias("check"), "auc")
    u = shuf.unionByName(can)
    return u.withColumn("passed", F.when(F.col("check") == "canary", F.col("auc") > 0.9).otherwise(F.abs(F.col("auc") - 0.5) <= tol))


def seed_ensemble(train: DataFrame, test: DataFrame, row: str, kind="rf", seeds=(0, 1, 2)) -> DataFrame:
    """Mean probability over models that differ in the seed only."""
    u = None
    for s in seeds:
        p = prob1(make_model(kind, s).fit(train), test).select(row, "prob")
        u = p if u is None else u.unionByName(p)
    return u.groupBy(row).agg(F.avg("prob").alias("prob"))


def vol_forecasts(har: DataFrame, train: Column, test: Column) -> DataFrame:
    """Naive, linear and boosted forecasts of the next absolute return on the test rows."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    x = assemble(har, ["d", "w", "m"]).withColumnRenamed("target", "label")
    lin = LinearRegression(predictionCol="linear").fit(x.where(train))
    gbt = GBTRegressor(predictionCol="boosted", maxIter=10, maxDepth=3, seed=0).fit(x.where(train))
    return gbt.transform(lin.transform(x.where(test))).withColumn("naive", F.col("d")).drop("features")


def crash_warning(df: DataFrame, cols: list[str], train: Column, test: Column, label="label") -> DataFrame:
    """Class-balanced logit on resolved labels."""
    x = assemble(df.where(F.col(label).isNotNull()), cols).withColumn("y", F.col(label).cast("int"))
    tr = x.where(train)
    n = tr.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    tot = tr.agg(F.count(F.lit(1)).alias("_t"))
    tr = tr.join(F.broadcast(n), "y").crossJoin(F.broadcast(tot)).withColumn("_w", F.col("_t") / (2 * F.col("_n")))
    return prob1(make_model("logit", weight="_w").fit(tr), x.where(test)).drop("features", "rawPrediction", "probability", "prediction")

