"""Replicate tables, fold tables and overfitting checks.

Random procedures draw from xxhash64(seed, replicate, row): the same table always gives the same draws on any cluster.
Block bootstraps never materialize resampled rows: a replicate is a list of blocks, and the sums over a block are a
difference of two prefix sums, so the work is replicates x blocks instead of replicates x rows.
"""
from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import RN, Series, SeriesSpec, col, index_rows
from .bars import compounded


def uniform(*parts) -> Column:
    """Hash-driven number in [0, 1)."""
    h = F.xxhash64(*[F.lit(p) if isinstance(p, int) else col(p) for p in parts])
    return (F.shiftrightunsigned(h, 11).cast("double")) / float(1 << 53)


def prefix_sums(s: Series, values: dict[str, Column]) -> DataFrame:
    """Sums before every row (and one row past the end): keys, idx, one column per value."""
    keys = s.keys
    t = s.flat().running({f"_c_{n}": ("sum", c) for n, c in values.items()}).df
    upto = t.select(*keys, (F.col(RN) + 1).alias("idx"), *[F.coalesce(F.col(f"_c_{n}"), F.lit(0.0)).alias(n) for n in values])
    zero = t.where(F.col(RN) == 0).select(*keys, F.lit(0).cast("bigint").alias("idx"), *[F.lit(0.0).alias(n) for n in values])
    return upto.unionByName(zero)


def _lengths(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_T"))


def stationary_blocks(n: DataFrame, keys: list[str], reps: int, mean_block: float, seed=0) -> DataFrame:
    """Blocks (rep, origin, len) of the stationary bootstrap: every position jumps with probability 1 / mean_block."""
    r = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    # the jump test runs inside the generator's stage; only the jumps (T / mean_block per replicate) are shuffled
    r = r.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_T") - 1)))
    jump = (F.col("_t") == 0) | (uniform(seed, "rep", "_t") < 1.0 / mean_block)
    j = r.where(jump).withColumn("origin", F.floor(uniform(seed + 1, "rep", "_t") * F.col("_T")).cast("bigint"))
    w = Window.partitionBy(*keys, "rep").orderBy("_t")
    return j.withColumn("len", F.coalesce(F.lead("_t").over(w), F.col("_T")) - F.col("_t")).select(*keys, "rep", "_T", "origin", "len")


def moving_blocks(n: DataFrame, keys: list[str], reps: int, block: int, seed=0) -> DataFrame:
    """Fixed-length blocks with uniform starts; the last one is cut to the length of the series."""
    b = F.ceil(F.col("_T") / block)
    r = (n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), b - 1))))
    size = F.least(F.lit(block), F.col("_T"))
    return r.select(*keys, "rep", "_T", F.floor(uniform(seed, "rep", "_k") * (F.col("_T") - size + 1)).cast("bigint").alias("origin"),
                    F.least(size, F.col("_T") - F.col("_k") * block).alias("len"))


def block_sums(blocks: DataFrame, prefix: DataFrame, keys: list[str], values: list[str], extra: list[str] | None = None) -> DataFrame:
    """Sums of every replicate from prefix sums, wrapping around the end of the series."""
    extra = extra or []
    end = F.col("origin") + F.col("len")
    parts = F.array_compact(F.array(
        F.struct(F.col("origin").alias("idx"), F.lit(-1.0).alias("sign")), F.struct(F.least(end, F.col("_T")).alias("idx"), F.lit(1.0).alias("sign")),
        F.when(end > F.col("_T"), F.struct((end - F.col("_T")).alias("idx"), F.lit(1.0).alias("sign")))))
    e = blocks.select(*keys, "rep", F.inline(parts))
    # many blocks end on the same row: count them per row before the prefix table is joined
    e = e.groupBy(*keys, "rep", "idx").agg(F.sum("sign").alias("_w")).where(F.col("_w") != 0)
    j = e.join(prefix, [*keys, "idx"])
    return j.groupBy(*keys, *extra, "rep").agg(*[F.sum(F.col("_w") * F.col(v)).alias(v) for v in values])


def bootstrap_sharpes(df: DataFrame, spec: SeriesSpec, r="ret", reps=1000, mean_block=20, seed=0) -> DataFrame:
    """Per-period Sharpe of stationary-bootstrap replicates: keys, rep, sharpe."""
    keys = list(spec.keys)
    s = Series.of(df, spec)
    p = prefix_sums(s, {"s1": col(r), "s2": col(r) * col(r)})
    n = _lengths(df, spec)
    sums = block_sums(stationary_blocks(n, keys, reps, mean_block, seed), p, keys, ["s1", "s2"]).join(n, keys)
    T = F.col("_T")
    var = (F.col("s2") - F.col("s1") * F.col("s1") / T) / (T - 1)
    return sums.select(*keys, "rep", (F.col("s1") / T / F.sqrt(var)).alias("sharpe"))


def block_bootstrap_ci(df: DataFrame, spec: SeriesSpec, r="ret", block=20, reps=2000, alpha=0.05, seed=0) -> DataFrame:
    """Percentile interval of the mean under the moving-block bootstrap."""
    keys = list(spec.keys)
    p = prefix_sums(Series.of(df, spec), {"s1": col(r)})
    n = _lengths(df, spec)
    m = block_sums(moving_blocks(n, keys, reps, block, seed), p, keys, ["s1"]).join(n, keys).withColumn("mean", F.col("s1") / F.col("_T"))
    # one row per replicate: a fixed number of rows per key
    return m.groupBy(*keys).agg(F.expr(f"percentile(mean, {alpha / 2})").alias("lo"), F.expr(f"percentile(mean, {1 - alpha / 2})").alias("hi"))


def half_life_ci(df: DataFrame, spec: SeriesSpec, x="x", block=50, reps=200, alpha=0.10, seed=0) -> DataFrame:
    """Half-life interval from resampled regression pairs (x[t], x[t+1]); order statistics, so infinity stays infinity."""
    keys = list(spec.keys)
    s = Series.of(df, spec, back=1)
    d = s.add(_l=s.lag(x)).done().where(F.col("_l").isNotNull())
    l, y = F.col("_l"), F.col(x)
    p = prefix_sums(Series.of(d, spec), {"sx": l, "sy": y, "sxy": l * y, "sxx": l * l})
    n = _lengths(d, spec)
    g = block_sums(moving_blocks(n, keys, reps, block, seed), p, keys, ["sx", "sy", "sxy", "sxx"]).join(n, keys)
    b = F.try_divide(F.col("_T") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("_T") * F.col("sxx") - F.col("sx") * F.col("sx"))
    g = g.withColumn("hl", F.when((b > 0) & (b < 1), math.log(2) / -F.log(b)).otherwise(float("inf")))
    w = Window.partitionBy(*keys).orderBy("hl")
    k = g.withColumn("_k", F.row_number().over(w))
    return k.groupBy(*keys).agg(F.min(F.when(F.col("_k") >= math.ceil(reps * alpha / 2), F.col("hl"))).alias("lo"),
                                F.min(F.when(F.col("_k") >= math.ceil(reps * (1 - alpha / 2)), F.col("hl"))).alias("hi"))


def reality_check(df: DataFrame, spec: SeriesSpec, strategy="strategy", r="ret", reps=500, mean_block=10, seed=0) -> DataFrame:
    """p-value of the best of K strategies: all share the resampled rows; a naive one-strategy p-value beside it."""
    from ..functions.special import normal_cdf
    s = Series.of(df, spec.with_(keys=(strategy,)))
    p = prefix_sums(s, {"s1": col(r)})
    m = df.groupBy(strategy).agg(F.avg(r).alias("_m"), F.stddev_samp(r).alias("_sd"), F.count(r).alias("_T"))
    n = m.select(F.max("_T").alias("_T"))
    b = stationary_blocks(n, [], reps, mean_block, seed)
    sums = block_sums(b, p, [], ["s1"], [strategy]).join(m, strategy)
    v = sums.groupBy("rep").agg(F.max(F.sqrt("_T") * (F.col("s1") / F.col("_T") - F.col("_m"))).alias("_v"))
    obs = m.agg(F.max(F.struct(F.sqrt("_T") * F.col("_m"), strategy, F.col("_m") / (F.col("_sd") / F.sqrt("_T")))).alias("_o")).select(
        F.col("_o")["col1"].alias("_obs"), F.col(f"_o.{strategy}").alias("best"), F.col("_o")["col3"].alias("_t"))
    return v.crossJoin(F.broadcast(obs)).groupBy("best", "_t").agg(F.avg((F.col("_v") >= F.col("_obs")).cast("double")).alias("p_value")).select(
        "best", "p_value", normal_cdf(-F.col("_t")).alias("naive_p"))


def shuffled(df: DataFrame, keys: list[str], row_id: str, reps: int, seed=0) -> tuple[DataFrame, SeriesSpec]:
    """Every replicate is the whole table in hash order: (rows with rep and _h, series spec for that order)."""
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_h", F.xxhash64(F.lit(seed), "rep", row_id))
    return d, SeriesSpec((*keys, "rep"), ("_h", row_id), "shiftright(_h, 58)")


def drawdown_distribution(trades: DataFrame, keys: list[str], row_id: str, r="ret", reps=2000, seed=0) -> DataFrame:
    """Maximum drawdown of random orderings of the same trades."""
    from .strategies import equity_curve
    d, spec = shuffled(trades.select(*keys, row_id, r), keys, row_id, reps, seed)
    s = equity_curve(Series.of(d, spec), r)
    return s.df.groupBy(*keys, "rep").agg(F.min(F.col("equity") / F.greatest("peak", F.lit(1.0)) - 1).alias("max_dd"))


def draws(source: DataFrame, spec: SeriesSpec, reps: int, length: int, seed=0) -> DataFrame:
    """reps x length rows drawn with replacement: keys, rep, step and the columns of the source."""
    keys = list(spec.keys)
    src = index_rows(source, spec, "_i")
    n = _lengths(source, spec)
    g = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(length))))
    g = g.withColumn("_i", F.floor(uniform(seed, "rep", "step") * F.col("_T")).cast("bigint")).drop("_T")
    return g.join(src, [*keys, "_i"]).drop("_i")


def risk_of_ruin(trades: DataFrame, spec: SeriesSpec, risk_frac: float, r="r_multiple", ruin=0.5, n_trades=500, n_sims=2000, seed=0) -> DataFrame:
    """Share of resampled trade paths whose equity ever falls to `ruin`."""
    keys = list(spec.keys)
    d = draws(trades.select(*keys, *[c for c in spec.order if c not in keys], r), spec, n_sims, n_trades, seed)
    # a path has n_trades rows, so its window is bounded
    w = Window.partitionBy(*keys, "rep").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    g = 1 + risk_frac * F.col(r)
    p = d.withColumn("_le", F.sum(F.when(g > 0, F.log(g)).otherwise(-1e6)).over(w))
    path = p.groupBy(*keys, "rep").agg((F.min("_le") <= math.log(ruin)).alias("_hit"))
    return path.groupBy(*keys).agg(F.avg(F.col("_hit").cast("double")).alias("risk_of_ruin"))


def backtest_band(returns: DataFrame, spec: SeriesSpec, r="ret", horizon=20, reps=2000, q=(0.05, 0.95), seed=0) -> DataFrame:
    """Quantile band of cumulative bootstrap paths per day."""
    keys = list(spec.keys)
    d = draws(returns.select(*keys, *[c for c in spec.order if c not in keys], r), spec, reps, horizon, seed)
    w = Window.partitionBy(*keys, "rep").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    p = d.withColumn("_cum", F.sum(r).over(w))
    return p.groupBy(*keys, F.col("step").alias("day")).agg(F.expr(f"percentile(_cum, {q[0]})").alias("lower"), F.expr(f"percentile(_cum, {q[1]})").alias("upper"))


def permutation_edge(df: DataFrame, keys: list[str], row_id: str, signal: str, fwd: str, n_perm=1000, seed=0) -> DataFrame:
    """Event mean less overall mean with a two-sided permutation p-value and the hit rate.

    A permutation takes the k rows with the smallest hashes; positions in hash order come from the two-phase numbering,
    so one hot key is spread over many tasks.
    """
    v = df.where(F.col(fwd).isNotNull()).select(*keys, row_id, F.col(signal).alias("_s"), F.col(fwd).alias("_f"))
    on = F.coalesce(F.col("_s") != 0, F.lit(False))
    obs = v.groupBy(*keys).agg(F.count(F.when(on, 1)).alias("n"), F.avg(F.when(on, F.col("_f"))).alias("_em"), F.avg("_f").alias("_base"),
                               F.avg(F.when(on, (F.col("_f") > 0).cast("double"))).alias("hit_rate"))
    d, spec = shuffled(v, keys, row_id, n_perm, seed)
    idx = index_rows(d, spec, "_k")
    j = (idx.join(obs, keys) if keys else idx.crossJoin(F.broadcast(obs))).where(F.col("_k") < F.col("n"))
    null = j.groupBy(*keys, "rep", "_em", "_base").agg((F.avg("_f") - F.col("_base")).alias("_null"))
    ge = null.groupBy(*keys).agg(F.count(F.when(F.abs("_null") >= F.abs(F.col("_em") - F.col("_base")), 1)).alias("_ge"))
    out = obs.join(ge, keys, "left") if keys else obs.crossJoin(ge)
    return out.select(*keys, "n", (F.col("_em") - F.col("_base")).alias("edge"),
                      F.when(F.col("n") == 0, 1.0).otherwise((F.coalesce("_ge", F.lit(0)) + 1) / (n_perm + 1)).alias("p_value"), "hit_rate")


# ---------------------------------------------------------------- folds
def walk_forward_folds(n: DataFrame, keys: list[str], train: int, test: int, anchored=False, length="n") -> DataFrame:
    """Fold table (fold, role, lo, hi): test windows back to back after the first train window."""
    k = F.floor((F.col(length) - train - test) / test)
    d = n.where(F.col(length) >= train + test).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), k)))
    start = F.col("fold") * test
    rows = F.array(F.struct(F.lit("train").alias("role"), (F.lit(0) if anchored else start).cast("bigint").alias("lo"), (start + train - 1).cast("bigint").alias("hi")),
                   F.struct(F.lit("test").alias("role"), (start + train).cast("bigint").alias("lo"), (start + train + test - 1).cast("bigint").alias("hi")))
    return d.select(*keys, "fold", F.inline(rows))


def equal_blocks(n: Column, k: int, i: Column) -> tuple[Column, Column]:
    """First and last position of block i when n rows are split in k blocks (the first n mod k are one longer)."""
    base, rest = F.floor(n / k), n % k
    lo = i * base + F.least(i, rest)
    return lo, lo + base + (i < rest).cast("int") - 1


def purged_folds(n: DataFrame, keys: list[str], k=5, label_horizon=5, embargo=0.01, length="n") -> DataFrame:
    """Per fold: test range and the two train ranges left after purge and embargo (keep i if i + horizon < lo or i > hi + embargo)."""
    d = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo, hi = equal_blocks(F.col(length), k, F.col("fold"))
    emb = F.ceil(embargo * F.col(length))
    rows = F.array(F.struct(F.lit("test").alias("role"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi")),
                   F.struct(F.lit("train").alias("role"), F.lit(0).cast("bigint").alias("lo"), (lo - label_horizon - 1).cast("bigint").alias("hi")),
                   F.struct(F.lit("train").alias("role"), (hi + emb + 1).cast("bigint").alias("lo"), (F.col(length) - 1).cast("bigint").alias("hi")))
    return d.select(*keys, "fold", F.inline(rows)).where(F.col("lo") <= F.col("hi"))


def cpcv_table(spark, n_groups=6, k_test=2) -> DataFrame:
    """(combo, grp) for every choice of test groups; a fixed small table."""
    rows = [(i, g) for i, c in enumerate(itertools.combinations(range(n_groups), k_test)) for g in c]
    return spark.createDataFrame(rows, "combo int, grp int")


def cpcv_paths(n_groups: int, k_test: int) -> int:
    return math.comb(n_groups, k_test) * k_test // n_groups


def cpcv_roles(rows: DataFrame, n: DataFrame, keys: list[str], n_groups=6, k_test=2, label_horizon=5, embargo=0.01, length="n", rn=RN) -> DataFrame:
    """Role of every row in every combination: test, train, or absent when purged around any test group."""
    combos = cpcv_table(rows.sparkSession, n_groups, k_test)
    g = n.crossJoin(F.broadcast(combos))
    lo, hi = equal_blocks(F.col(length), n_groups, F.col("grp"))
    g = g.select(*keys, "combo", "grp", lo.alias("lo"), hi.alias("hi"), F.ceil(embargo * F.col(length)).alias("emb"))
    g = g.groupBy(*keys, "combo").agg(F.collect_list(F.struct("lo", "hi", "emb")).alias("_t"))
    j = rows.select(*keys, rn).join(g, keys) if keys else rows.select(rn).crossJoin(F.broadcast(g))
    i = F.col(rn)
    test = F.exists("_t", lambda t: (i >= t["lo"]) & (i <= t["hi"]))
    keep = F.forall("_t", lambda t: (i + label_horizon < t["lo"]) | (i > t["hi"] + t["emb"]))
    return j.withColumn("role", F.when(test, "test").when(keep, "train")).where(F.col("role").isNotNull()).drop("_t")


def purged_by_time(rows: DataFrame, folds: DataFrame, t0: str, t1: str, embargo_rows: Column | None = None) -> DataFrame:
    """Train rows per fold whose label span [t0, t1] misses the test span (columns test_lo, test_hi, one row per fold)."""
    c = rows.crossJoin(F.broadcast(folds))
    late = F.col("test_hi") if embargo_rows is None else embargo_rows
    return c.where((F.col(t1) < F.col("test_lo")) | (F.col(t0) > late))


def shuffled_fold(row_id, k: int, seed=0) -> Column:
    """Random fold by hash: the leaky baseline splitter."""
    return F.pmod(F.xxhash64(F.lit(seed), col(row_id)), F.lit(k)).cast("int")


def sharpe_by(df: DataFrame, by: list[str], pnl="pnl", periods=252) -> DataFrame:
    sd = F.stddev_samp(pnl)
    return df.groupBy(*by).agg(F.when(sd > 0, F.avg(pnl) / sd * math.sqrt(periods)).alias("sharpe"), F.count(pnl).alias("n"))


def walk_forward_optimize(pnl: DataFrame, spec: SeriesSpec, train: int, test: int, anchored=False) -> DataFrame:
    """Per fold the configuration with the best in-sample Sharpe and its out-of-sample Sharpe.

    `pnl` is long: keys, config, order column, pnl.  Fold sums are taken per block of `test` rows, so a row is read once
    however many folds cover it.
    """
    keys = list(spec.keys)
    idx = index_rows(pnl, spec.with_(keys=(*keys, "config")))
    n = idx.groupBy(*keys).agg((F.max(RN) + 1).alias("n"))
    folds = walk_forward_folds(n, keys, train, test, anchored)
    step = math.gcd(train, test)
    sums = (idx.groupBy(*keys, "config", F.floor(F.col(RN) / step).alias("_b"))
            .agg(F.count(F.lit(1)).alias("_n"), F.sum("pnl").alias("_s"), F.sum(F.col("pnl") * F.col("pnl")).alias("_q")))
    fb = folds.select(*keys, "fold", "role", F.explode(F.sequence((F.col("lo") / step).cast("bigint"), F.floor(F.col("hi") / step))).alias("_b"))
    j = sums.join(fb, [*keys, "_b"])
    g = j.groupBy(*keys, "fold", "role", "config").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)
    g = g.withColumn("sharpe", F.when(var > 1e-18, F.col("_s") / F.col("_n") / F.sqrt(var) * math.sqrt(252)))
    best = (g.where(F.col("role") == "train").groupBy(*keys, "fold")
            .agg(F.max(F.struct(F.coalesce("sharpe", F.lit(float("-inf"))).alias("is_sharpe"), (-F.col("config")).alias("_neg"))).alias("_m"))
            .select(*keys, "fold", (-F.col("_m._neg")).alias("config"), "_m.is_sharpe"))
    oos = g.where(F.col("role") == "test").select(*keys, "fold", "config", F.col("sharpe").alias("oos_sharpe"), F.col("_s").alias("oos_pnl"))
    return best.join(oos, [*keys, "fold", "config"])


def walk_forward_efficiency(wf: DataFrame, keys: list[str]) -> DataFrame:
    return wf.groupBy(*keys).agg((F.avg("oos_sharpe") / F.avg("is_sharpe")).alias("wfe"), F.sum("oos_pnl").alias("oos_total"), F.count(F.lit(1)).alias("folds"))


def pbo_cscv(perf: DataFrame, spec: SeriesSpec, S=10) -> DataFrame:
    """Logit of the out-of-sample rank of the in-sample winner for every half-split of S blocks.

    Rows are reduced to sums per (block, config) once; a split only adds block sums.
    """
    keys = list(spec.keys)
    spark = perf.sparkSession
    idx = index_rows(perf, spec.with_(keys=(*keys, "config")))
    n = idx.groupBy(*keys, "config").agg((F.max(RN) + 1).alias("_T"))
    d = idx.join(n, [*keys, "config"])
    base, rest = F.floor(F.col("_T") / S), F.col("_T") % S
    big = rest * (base + 1)
    blk = F.when(F.col(RN) < big, F.floor(F.col(RN) / (base + 1))).otherwise(rest + F.floor((F.col(RN) - big) / base)).cast("int")
    sums = d.groupBy(*keys, "config", blk.alias("blk")).agg(F.count(F.lit(1)).alias("_n"), F.sum("pnl").alias("_s"), F.sum(F.col("pnl") * F.col("pnl")).alias("_q"))
    splits = [(i, b, b in c) for i, c in enumerate(itertools.combinations(range(S), S // 2)) for b in range(S)]
    # C(S, S/2) x S rows whatever the data; S is at most 16 in practice
    t = spark.createDataFrame(splits, "split int, blk int, is_in boolean")
    g = sums.join(t, "blk").groupBy(*keys, "split", "config", "is_in").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)
    g = g.withColumn("sr", F.col("_s") / F.col("_n") / F.sqrt(var))
    best = g.where("is_in").groupBy(*keys, "split").agg(F.max(F.struct("sr", (-F.col("config")).alias("_neg"))).alias("_m")).select(*keys, "split", (-F.col("_m._neg")).alias("_best"))
    w = Window.partitionBy(*keys, "split")
    oos = g.where(~F.col("is_in")).withColumn("_rank", F.row_number().over(w.orderBy("sr", "config"))).withColumn("_N", F.count(F.lit(1)).over(w))
    r = oos.join(best, [*keys, "split"]).where(F.col("config") == F.col("_best"))
    om = F.col("_rank") / (F.col("_N") + 1)
    return r.select(*keys, "split", F.col("_best").alias("config"), F.log(om / (1 - om)).alias("logit"))


def pbo(logits: DataFrame, keys: list[str]) -> DataFrame:
    return logits.groupBy(*keys).agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("splits"))


def param_grid(spark, **values: list) -> DataFrame:
    """Cross product of parameter lists with a config number in key order."""
    names = list(values)
    rows = [(i, *c) for i, c in enumerate(itertools.product(*values.values()))]
    types = ", ".join(f"{n} {'double' if any(isinstance(v, float) for v in values[n]) else 'bigint'}" for n in names)
    return spark.createDataFrame([(i, *[float(v) if any(isinstance(u, float) for u in values[n]) else v for n, v in zip(names, c)]) for (i, *c) in rows], f"config bigint, {types}")


def random_grid(spark, n: int, seed=0, **values: list) -> DataFrame:
    """n hash-seeded picks from parameter lists."""
    d = spark.range(n).withColumnRenamed("id", "config")
    for k, (name, vals) in enumerate(values.items()):
        arr = F.array(*[F.lit(v) for v in vals])
        d = d.withColumn(name, arr[F.floor(uniform(seed * 1000 + k, "config") * len(vals)).cast("int")])
    return d


def plateau_scores(results: DataFrame, x: str, y: str, score="score", radius=1) -> DataFrame:
    """Mean score of the grid cells within `radius` steps on both axes."""
    wx, wy = Window.partitionBy(F.lit(0)).orderBy(x), Window.partitionBy(F.lit(0)).orderBy(y)
    # parameter axes are short fixed lists
    ax = results.select(x).distinct().withColumn("_i", F.row_number().over(wx))
    ay = results.select(y).distinct().withColumn("_j", F.row_number().over(wy))
    r = results.join(F.broadcast(ax), x).join(F.broadcast(ay), y)
    near = r.select(F.col("_i").alias("_i2"), F.col("_j").alias("_j2"), F.col(score).alias("_s"))
    offs = F.sequence(F.lit(-radius), F.lit(radius))
    near = near.withColumn("_di", F.explode(offs)).withColumn("_dj", F.explode(offs))
    near = near.withColumns({"_i": F.col("_i2") + F.col("_di"), "_j": F.col("_j2") + F.col("_dj")})
    m = near.groupBy("_i", "_j").agg(F.avg("_s").alias("plateau"))
    return r.join(m, ["_i", "_j"]).select(x, y, score, "plateau")


def pareto_front(df: DataFrame, maximize: str, minimize: str, buckets=1024) -> DataFrame:
    """Rows no other row dominates: order by the maximized value, keep rows that improve the running minimum of the other."""
    d = df.withColumn("_neg", -F.col(maximize))
    lo = d.agg(F.min("_neg").alias("a"), F.max("_neg").alias("b"))
    d = d.crossJoin(F.broadcast(lo)).withColumn("_tb0", F.floor(F.coalesce(F.try_divide(F.col("_neg") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)) * buckets).cast("bigint")).drop("a", "b")
    # rows with equal objectives do not dominate each other: compare one row per distinct pair
    u = d.groupBy("_neg", minimize, "_tb0").agg(F.count(F.lit(1)).alias("_c"))
    s = Series.of(u, SeriesSpec((), ("_neg", minimize), "_tb0")).running({"_best": ("min", F.col(minimize))}).halo(1)
    keep = s.add(_prev=s.lag("_best")).done().where(F.col("_prev").isNull() | (F.col(minimize) < F.col("_prev"))).select("_neg", minimize)
    return df.withColumn("_neg", -F.col(maximize)).join(keep, ["_neg", minimize], "left_semi").drop("_neg")


def robustness_scorecard(pnl: DataFrame, spec: SeriesSpec, base="base", keys: list[str] | None = None) -> DataFrame:
    """Verdicts per key and variant from a long P&L table (variant names: base, param..., delay, costs); base halves and
    trimmed days are added."""
    keys = list(keys or [])
    b = pnl.where(F.col("variant") == base).drop("variant")
    idx = index_rows(b, spec)
    n = idx.groupBy(*keys).agg((F.max(RN) + 1).alias("_n"))
    idx = idx.join(n, keys) if keys else idx.crossJoin(F.broadcast(n))
    half = idx.withColumn("variant", F.when(F.col(RN) < F.floor(F.col("_n") / 2), "first half").otherwise("second half"))
    best = Window.partitionBy(*keys).orderBy(F.col("pnl").desc(), *[F.col(c) for c in spec.order])
    trimmed = b.withColumn("_k", F.row_number().over(best))
    top = trimmed.where("_k <= 5").select(*keys, *spec.order)
    trimmed = b.join(top, [*keys, *spec.order], "left_anti").withColumn("variant", F.lit("without best 5 days"))
    by = [*keys, "variant"]
    sr = sharpe_by(pnl, by)
    more = sharpe_by(half, by).unionByName(sharpe_by(trimmed, by))
    ref = sr.where(F.col("variant") == base).select(*keys, F.col("sharpe").alias("_b"))
    allv = sr.where(F.col("variant") != base).unionByName(more)
    allv = allv.join(ref, keys) if keys else allv.crossJoin(F.broadcast(ref))
    relative = F.col("variant").startswith("param") | F.col("variant").startswith("delay")
    return allv.select(*keys, F.col("variant").alias("test"), F.col("sharpe").alias("value"),
                       F.when(relative, F.col("sharpe") >= 0.5 * F.col("_b")).otherwise(F.col("sharpe") > 0).alias("passed"))


GATE = {"oos_sharpe": 0.5, "dsr": 0.95, "pbo": 0.2, "robustness": 0.8, "max_dd": -0.25}    # fixed values: pass levels


def validation_gate(metrics: DataFrame, levels: dict | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per key and check from a table of metrics with one row per key, plus the overall verdict on every row."""
    lv = {**GATE, **(levels or {})}
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).cast("double").alias("value"),
                              (F.col(k) <= lv[k] if k == "pbo" else F.col(k) >= lv[k]).alias("passed")) for k in lv])
    ok = None
    for k in lv:
        c = F.col(k) <= lv[k] if k == "pbo" else F.col(k) >= lv[k]
        ok = c if ok is None else ok & c
    return metrics.select(*(keys or []), F.coalesce(ok, F.lit(False)).alias("all_passed"), F.inline(rows))


def total_return(df: DataFrame, by: list[str], r="ret") -> DataFrame:
    return df.groupBy(*by).agg(compounded(F.col(r)).alias("total"))
