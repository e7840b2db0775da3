"""Maximum-likelihood Student-t fits per key: degrees of freedom, location and scale."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import kept
from ..session import checkpointed

STEPS = (1.0, 0.5, 0.2, 0.05)                 # lengths tried along one direction in one pass
MOST = math.log(1e6)                          # beyond so many degrees of freedom the law is normal


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def constants(p: np.ndarray) -> tuple[float, float]:
    """Terms of one row's log-likelihood, and of its derivative by the log of the degrees of freedom, that no value enters."""
    nu = math.exp(p[2])
    log_c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * nu) - p[1]
    return log_c, nu * (digamma((nu + 1) / 2) - digamma(nu / 2)) / 2 - 0.5


def fit(df: DataFrame, keys: list[str], x: str, tol: float = 1e-12, limit: int = 100) -> DataFrame:
    """keys, n, df, loc, scale, loglik, decrement, passes, settled.

    Newton-like steps in (location, log scale, log degrees of freedom) with the outer product of the scores as curvature.  A pass
    is one aggregation: it sums log-likelihood, scores and their products at several step lengths, and the best one of a key is
    where its next direction starts.  A key settles when the decrement, the gain per row that the scores still promise, is at
    most `tol`.  Degrees of freedom end at a million.  Null and infinite values are left out; keys with fewer than five rows or
    without spread are not fitted.  Where one value holds a large share of the rows the likelihood has no maximum; such a key ends
at `limit` with settled = false.
    """
    d = df.select(*keys, F.col(x).cast("double").alias("_x")).where("_x is not null and not isnan(_x) and abs(_x) < double('inf')")
    start = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"), F.kurtosis("_x").alias("_k")).where("n >= 5 and _s > 0")
    heavy = F.when(F.col("_k") > 0.3, 4 + 6 / F.col("_k")).otherwise(24.0)
    # values are taken in units of the key's deviation around its mean
    d = kept(d.join(start.select(*keys, "_m", "_s"), keys).select(*keys, ((F.col("_x") - F.col("_m")) / F.col("_s")).alias("_x")))
    begin = F.array(F.lit(0.0), 0.5 * F.log(1 - 2 / heavy), F.log(heavy))
    state = start.select(*keys, "n", "_m", "_s", F.array(begin).alias("tries"), F.lit(float("-inf")).alias("best"))

    def scored(pdf_iter):
        for b in pdf_iter:
            cs = [[constants(np.asarray(p)) for p in t] for t in b["tries"]]
            yield b.assign(log_c=[[c[0] for c in r] for r in cs], kappa=[[c[1] for c in r] for r in cs])

    names = ", ".join(f"{k} {d.schema[k].dataType.simpleString()}" for k in keys)
    base = f"{names}, n long, _m double, _s double, tries array<array<double>>, best double"
    width = len(STEPS)

    def sums(state: DataFrame) -> DataFrame:
        known = state.mapInPandas(scored, base + ", log_c array<double>, kappa array<double>")
        rows = d.join(known.select(*keys, "tries", "kappa"), keys)
        aggs = []
        for j in range(width):
            p = F.get("tries", F.lit(j))
            nu, z = F.exp(p[2]), (F.col("_x") - p[0]) * F.exp(-p[1])
            q = z * z / nu
            u = (nu + 1) / (nu * (1 + q))
            s = [u * z * F.exp(-p[1]), u * z * z - 1, F.get("kappa", F.lit(j)) - nu / 2 * F.log1p(q) + (nu + 1) / 2 * q / (1 + q)]
            cells = [-(nu + 1) / 2 * F.log1p(q), *s, *[s[a] * s[b] for a in range(3) for b in range(a, 3)]]
            aggs.append(F.array(*[F.sum(c) for c in cells]).alias(f"_c{j}"))
        return known.join(rows.groupBy(*keys).agg(*aggs), keys)

    def advance(pdf_iter):
        for b in pdf_iter:
            out = []
            for r in b.itertuples(index=False):
                totals = [np.asarray(getattr(r, f"f{j}"), float) for j in range(len(r.tries))]
                logs = [t[0] + r.n * c for t, c in zip(totals, r.log_c)]
                j = int(np.nanargmax(logs))
                p, t = np.asarray(r.tries[j], float), totals[j]
                g = t[1:4]
                h = np.zeros((3, 3))
                h[np.triu_indices(3)] = t[4:]
                h = h + np.triu(h, 1).T
                free = np.array([True, True, not (p[2] >= MOST and g[2] > 0)])
                move = np.zeros(3)
                move[free] = np.linalg.lstsq(h[np.ix_(free, free)], g[free], rcond=None)[0]
                left = float(move @ g) / r.n
                move[2] = np.clip(move[2], -2, 2)
                nxt = [p + s * move for s in STEPS]
                for v in nxt:
                    v[2] = np.clip(v[2], math.log(0.05), MOST)
                out.append((p.tolist(), logs[j], left, bool(left <= tol), [v.tolist() for v in nxt]))
            cols = list(zip(*out)) if out else [[]] * 5
            yield b[[*keys, "n", "_m", "_s"]].assign(at=list(cols[0]), best=list(cols[1]), decrement=list(cols[2]), settled=list(cols[3]), tries=list(cols[4]))

    done = None
    for i in range(limit):
        s = sums(state)
        s = s.select(*keys, "n", "_m", "_s", "tries", "log_c", *[F.col(f"_c{j}").alias(f"f{j}") for j in range(width)])
        made = checkpointed(s.mapInPandas(advance, f"{names}, n long, _m double, _s double, at array<double>, best double, decrement double, settled boolean, tries array<array<double>>").withColumn("passes", F.lit(i + 1)))
        last = i + 1 == limit
        ready = made if last else made.where("settled")
        done = ready if done is None else done.unionByName(ready)
        state = made.where("not settled").select(*keys, "n", "_m", "_s", "tries", "best")
        if last or state.isEmpty():
            break
    p = F.col("at")
    return done.select(*keys, "n", F.exp(p[2]).alias("df"), (F.col("_m") + F.col("_s") * p[0]).alias("loc"), (F.col("_s") * F.exp(p[1])).alias("scale"),
                       (F.col("best") - F.col("n") * F.log("_s")).alias("loglik"), "decrement", "passes", "settled")
