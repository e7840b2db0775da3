"""Long-only allocation solved to a stated gap.

A gap is an upper bound of what is left to gain, so it says how far a result can be from the optimum; solvers go on until it is
small and return it.  Covariances and scenario sums are Spark aggregates; only matrices of the size of the universe are solved
in a task.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import RN, SeriesSpec, index_rows, kept
from ..session import checkpointed
from .portfolio import _simplex

TOL = 1e-10


def cheapest(cost: np.ndarray, cap: float) -> np.ndarray:
    """Weights of {sum = 1, 0 <= w <= cap} with the least cost: the cheapest names first."""
    w, left = np.zeros(len(cost)), 1.0
    for i in np.argsort(cost, kind="stable"):
        w[i] = min(cap, left)
        left -= w[i]
    return w


def variance_gap(w: np.ndarray, cov: np.ndarray, cap: float) -> float:
    """Upper bound of variance(w) - least variance: the gradient against the best corner, by convexity."""
    g = 2 * cov @ w
    return float(g @ (w - cheapest(g, cap)))


def polished(w: np.ndarray, cov: np.ndarray, cap: float) -> np.ndarray:
    """Exact optimum for the bounds that `w` touches, if it is feasible."""
    low, high = w <= 1e-9, w >= cap - 1e-9
    free = ~(low | high)
    if not free.any():
        return w
    fixed = np.where(high, cap, 0.0)
    k = int(free.sum())
    m = np.zeros((k + 1, k + 1))
    m[:k, :k], m[:k, k], m[k, :k] = 2 * cov[np.ix_(free, free)], 1, 1
    x = np.linalg.lstsq(m, np.append(-2 * cov[free] @ fixed, 1 - fixed.sum()), rcond=None)[0][:k]
    if (x < 0).any() or (x > cap).any():
        return w
    fixed[free] = x
    return fixed


def min_variance_gap(cap: float = 1.0, tol: float = TOL):
    """Least variance under a cap: accelerated projected gradient with restarts, polished on the bounds it finds, until the gap is
    at most `tol` of the variance.  Returns (weights, gap as a share of the variance)."""
    def fn(names, mu, cov, cor):
        if cap * len(cov) < 1:
            raise ValueError(f"{len(cov)} names under a cap of {cap} cannot hold the whole portfolio")
        w = np.full(len(cov), 1 / len(cov))
        best, y, t, step, wait = w, w.copy(), 1.0, 1 / max(2 * np.linalg.eigvalsh(cov)[-1], 1e-300), 50
        share = lambda v: variance_gap(v, cov, cap) / max(float(v @ cov @ v), 1e-300)
        while share(best) > tol:
            before = share(best)
            for _ in range(wait):
                nw = _simplex(y - step * 2 * cov @ y, cap)
                if (y - nw) @ (nw - w) > 0:
                    t, y = 1.0, w
                    continue
                nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
                y, w, t = nw + (t - 1) / nt * (nw - w), nw, nt
            best = min((best, w, polished(w, cov, cap)), key=share)
            if share(best) >= before and wait > 100_000:                    # rounding: report the gap that is left
                break
            wait = wait if share(best) < before else 2 * wait
        return best, share(best)
    return fn


def risk_parity_gap(tol: float = TOL):
    """Equal shares of risk: coordinate steps until the largest share differs from 1/n by at most `tol`."""
    def fn(names, mu, cov, cor):
        n = len(cov)
        c = cov / np.mean(np.diag(cov))
        y, off, before = 1 / np.sqrt(np.diag(c)), np.inf, np.inf
        while off > tol:
            for i in range(n):
                b = c[i] @ y - c[i, i] * y[i]
                y[i] = (-b + np.sqrt(b * b + 4 * c[i, i] / n)) / (2 * c[i, i])
            part = y * (c @ y)
            before, off = off, float(np.abs(part / part.sum() - 1 / n).max())
            if off >= before and off < 1e-8:                                # rounding
                break
        return y / y.sum(), off
    return fn


def weights(fn):
    """The same solver without its gap."""
    return lambda *matrix: fn(*matrix)[0]


def solve_windows_gap(moments: DataFrame, by: list[str], fn) -> DataFrame:
    """(by, symbol, weight, gap): `fn` once a window on its reduced matrix."""
    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["a"].unique())
        square = lambda c: pdf.pivot(index="a", columns="b", values=c).loc[names, names].to_numpy()
        w, gap = fn(names, pdf.drop_duplicates("a").set_index("a")["mean_a"].loc[names].to_numpy(), square("cov"), square("corr"))
        out = pd.DataFrame({"symbol": [str(n) for n in names], "weight": w, "gap": gap})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "symbol", "weight", "gap"]]

    schema = ", ".join([*[f"{c} {moments.schema[c].dataType.simpleString()}" for c in by], "symbol string", "weight double", "gap double"])
    return moments.withColumn("_all", F.lit(0)).groupBy(*(by or ["_all"])).applyInPandas(finish, schema)


# ---------------------------------------------------------------- least expected shortfall
def linear_program(c: np.ndarray, A: np.ndarray, b: np.ndarray, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """min c'x with Ax = b, x >= 0, by a predictor-corrector interior point method: (x, multipliers of the rows)."""
    def solve(d, r):
        m = (A * d) @ A.T
        return np.linalg.lstsq(m + 1e-14 * np.trace(m) / len(m) * np.eye(len(m)), r, rcond=None)[0]

    x, y = A.T @ np.linalg.lstsq(A @ A.T, b, rcond=None)[0], np.linalg.lstsq(A.T, c, rcond=None)[0]
    s = c - A.T @ y
    x, s = x + max(-1.5 * x.min(), 0) + 1e-2, s + max(-1.5 * s.min(), 0) + 1e-2
    size, best = 1 + abs(b).max() + abs(c).max(), None
    for _ in range(200):
        rp, rd, mu = b - A @ x, c - A.T @ y - s, x @ s / len(x)
        worst = max(abs(rp).max(), abs(rd).max(), mu) / size
        if best is None or worst < best[0]:
            best = (worst, x, y)
        if worst < tol or not np.isfinite(worst):
            break
        d = x / s

        def move(target):
            dy = solve(d, rp + A @ (d * rd - (target - x * s) / s))
            ds = rd - A.T @ dy
            return (target - x * s) / s - d * ds, dy, ds

        far = lambda v, dv: min(1.0, (-v[dv < 0] / dv[dv < 0]).min(initial=np.inf))
        dx, dy, ds = move(0)
        near = (x + far(x, dx) * dx) @ (s + far(s, ds) * ds) / len(x)
        dx, dy, ds = move((near / mu) ** 3 * mu - dx * ds)
        a, e = 0.995 * far(x, dx), 0.995 * far(s, ds)
        x, y, s = np.maximum(x + a * dx, 1e-300), y + e * dy, np.maximum(s + e * ds, 1e-300)
    return best[1], best[2]


def master(cuts: np.ndarray, cap: float) -> tuple[np.ndarray, float]:
    """Weights with the least of the highest cut, and a lower bound of it that holds whatever the rounding."""
    k, n = cuts.shape
    scale = max(np.abs(cuts).max(), 1e-300)
    g = cuts / scale
    low = g.min()
    tops = cap < 1
    A = np.zeros((k + 1 + n * tops, 2 * n * tops + n * (not tops) + k + 1))
    at = n * (1 + tops)
    A[:k, :n], A[:k, at:at + k], A[:k, -1] = g, np.eye(k), -1
    A[k, :n] = 1
    if tops:
        A[k + 1:, :n], A[k + 1:, n:2 * n] = np.eye(n), np.eye(n)
    c = np.zeros(A.shape[1])
    c[-1] = 1
    x, y = linear_program(c, A, np.concatenate([np.full(k, low), [1.0], np.full(n * tops, cap)]))
    mix = np.maximum(-y[:k], 0)
    mix = mix / mix.sum() if mix.sum() > 0 else np.full(k, 1 / k)
    cost = mix @ cuts
    return _simplex(x[:n], cap), float(cost @ cheapest(cost, cap))


def min_cvar(panel: DataFrame, date: str, symbol: str, x: str, alpha: float = 0.95, cap: float = 1.0, tol: float = 1e-6) -> DataFrame:
    """Long-only weights with the least expected shortfall over the scenarios: symbol, weight, cvar, lower, gap, passes.

    The shortfall of weights w is the mean loss of the worst (1 - alpha) share of the dates, the last of them in part.  Those dates'
    mean losses per symbol, g, bound the shortfall of all weights from below: g'w.  A pass takes several candidate weights,
    makes one such cut of each in Spark, and a small linear program over all cuts gives the next candidates and a lower
    bound.  It ends when best and bound differ by at most `tol` of the best; without progress at the limit of doubles it ends
    too, and `gap` says what is left.

    Scenarios are laid out once, a row a date with its returns (a symbol without a return on a date counts as zero there).  A pass
    ranks narrow (candidate, date, loss) rows by value ranges and reads the returns of tail dates only.  What one task holds is
    the universe times the cuts.
    """
    d = panel.where(F.col(x).isNotNull())
    names = kept(d.agg(F.sort_array(F.collect_set(symbol)).alias("names")))                              # one row, the universe
    place = names.select(F.posexplode("names").alias("i", symbol))
    layout = kept(d.join(place, symbol).groupBy(F.col(date).alias("_date")).agg(F.collect_list(F.struct("i", F.col(x).cast("double").alias("x"))).alias("v")))
    size = kept(layout.agg(F.count(F.lit(1)).alias("_t")))
    seen = checkpointed(names.select(F.lit(0).alias("cand"), F.transform("names", lambda _: 1.0 / F.size("names")).alias("w"), F.lit(None).cast("double").alias("lower")))

    def evaluated(cands: DataFrame) -> DataFrame:
        """(cand, w, cut): the mean loss per symbol in the tail of each candidate."""
        ws = cands.agg(F.collect_list(F.struct("cand", "w")).alias("_ws"))                              # one row
        loss = F.transform("_ws", lambda c: F.struct(c["cand"].alias("cand"), F.aggregate("v", F.lit(0.0), lambda a, e: a - e["x"] * F.element_at(c["w"], e["i"] + 1)).alias("loss")))
        days = layout.crossJoin(F.broadcast(ws)).select("_date", F.inline(loss)).withColumn("_gain", -F.col("loss"))
        ranked = index_rows(days, SeriesSpec(("cand",), ("_gain", "_date"), "cast(floor(_gain * 1024) as bigint)"))
        m = (1 - alpha) * F.col("_t")
        share = F.when(F.col(RN) < F.floor(m), 1 / m).otherwise((m - F.floor(m)) / m)
        tail = ranked.crossJoin(F.broadcast(size)).where(F.col(RN) <= F.floor(m)).select("cand", "_date", share.alias("share"))
        g = tail.join(layout, "_date").select("cand", "share", F.inline("v")).groupBy("cand", "i").agg(F.sum(-F.col("share") * F.col("x")).alias("g"))
        return g.groupBy("cand").agg(F.collect_list(F.struct("i", "g")).alias("cut")).join(cands.select("cand", "w"), "cand")

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.array(pdf["w"].tolist(), float)
        cuts = np.zeros_like(w)
        for k, cut in enumerate(pdf["cut"]):
            for e in cut:
                cuts[k, e["i"]] = e["g"]
        value = (cuts * w).sum(axis=1)
        b = int(value.argmin())
        point, low = master(cuts, cap)
        along = [w[b], *[w[b] + s * (point - w[b]) for s in (1.0, 0.6, 0.3, 0.1)]]
        return pd.DataFrame({"cand": np.arange(len(along)), "w": [list(v) for v in along], "lower": low, "upper": value[b]})

    cuts, best, passes = None, None, 0
    while True:
        made = checkpointed(evaluated(seen))
        cuts = made if cuts is None else checkpointed(cuts.unionByName(made))
        step = checkpointed(cuts.groupBy().applyInPandas(advance, "cand int, w array<double>, lower double, upper double"))
        passes += 1
        low, up = step.where("cand = 0").select("lower", "upper").first()
        low = max(low, best[0]) if best else low                           # every bound holds
        gap = (up - low) / max(abs(up), 1e-300)
        stuck = best is not None and passes - best[2] >= 30
        if best is None or gap < best[1] - 1e-15:
            best = (low, gap, passes)
        if gap <= tol or stuck:
            break
        seen = step.where("cand > 0").select("cand", "w", "lower")
    out = step.where("cand = 0").crossJoin(F.broadcast(names)).select(F.inline(F.arrays_zip(F.col("names").alias(symbol), F.col("w").alias("weight"))), F.col("upper").alias("cvar"))
    return out.withColumns({"lower": F.lit(low), "gap": F.lit(gap), "passes": F.lit(passes)})
