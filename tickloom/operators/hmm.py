"""Gaussian hidden Markov models over long series: fit, filter, smoother and most likely path, exact at block edges.

A step of the chain is a matrix, so a block of rows is one n x n product: in (+, x) for probabilities, in (max, +) for paths.
Blocks are composed in two phases.  Every block sends its product (n^2 numbers for BLOCK rows), a key's products are combined
in order to the vector that enters each block from the left and from the right, and the blocks are read again with these.  So
no block starts from a guess and a hot key is as many tasks as it has blocks.  Inside a block the same is done once more with
the block cut in about sqrt(rows) chunks that advance together, so the work is matrix steps over all chunks and not a loop
over rows.

Expectation maximisation starts from a fit of the key's first block, which is already the answer for keys of one block, and
goes on with passes over all blocks until the log-likelihood of every key gains no more than `tol` of its size.  The fit
returns that gain and whether it settled.
"""
from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import BLK, RN, Series, kept
from ..session import at_most, checkpointed

BLOCK = 1 << 16
FLOOR = 1e-12                      # least variance
_ARR = T.ArrayType(T.DoubleType())


# ---------------------------------------------------------------- one block, all chunks at once
def unpack(par, n: int):
    """(pi, A, mu, var) of a flat parameter vector."""
    p = np.asarray(par, float)
    return p[:n], p[n:n + n * n].reshape(n, n), p[n + n * n:2 * n + n * n], p[2 * n + n * n:]


def pack(pi, A, mu, var) -> np.ndarray:
    return np.concatenate([pi, A.ravel(), mu, var])


def log_density(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * ((x[:, None] - mu) ** 2 / var + np.log(2 * np.pi * var))


class Block:
    """Rows of one block in chunks (steps, chunks, states); the tail of the last chunk is masked."""

    def __init__(self, x: np.ndarray, par, n: int, first: bool):
        self.n, self.rows, self.first = n, len(x), first
        self.pi, self.A, mu, var = unpack(par, n)
        log_b = log_density(x, mu, var)
        self.steps = max(1, int(np.ceil(np.sqrt(len(x)))))
        self.chunks = -(-len(x) // self.steps)
        pad = self.steps * self.chunks - len(x)
        self.x = np.pad(x, (0, pad)).reshape(self.chunks, self.steps).T
        self.top = log_b.max(axis=1)
        near = np.exp(log_b - self.top[:, None]) + 1e-300
        lay = lambda a: np.pad(a, ((0, pad), (0, 0))).reshape(self.chunks, self.steps, n).transpose(1, 0, 2)
        self.b, self.log_b = lay(near), lay(log_b)
        self.real = (np.arange(self.steps * self.chunks) < len(x)).reshape(self.chunks, self.steps).T
        move = np.broadcast_to(self.A, (self.chunks, n, n))
        begin = np.array(move)
        if first:                                   # nothing comes before the first row of a key: every state leads to pi
            begin[0] = self.pi
        self.move = [begin] + [move] * (self.steps - 1)
        with np.errstate(divide="ignore"):
            self.log_move = [np.log(begin)] + [np.log(move)] * (self.steps - 1)

    def flat(self, a: np.ndarray) -> np.ndarray:
        """(steps, chunks, ...) back to rows."""
        return np.swapaxes(a, 0, 1).reshape(self.steps * self.chunks, *a.shape[2:])[:self.rows]

    # (+, x)
    def products(self) -> np.ndarray:
        """Scaled product of each chunk."""
        v = np.broadcast_to(np.eye(self.n), (self.chunks, self.n, self.n))
        for k in range(self.steps):
            live = self.real[k][:, None, None]
            w = (v @ self.move[k]) * self.b[k][:, None, :]
            v = np.where(live, w / np.where(live, w.max(axis=(1, 2), keepdims=True), 1), v)
        return v

    def enter(self, left: np.ndarray, right: np.ndarray, products: np.ndarray):
        """Vectors that enter each chunk from the left and from the right."""
        a, z = np.empty((self.chunks, self.n)), np.empty((self.chunks, self.n))
        for i in range(self.chunks):
            a[i] = left
            left = unit(left @ products[i])
        for i in reversed(range(self.chunks)):
            z[i] = right
            right = unit(products[i] @ right)
        return a, z

    def forward(self, a: np.ndarray):
        """Filtered probabilities (steps, chunks, n) and the log-likelihood of the block."""
        out, total = np.empty((self.steps, self.chunks, self.n)), self.top.sum()
        for k in range(self.steps):
            v = (a[:, None, :] @ self.move[k])[:, 0] * self.b[k]
            c = v.sum(axis=1)
            live = self.real[k]
            total += np.log(c[live]).sum()
            a = np.where(live[:, None], v / np.where(live, c, 1)[:, None], a)
            out[k] = a
        return out, total

    def backward(self, a: np.ndarray, f: np.ndarray, z: np.ndarray):
        """Smoothed probabilities and the expected number of moves between states."""
        out, moves = np.empty_like(f), np.zeros((self.n, self.n))
        for k in reversed(range(self.steps)):
            live = self.real[k][:, None]
            out[k] = f[k] * z
            out[k] /= np.where(live, out[k].sum(axis=1, keepdims=True), 1)
            seen = self.b[k] * z
            before = f[k - 1] if k else a
            pair = before[:, :, None] * self.move[k] * seen[:, None, :]
            pair = pair / np.where(live, pair.sum(axis=(1, 2))[:, None], 1)[:, :, None]
            count = self.real[k].copy()
            if k == 0 and self.first:
                count[0] = False
            moves += pair[count].sum(axis=0)
            y = (self.move[k] @ seen[:, :, None])[:, :, 0]
            z = np.where(live, y / np.where(live, y.sum(axis=1, keepdims=True), 1), z)
        return out, moves

    # (max, +)
    def best_products(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            v = np.broadcast_to(np.log(np.eye(self.n)), (self.chunks, self.n, self.n))
        for k in range(self.steps):
            w = (v[:, :, :, None] + self.log_move[k][:, None]).max(axis=2) + self.log_b[k][:, None, :]
            v = np.where(self.real[k][:, None, None], w, v)
        return v

    def path(self, left: np.ndarray, last: int) -> np.ndarray:
        """Most likely states of the rows, given the scores before the block and the state of its last row."""
        products = self.best_products()
        enter = [left]
        for p in products[:-1]:
            enter.append((enter[-1][:, None] + p).max(axis=0))
        ends = np.empty(self.chunks, int)
        for i in reversed(range(self.chunks)):
            ends[i] = last
            last = int((enter[i] + products[i][:, last]).argmax())
        v, back = np.array(enter), np.empty((self.steps, self.chunks, self.n), int)
        for k in range(self.steps):
            s = v[:, :, None] + self.log_move[k]
            back[k] = s.argmax(axis=1)
            v = np.where(self.real[k][:, None], s.max(axis=1) + self.log_b[k], v)
        out, at, i = np.empty((self.steps, self.chunks), int), ends, np.arange(self.chunks)
        for k in reversed(range(self.steps)):
            out[k] = at
            at = np.where(self.real[k], back[k][i, at], at)
        return self.flat(out)

    # sums of one expectation step
    def sums(self, left, right) -> np.ndarray:
        """n weights, n sums of x, n sums of x^2, n^2 moves, n first-row probabilities, log-likelihood."""
        a, z = self.enter(left, right, self.products())
        f, total = self.forward(a)
        g, moves = self.backward(a, f, z)
        g = g * self.real[:, :, None]
        x = self.x[:, :, None]
        begin = g[0, 0] if self.first else np.zeros(self.n)
        return np.concatenate([g.sum((0, 1)), (g * x).sum((0, 1)), (g * x * x).sum((0, 1)), moves.ravel(), begin, [total]])


def unit(v: np.ndarray) -> np.ndarray:
    return v / v.sum(axis=-1, keepdims=True)


def maximised(s: np.ndarray, n: int) -> np.ndarray:
    """Parameters that fit the sums of an expectation step."""
    w, wx, wxx, moves, begin = s[:n], s[n:2 * n], s[2 * n:3 * n], s[3 * n:3 * n + n * n].reshape(n, n), s[3 * n + n * n:4 * n + n * n]
    w = np.maximum(w, 1e-300)
    mu = wx / w
    var = np.maximum(wxx / w - mu * mu, 0) + FLOOR
    out = moves.sum(axis=1, keepdims=True)
    A = np.where(out > 0, moves / np.where(out > 0, out, 1), np.eye(n))
    return pack(unit(begin), A, mu, var)


def begun(x: np.ndarray, n: int) -> np.ndarray:
    """Start: groups of equal size by absolute value, calm rows first; states last long."""
    groups = [g if len(g) else np.arange(len(x)) for g in np.array_split(np.argsort(np.abs(x), kind="stable"), n)]
    stay = 0.95 if n > 1 else 1.0
    A = np.full((n, n), (1 - stay) / max(n - 1, 1))
    np.fill_diagonal(A, stay)
    return pack(np.full(n, 1 / n), A, np.array([x[g].mean() for g in groups]), np.array([x[g].var() + FLOOR for g in groups]))


def fit_block(x: np.ndarray, n: int, limit: int, tol: float) -> np.ndarray:
    par, before = begun(x, n), -np.inf
    for _ in range(limit):
        s = Block(x, par, n, True).sums(np.full(n, 1 / n), np.full(n, 1 / n))
        if s[-1] - before <= tol * max(1.0, abs(s[-1])):
            break
        par, before = maximised(s, n), s[-1]
    return par


# ---------------------------------------------------------------- all blocks
class Chain:
    """A series in blocks of rows with the values of one column; null values are left out."""

    def __init__(self, s: Series, x: str, states: int = 2, block: int = BLOCK):
        self.keys, self.n, self.column = s.keys, states, x
        d = s.flat().df.select(*s.keys, F.col(RN), F.expr(f"{RN} div {block}").alias(BLK), F.col(x).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
        mean = d.groupBy(*s.keys).agg(F.avg("_x").alias("_mean"))        # sums of squares are taken around it
        d = kept(self._on(d, mean).withColumn("_x", F.col("_x") - F.col("_mean")).drop("_mean"))
        self.parts = max(1, min(d.select(*s.keys, BLK).distinct().count(), int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        self.rows = kept(d.repartition(self.parts, *s.keys, BLK))
        firsts = self.rows.groupBy(*s.keys).agg(F.min(BLK).alias("_first"))
        self.blocks = kept(self._on(self.rows.select(*s.keys, BLK).distinct(), firsts).withColumn("_first", F.col("_first") == F.col(BLK)))
        self.fields = [d.schema[k] for k in s.keys]

    def _on(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Left and right rows of one key; with no keys there is one series and b is one row."""
        return a.join(b, self.keys) if self.keys else a.crossJoin(F.broadcast(b))

    def _schema(self, *more: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([*self.fields, *[T.StructField(k, t) for k, t in more]])

    def _blockwise(self, info: DataFrame, fn, *out: tuple[str, T.DataType]) -> DataFrame:
        """fn(rows in order, info row) for each block that `info` names; the rows are not moved again."""
        keys, names = [*self.keys, BLK], [*self.keys, *[k for k, _ in out]]

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({k: pd.Series([], dtype=object) for k in names})
            made = fn(left.sort_values(RN), right.iloc[0])
            for k in keys[:-1]:
                made[k] = right[k].iloc[0]
            return made[names]

        info = info.select(*[F.col(c).alias(c) for c in info.columns])              # columns of their own: `info` comes from the rows
        return self.rows.groupBy(*keys).cogroup(info.groupBy(*keys)).applyInPandas(run, self._schema(*out))

    def _keywise(self, d: DataFrame, fn, *out: tuple[str, T.DataType]) -> DataFrame:
        """fn(a key's blocks in order): a few numbers a block."""
        keys, names = self.keys, [*self.keys, *[k for k, _ in out]]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            made = fn(pdf.sort_values(BLK) if BLK in pdf else pdf)
            for k in keys:
                made[k] = pdf[k].iloc[0]
            return made[names]

        return d.groupBy(*keys).applyInPandas(run, self._schema(*out))

    def start(self, limit: int, tol: float) -> DataFrame:
        """Parameters fitted to the first block of each key."""
        n = self.n
        return self._blockwise(self.blocks.where("_first"), lambda v, _: pd.DataFrame({"par": [fit_block(v["_x"].to_numpy(), n, limit, tol)]}), ("par", _ARR))

    def entries(self, par: DataFrame) -> DataFrame:
        """What enters each block from both sides: keys, block, par, left, right."""
        n = self.n

        def product(v, info):
            p = Block(v["_x"].to_numpy(), info["par"], n, bool(info["_first"])).products()
            out = functools.reduce(lambda a, b: (lambda m: m / m.max())(a @ b), p)
            return pd.DataFrame({BLK: [info[BLK]], "_first": [info["_first"]], "par": [info["par"]], "_m": [out.ravel()]})

        def combine(v):
            m = [np.asarray(a).reshape(n, n) for a in v["_m"]]
            left, right = [np.full(n, 1 / n)], [np.full(n, 1 / n)]
            for a in m[:-1]:
                left.append(unit(left[-1] @ a))
            for a in reversed(m[1:]):
                right.append(unit(a @ right[-1]))
            return pd.DataFrame({BLK: v[BLK].to_numpy(), "_first": v["_first"].to_numpy(), "par": list(v["par"]), "left": left, "right": right[::-1]})

        cols = ((BLK, T.LongType()), ("_first", T.BooleanType()), ("par", _ARR))
        made = self._blockwise(self._on(self.blocks, par.select(*self.keys, "par")), product, *cols, ("_m", _ARR))
        return self._keywise(made, combine, *cols, ("left", _ARR), ("right", _ARR))

    def fit(self, limit: int = 200, tol: float = 1e-10) -> DataFrame:
        """keys, par, loglik, gain (of the last pass, as a share), passes, settled.

        Keys that settled keep their row and are not read again.  Each pass cuts the lineage in the shared folder.
        """
        with at_most(self.rows.sparkSession, self.parts):
            return self._passes(limit, tol)

    def _passes(self, limit: int, tol: float) -> DataFrame:
        n = self.n
        open_ = checkpointed(self.start(limit, tol).withColumn("loglik", F.lit(float("-inf"))))
        done = None
        width = 4 * n + n * n + 1
        for i in range(limit):
            e = self._blockwise(self.entries(open_), lambda v, info: pd.DataFrame({"_s": [Block(v["_x"].to_numpy(), info["par"], n, bool(info["_first"])).sums(np.asarray(info["left"]), np.asarray(info["right"]))]}), ("_s", _ARR))
            total = e.groupBy(*self.keys).agg(F.array(*[F.sum(F.col("_s")[j]) for j in range(width)]).alias("_s"))
            step = self._on(total, open_.withColumnRenamed("par", "_old").withColumnRenamed("loglik", "_was"))

            def better(v):
                s, was = np.asarray(v["_s"].iloc[0], float), float(v["_was"].iloc[0])
                gain = (s[-1] - was) / max(1.0, abs(s[-1]))
                settled = bool(gain <= tol)
                return pd.DataFrame({"par": [v["_old"].iloc[0] if settled else maximised(s, n)], "loglik": [s[-1]], "gain": [gain], "settled": [settled]})

            made = checkpointed(self._keywise(step, better, ("par", _ARR), ("loglik", T.DoubleType()), ("gain", T.DoubleType()), ("settled", T.BooleanType())).withColumn("passes", F.lit(i + 1)))
            last = i + 1 == limit
            ready = made if last else made.where("settled")
            done = ready if done is None else done.unionByName(ready)
            open_ = made.where("not settled").select(*self.keys, "par", "loglik")
            if last or open_.isEmpty():
                break
        return done

    def states(self, par: DataFrame) -> DataFrame:
        """A row for each value: keys, row number, state on the most likely path, and arrays of filtered and smoothed
        probabilities; states are numbered by ascending variance."""
        n = self.n
        order = lambda info: np.argsort(unpack(info["par"], n)[3], kind="stable")

        def best(v, info):
            p = Block(v["_x"].to_numpy(), info["par"], n, bool(info["_first"])).best_products()
            m = functools.reduce(lambda a, b: (a[:, :, None] + b[None]).max(axis=1), p)
            return pd.DataFrame({**{c: [info[c]] for c in (BLK, "_first", "par", "left", "right")}, "_m": [m.ravel()]})

        def combine(v):
            m = [np.asarray(a).reshape(n, n) for a in v["_m"]]
            score = [np.zeros(n)]
            for a in m:
                score.append((score[-1][:, None] + a).max(axis=0))
            last = [int(score[-1].argmax())]
            for s, a in zip(score[-2:0:-1], m[:0:-1]):
                last.append(int((s + a[:, last[-1]]).argmax()))
            out = v[[BLK, "_first", "par", "left", "right"]].reset_index(drop=True)
            return out.assign(score=score[:-1], last=last[::-1])

        def rows(v, info):
            b = Block(v["_x"].to_numpy(), info["par"], n, bool(info["_first"]))
            a, z = b.enter(np.asarray(info["left"]), np.asarray(info["right"]), b.products())
            f, _ = b.forward(a)
            g, _ = b.backward(a, f, z)
            o = order(info)
            path = np.argsort(o)[b.path(np.asarray(info["score"], float), int(info["last"]))]
            return pd.DataFrame({RN: v[RN].to_numpy(), "state": path, "filtered": list(b.flat(f)[:, o]), "smoothed": list(b.flat(g)[:, o])})

        cols = ((BLK, T.LongType()), ("_first", T.BooleanType()), ("par", _ARR), ("left", _ARR), ("right", _ARR))
        with at_most(self.rows.sparkSession, self.parts):
            made = self._blockwise(checkpointed(self.entries(par)), best, *cols, ("_m", _ARR))
            info = checkpointed(self._keywise(made, combine, *cols, ("score", _ARR), ("last", T.LongType())))
        return self._blockwise(info, rows, (RN, T.LongType()), ("state", T.LongType()), ("filtered", _ARR), ("smoothed", _ARR))


def model(fitted: DataFrame, keys: list[str], states: int = 2) -> DataFrame:
    """One row a key and state, by ascending variance: start probability, moves to each state, variance, log-likelihood."""
    n = states
    par = lambda at: F.element_at("par", at)
    cells = F.array_sort(F.array(*[F.struct(par(2 * n + n * n + i + 1).alias("variance"), F.lit(i).alias("i")) for i in range(n)]))
    d = fitted.withColumn("_order", cells).select("*", F.posexplode("_order").alias("state", "_c"))
    i = F.col("_c")["i"]
    to = F.transform("_order", lambda c: F.element_at("par", n + 1 + i * n + c["i"]))
    return d.select(*keys, "state", par(i + 1).alias("start"), to.alias("moves"), F.col("_c")["variance"].alias("variance"), par(n + n * n + 1 + i).alias("offset"), "loglik", "gain", "passes", "settled")


def hmm_regimes(s: Series, x: str, states: int = 2, block: int = BLOCK, limit: int = 200, tol: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """(rows, fit): states of all rows and the fitted parameters of all keys."""
    chain = Chain(s, x, states, block)
    fitted = chain.fit(limit, tol)
    return chain.states(fitted), fitted
