"""Recurrences over long series, parallel inside one key.

`affine`     y_t = a y_{t-1} + b_t with a fading state: blocks overlap by the rows the state needs to fade.
`linear`     the same without a bound on the memory: blocks are reduced to pairs and carries joined back.
`states`     finite-state positions.  A row maps every previous state to a next state; maps compose like pairs do.
`sequential` anything else that has a small state.  Blocks start from a guessed state and are re-run only where the
             exit of the block before differs from the guess, until no guess is wrong (exact).
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import BLK, RN, Series
from .session import checkpointed


def _extend(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float)


def _prefix_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive composition of y -> a y + b, by doubling (log n vector passes)."""
    p, q = a.copy(), b.copy()
    d, n = 1, a.size
    while d < n:
        q[d:] = p[d:] * q[:-d] + q[d:]
        p[d:] = p[d:] * p[:-d]
        p[np.abs(p) < 1e-290] = 0.0
        d *= 2
    return p, q


@dataclass(frozen=True)
class Recur:
    """y_t = a y_{t-1} + b_t.

    a, b     columns (or numbers); a NULL b leaves the state as it is and reports NULL
    at       row number of the first value, taken from `seed` (NULL before); None starts from zero on row 0
    seed     column whose last `n` values (mean or sum) start the recurrence
    memory   rows after which an older state no longer changes a double; derived from `a` when it is a number
    """

    a: Column | float
    b: Column
    at: int | None = None
    seed: Column | None = None
    n: int = 1
    how: str = "mean"
    memory: int | None = None

    def rows(self) -> int:
        if self.memory is not None:
            return self.memory
        return math.ceil(42.0 / -math.log(self.a)) if self.a > 0 else 1


def affine(s: Series, scans: dict[str, Recur]) -> Series:
    """Add one column per fading recurrence, all in one pass over the blocks.

    A fading state (|a| < 1) older than `memory` rows is below the rounding of a double, so every block starts that
    many halo rows early from zero: one exchange, no carry between blocks, no hot task.
    """
    names = list(scans)
    base = s.flat().df.columns
    s = s.flat()
    schema = s.df.schema
    cols = {}
    for i, n in enumerate(names):
        r = scans[n]
        cols[f"_a{i}"] = (r.a if isinstance(r.a, Column) else F.lit(float(r.a))).cast("double")
        cols[f"_b{i}"] = r.b.cast("double")
        if r.seed is not None:
            cols[f"_x{i}"] = r.seed.cast("double")
    h = replace(s, df=s.df.withColumns(cols)).halo(max(r.rows() for r in scans.values()))
    block, keys = h.block, h.keys
    plan = [(n, scans[n].at, scans[n].n, scans[n].how, scans[n].seed is not None) for n in names]

    def fill(table: pa.Table) -> pa.Table:
        rn = table.column(RN).to_numpy()
        order = np.argsort(rn, kind="stable")
        rn = rn[order]
        own = rn // block == table.column(BLK)[0].as_py()
        res = table.select(base).take(pa.array(order[own]))
        for i, (name, at, n, how, seeded) in enumerate(plan):
            a, b = _floats(table, f"_a{i}")[order], _floats(table, f"_b{i}")[order]
            if at is not None:
                k = int(np.searchsorted(rn, at))
                b = np.where(rn < at, np.nan, b)
                if seeded and k < rn.size and rn[k] == at:
                    w = _floats(table, f"_x{i}")[order][max(k - n + 1, 0):k + 1]
                    a[k], b[k] = 0.0, (w.sum() if how == "sum" else w.mean())
            idle = np.isnan(b)
            a, b = np.where(idle, 1.0, a), np.where(idle, 0.0, b)
            _, y = _prefix_pairs(a, b)
            res = res.append_column(name, pa.array(y[own], mask=idle[own]))
        return res

    out_schema = _extend(schema, *[T.StructField(n, T.DoubleType()) for n in names])
    df = h.df.groupBy(*keys, BLK).applyInArrow(fill, out_schema)
    return replace(s, df=df, block=block, heavy=True)


def linear(s: Series, name: str, a: Column, b: Column) -> Series:
    """One recurrence with exact carries between blocks, for coefficients whose fading has no bound in rows.

    Every block is reduced to one pair (P, Q); the pairs of a key are combined in block order (one row per block) and
    the carry of every block is joined back.
    """
    s = s.flat().shared()
    keys = s.keys
    work = s.df.withColumns({"_a": a.cast("double"), "_b": b.cast("double")})

    def pairs(table: pa.Table):
        order = np.argsort(table.column(RN).to_numpy(), kind="stable")
        x, y = _floats(table, "_a")[order], _floats(table, "_b")[order]
        idle = np.isnan(y)
        return order, idle, _prefix_pairs(np.where(idle, 1.0, x), np.where(idle, 0.0, y))

    def compose(table: pa.Table) -> pa.Table:
        _, _, (p, q) = pairs(table)
        return (table.slice(0, 1).select([*keys, BLK]).append_column("_p", pa.array([p[-1]]))
                .append_column("_q", pa.array([q[-1]])))

    key_fields = [work.schema[c] for c in [*keys, BLK]]
    num = [T.StructField(c, T.DoubleType()) for c in ("_p", "_q")]
    tails = work.select(*keys, BLK, RN, "_a", "_b").groupBy(*keys, BLK).applyInArrow(
        compose, T.StructType([*key_fields, *num]))

    def carries(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column(BLK).to_numpy(), kind="stable")))
        _, q = _prefix_pairs(_floats(table, "_p"), _floats(table, "_q"))
        return table.select([*keys, BLK]).append_column("_c", pa.array(np.r_[0.0, q[:-1]]))

    carry = tails.withColumn("_all", F.lit(0)).groupBy(*(keys or ["_all"])).applyInArrow(
        carries, T.StructType([*key_fields, T.StructField("_c", T.DoubleType())]))
    base = s.df.columns

    def fill(table: pa.Table) -> pa.Table:
        order, idle, (p, q) = pairs(table)
        y = p * table.column("_c")[0].as_py() + q
        return table.select(base).take(pa.array(order)).append_column(name, pa.array(y, mask=idle))

    out_schema = _extend(s.df.schema, T.StructField(name, T.DoubleType()))
    return replace(s, df=work.join(carry, [*keys, BLK]).groupBy(*keys, BLK).applyInArrow(fill, out_schema), heavy=True)


def _prefix_maps(m: np.ndarray) -> np.ndarray:
    """Inclusive composition of state maps, rows applied in order."""
    out = m.copy()
    d, n = 1, m.shape[0]
    while d < n:
        nxt = out.copy()
        nxt[d:] = np.take_along_axis(out[d:], out[:-d], axis=1)
        out = nxt
        d *= 2
    return out


def states(s: Series, name: str, values: tuple[int, ...], nxt: Callable[[int], Column], start: int = 0) -> Series:
    """Add an int column following `nxt(previous value) -> Column of the next value` from `start`."""
    s = s.flat().shared()
    keys, k = s.keys, len(values)
    place = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
    cols = {f"_m{i}": F.element_at(place, nxt(v).cast("int")) for i, v in enumerate(values)}
    work = s.df.withColumns(cols)
    start_i = values.index(start)

    def maps(table: pa.Table):
        order = np.argsort(table.column(RN).to_numpy(), kind="stable")
        m = np.stack([table.column(f"_m{i}").to_numpy()[order] for i in range(k)], axis=1)
        return order, _prefix_maps(m.astype(np.int64))

    def compose(table: pa.Table) -> pa.Table:
        _, m = maps(table)
        return table.slice(0, 1).select([*keys, BLK]).append_column("_map", pa.array([m[-1].tolist()]))

    key_fields = [work.schema[c] for c in [*keys, BLK]]
    tails = (work.select(*keys, BLK, RN, *cols).groupBy(*keys, BLK)
             .applyInArrow(compose, T.StructType([*key_fields, T.StructField("_map", T.ArrayType(T.LongType()))])))

    def carries(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(BLK).to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        m = _prefix_maps(np.array(table.column("_map").to_pylist(), dtype=np.int64))
        return table.select([*keys, BLK]).append_column("_c", pa.array(np.r_[start_i, m[:-1, start_i]]))

    carry = tails.withColumn("_all", F.lit(0)).groupBy(*(keys or ["_all"])).applyInArrow(
        carries, T.StructType([*key_fields, T.StructField("_c", T.LongType())]))
    base = s.df.columns
    lookup = np.array(values, dtype=np.int32)

    def fill(table: pa.Table) -> pa.Table:
        order, m = maps(table)
        st = m[:, table.column("_c")[0].as_py()]
        return table.select(base).take(pa.array(order)).append_column(name, pa.array(lookup[st]))

    out_schema = _extend(s.df.schema, T.StructField(name, T.IntegerType()))
    return replace(s, df=work.join(carry, [*keys, BLK]).groupBy(*keys, BLK).applyInArrow(fill, out_schema), heavy=True)


def sequential(s: Series, inputs: list[str], step: Callable, init: list[float],
               outputs: dict[str, T.DataType], max_rounds: int = 1_000_000) -> Series:
    """Add `outputs` by `step(rows: dict[str, ndarray], state: list[float]) -> (dict[str, ndarray], list[float])`.

    The state is a short list of doubles.  Blocks of one key run in parallel from a guessed entry state; a block is
    run again when the block before it left another state.  Machines that reset (stops, flips, alarms) settle after
    one or two rounds; a machine that never forgets costs one round per block but stays exact.
    """
    s = s.flat().shared()
    keys = s.keys
    slim = s.df.select(*keys, BLK, RN, *inputs)
    many = not s.df.where(F.col(BLK) > 0).isEmpty()
    key_fields = [s.df.schema[c] for c in [*keys, BLK]]
    state_t = T.ArrayType(T.DoubleType())

    def rows_of(table: pa.Table):
        order = np.argsort(table.column(RN).to_numpy(), kind="stable")
        arrays = {RN: table.column(RN).to_numpy()[order]}
        for c in inputs:
            arrays[c] = table.column(c).to_numpy()[order]
        return order, arrays

    def run_exit(table: pa.Table) -> pa.Table:
        _, arrays = rows_of(table)
        entry = table.column("_entry")[0].as_py()
        _, leave = step(arrays, list(entry))
        kind = pa.list_(pa.float64())
        out = table.slice(0, 1).select([*keys, BLK]).append_column("_entry", pa.array([entry], type=kind))
        return out.append_column("_exit", pa.array([[float(v) for v in leave]], type=kind))

    entries = None
    if many:
        exit_schema = T.StructType([*key_fields, T.StructField("_entry", state_t), T.StructField("_exit", state_t)])
        first = F.array(*[F.lit(float(v)) for v in init])
        w = Window.partitionBy(*keys).orderBy(BLK)
        done = checkpointed(slim.withColumn("_entry", first).groupBy(*keys, BLK).applyInArrow(run_exit, exit_schema))
        for _ in range(max_rounds):
            want = done.withColumn("_want", F.coalesce(F.lag("_exit").over(w), first))
            wrong = want.where(~F.col("_want").eqNullSafe(F.col("_entry")))
            if wrong.isEmpty():
                break
            todo = wrong.select(*keys, BLK, F.col("_want").alias("_entry"))
            redo = (slim.join(todo, [*keys, BLK]).groupBy(*keys, BLK).applyInArrow(run_exit, exit_schema))
            kept = done.join(todo.select(*keys, BLK), [*keys, BLK], "left_anti")
            done = checkpointed(kept.unionByName(redo))
        else:
            raise RuntimeError(f"block states have not settled after {max_rounds} rounds")
        entries = done.select(*keys, BLK, "_entry")

    work = s.df.join(entries, [*keys, BLK]) if many else s.df.withColumn(
        "_entry", F.array(*[F.lit(float(v)) for v in init]))
    base = s.df.columns
    out_schema = _extend(s.df.schema, *[T.StructField(n, t) for n, t in outputs.items()])
    arrow_types = {n: _arrow(t) for n, t in outputs.items()}

    def fill(table: pa.Table) -> pa.Table:
        order, arrays = rows_of(table)
        res, _ = step(arrays, list(table.column("_entry")[0].as_py()))
        out = table.select(base).take(pa.array(order))
        for n, t in arrow_types.items():
            v = np.asarray(res[n])
            mask = np.isnan(v) if v.dtype.kind == "f" else None
            if v.dtype.kind == "f" and not pa.types.is_floating(t):
                v = np.where(mask, 0, v)
            out = out.append_column(n, pa.array(v, mask=mask).cast(t))
        return out

    return replace(s, df=work.groupBy(*keys, BLK).applyInArrow(fill, out_schema), heavy=True)


def _arrow(t: T.DataType) -> pa.DataType:
    return {T.DoubleType(): pa.float64(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(),
            T.BooleanType(): pa.bool_()}[t]
