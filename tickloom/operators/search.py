"""Parameter search over rows: seeded random trials and successive halving, with every trial in the result."""
from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import RN, Series


def grid(**values: list) -> Column:
    """All combinations as an array of (config, *names), numbered in key order."""
    return F.array(*[F.struct(F.lit(i).cast("long").alias("config"), *[F.lit(v).alias(k) for k, v in zip(values, c)])
                     for i, c in enumerate(itertools.product(*values.values()))])


def random_picks(n: int, seed: int = 0, **values: list) -> Column:
    """n trials as an array of (config, *names): each value drawn evenly from its list by a hash of seed, name and trial."""
    def pick(name: str, vals: list, i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), i).cast("binary")), 1, 8), 16, 10).cast("long")
        return F.element_at(F.array(*[F.lit(v) for v in vals]), (F.shiftright(h * len(vals), 32) + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")),
                       lambda i: F.struct(i.alias("config"), *[pick(k, v, i).alias(k) for k, v in values.items()]))


def crossover_rows(s: Series, windows: list[int], close: str = "close") -> DataFrame:
    """keys, row number, `ret` of the next bar and the means of all windows as a map: one layout for every trial."""
    w = sorted(set(windows))
    s = s.halo(max(w) - 1, 1)
    s = s.add(ret=s.lead(close) / F.col(close) - 1)
    s = s.add({f"_m{n}": s.mean(close, n) for n in w})
    means = F.create_map(*itertools.chain.from_iterable((F.lit(n), F.col(f"_m{n}")) for n in w))
    return s.done(keep_rn=True).select(*s.keys, RN, "ret", means.alias("means"))


def crossover_pnl() -> Column:
    """Long above the slow mean, short below or at it, earning the next bar; null until both means are full."""
    fast, slow = F.col("means")[F.col("fast")], F.col("means")[F.col("slow")]
    return F.when(fast > slow, F.col("ret")).when(fast <= slow, -F.col("ret"))


def halving(rows: DataFrame, keys: list[str], configs: Column, pnl: Column, rungs: int = 3, keep: float = 0.5) -> DataFrame:
    """Successive halving per key: keys, rung, config, its parameters, rows, score, kept.

    Rung k of R scores the configs still alive on the first n * 2^(k-R) rows of a key by the mean of `pnl` (a Column of the
    row and the parameters) and keeps the best share `keep`, at least one, ties to the smaller config. A rung reads only
    the rows that the one before did not, and adds its sums to those at hand. With one rung it is a plain search. Configs
    without a score come last. The window of a rung holds the configs of a key, whose number is a parameter.
    """
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    alive = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_configs", configs)
    names = [f.name for f in alive.schema["_configs"].dataType.elementType.fields]
    sums, out = None, None
    for k in range(1, rungs + 1):
        upto = F.floor(F.col("_n") * 2.0 ** (k - rungs))
        since = F.floor(F.col("_n") * 2.0 ** (k - 1 - rungs)) if k > 1 else F.lit(0)
        part = rows.join(alive, keys).where((F.col(RN) >= since) & (F.col(RN) < upto))
        part = part.select(*[c for c in rows.columns], F.inline("_configs")).withColumn("_pnl", pnl)
        part = part.groupBy(*keys, "config").agg(F.sum("_pnl").alias("_s"), F.count("_pnl").alias("_c"))
        # a config without a row in this part still has its place
        listed = alive.select(*keys, F.inline("_configs"))
        part = part.persist(StorageLevel.MEMORY_AND_DISK) if k < rungs else part
        sums = part if sums is None else sums.unionByName(part).groupBy(*keys, "config").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
        rung = listed.join(sums, [*keys, "config"], "left").withColumns({"rows": F.coalesce("_c", F.lit(0)), "score": F.try_divide("_s", "_c")})
        by = Window.partitionBy(*keys)
        place = F.row_number().over(by.orderBy(F.round("score", 12).desc_nulls_last(), "config"))
        rung = rung.withColumn("kept", place <= F.greatest(F.ceil(F.count(F.lit(1)).over(by) * keep), F.lit(1)))
        # configs x keys rows; the next rungs read them
        rung = rung.select(*keys, F.lit(k).alias("rung"), *names, "rows", "score", "kept").persist(StorageLevel.MEMORY_AND_DISK)
        out = rung if out is None else out.unionByName(rung)
        if k < rungs:
            left = rung.where("kept").groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("_configs"))
            alive = alive.drop("_configs").join(left, keys)
    return out


def survivors(n: int, rungs: int, keep: float) -> list[int]:
    """Number of configs that stay after each rung."""
    out = []
    for _ in range(rungs):
        n = max(1, math.ceil(n * keep))
        out.append(n)
    return out
