"""Mixing sources to target weights with a temperature.

A source with token share p gets the weight p^a / sum p^a. The exponent a in [0, 1] is found by bisection: as small as a
target entropy asks (a share of the entropy of equal weights), and as large as needed so that no source is repeated more
than `max_repeats` times within the token budget. Each step of the search cuts the interval in 65 parts at once, so three
passes over the table of sources settle it; only one row of sums reaches the driver. Sums are taken in decimals and quotas
are whole tokens (largest remainder, together the budget), so that the result does not depend on how rows are partitioned.

The weights are realised as budgeted block permutations. A source's documents are dealt to blocks by a hash; every epoch
permutes the blocks and the documents in them anew, whole blocks are taken while the quota lasts, and the last block is
taken as far as the quota reaches (the document that crosses it is included; of equal rows only as many as are needed).
Running sums go over blocks first and then
inside one block, so that a hot source is never sorted in one task. Every selected row gets a place in [0, 1) inside its
source; merging the sources by it keeps the target mix in every stretch of the output.

Defined results: null text has no tokens; null sources are one source; a source without tokens gets its rows once and no
weight; an empty table gives an empty result. Repeated rows are one key with a number of copies: they stand together in
the permutation, each counts against the quota, and the key at the quota's end gives some of them.
"""
from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PARTS, PASSES = 64, 4
BLOCK_DOCS = 512
COPIES = 1024               # copies of one row that one task writes at a time


def tokens(text: Column) -> Column:
    """White-space separated words, counted in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def exact_sum(c: Column) -> Column:
    """Sum in decimals: the same for every order of the rows."""
    return F.sum(c.cast("decimal(38,18)")).cast("double")


def exponent(sources: DataFrame, budget: float, total: float, max_repeats: float, entropy_share: float) -> float:
    """The exponent for `sources` (tokens). Entropy falls and the largest repetition falls as the exponent grows."""
    live = sources.where("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("p"))

    def sums(xs):
        powers = [exact_sum(F.pow("p", F.lit(x))).alias(f"z{i}") for i, x in enumerate(xs)]
        logs = [exact_sum(F.pow("p", F.lit(x)) * F.log("p") * x).alias(f"l{i}") for i, x in enumerate(xs)]
        reps = [F.max(F.pow("p", F.lit(x - 1.0))).alias(f"m{i}") for i, x in enumerate(xs)]
        return live.agg(F.count(F.lit(1)).alias("n"), *powers, *logs, *reps).first()

    def search(ok):
        """Smallest exponent for which ok(entropy share, repetition) holds, given that it holds from some point on."""
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            xs = [lo + (hi - lo) * i / PARTS for i in range(PARTS + 1)]
            r = sums(xs)
            good = [i for i in range(PARTS + 1) if ok((math.log(r[f"z{i}"]) - r[f"l{i}"] / r[f"z{i}"]) / max(math.log(max(r["n"], 2)), 1e-12),
                                                      r[f"m{i}"] / r[f"z{i}"] * budget / total)]
            if not good:
                return 1.0
            if good[0] == 0:
                return xs[0]
            lo, hi = xs[good[0] - 1], xs[good[0]]
        return hi

    return max(search(lambda h, rep: h <= entropy_share), search(lambda h, rep: rep <= max_repeats))


def plan(docs: DataFrame, budget: float | None = None, max_repeats: float = 3.0, entropy_share: float = 0.97, docs_of: Column | None = None) -> DataFrame:
    """Per source: tokens, n_docs, weight, quota (whole tokens, together the budget). `docs` has source and n_tokens."""
    sources = written(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.count(F.lit(1)) if docs_of is None else docs_of).alias("n_docs")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sources.withColumns({"weight": F.lit(0.0), "quota": F.lit(0).cast("long")})
    budget = round(budget if budget is not None else total)
    a = exponent(sources, float(budget), float(total), max_repeats, entropy_share)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
    z = sources.agg(exact_sum(power)).first()[0]
    weight = power / F.lit(z)
    s = written(sources.withColumns({"weight": weight, "quota": F.floor(weight * budget).cast("long"), "_rest": weight * budget - F.floor(weight * budget)}))
    left = max(0, budget - s.agg(F.sum("quota")).first()[0])
    # rests that differ by rounding alone are ties
    more = s.where("tokens > 0").orderBy(F.round("_rest", 6).desc(), F.col("source").asc_nulls_first()).limit(left)
    more = more.select(F.col("source").alias("_more"), F.lit(1).alias("_one"))
    return (s.join(more, F.col("source").eqNullSafe(F.col("_more")), "left")
            .withColumn("quota", F.col("quota") + F.coalesce("_one", F.lit(0))).drop("_rest", "_more", "_one"))


def schedule(keys: DataFrame, sources: DataFrame, seed: int = 1) -> DataFrame:
    """Rows (row_key, source, n_tokens, copies) of `keys` repeated and cut to the quota: adds epoch, start, the number of
    copies taken, the weight and the quota."""
    s = sources.select(F.col("source").alias("_source"), "tokens", "quota", "weight", F.ceil(F.col("n_docs") / BLOCK_DOCS).alias("blocks"))
    k = keys.join(s, F.col("source").eqNullSafe(F.col("_source")))
    # whole epochs are all of a source; the epoch after them is cut
    epochs = F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int")
    k = (k.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row_key"), "blocks"))
         .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(epochs, F.lit(1)) - 1))))
    k = k.withColumn("at", F.xxhash64(F.lit(seed), "epoch", "block"))
    group = ["_source", "epoch", "at", "block"]
    sums = k.groupBy(*group).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("block_tokens"), F.first("quota").alias("_quota"), F.first("tokens").alias("_tokens"))
    before = Window.partitionBy("_source", "epoch").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (sums.withColumn("base", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)) + F.col("epoch") * F.col("_tokens"))
            .where((F.col("base") < F.col("_quota")) | (F.col("_tokens") == 0)))
    sums = sums.select(F.col("_source").alias("_s"), F.col("epoch").alias("_e"), F.col("block").alias("_b"), "base")
    k = k.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("block") == F.col("_b")))
    inside = (Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed), "row_key", "epoch"), "row_key", "n_tokens")
              .rowsBetween(Window.unboundedPreceding, -1))
    k = k.withColumn("start", F.col("base") + F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(inside), F.lit(0)))
    k = k.where((F.col("start") < F.col("quota")) | (F.col("tokens") == 0))
    takes = F.when(F.col("n_tokens") > 0, F.least("copies", F.ceil((F.col("quota") - F.col("start")) / F.col("n_tokens")))).otherwise(F.col("copies"))
    return k.select("row_key", "source", "n_tokens", "copies", "epoch", "start", takes.cast("long").alias("takes"), "weight", "quota")


def numbered(df: DataFrame, n: str, spread: bool = False) -> DataFrame:
    """Every row `n` times, numbered by `copy` from 0; `spread` deals the copies to other tasks, some at a time."""
    first = F.sequence(F.lit(0).cast("long"), (F.col(n) - 1).cast("long"), F.lit(COPIES).cast("long"))
    df = df.withColumn("copy", F.explode(first))
    if spread:
        df = df.repartition(F.col("row_key"), F.col("copy"))
    last = F.least(F.col("copy") + COPIES, F.col(n)) - 1
    return df.withColumn("copy", F.explode(F.sequence(F.col("copy"), last.cast("long"))))


def counted(keys: DataFrame) -> DataFrame:
    return written(keys.groupBy("row_key", "source", "n_tokens").agg(F.count(F.lit(1)).alias("copies")))


def query(docs: DataFrame, chunk_tokens: float = 1e6) -> DataFrame:
    """The schedule of all documents: doc_id, source, epoch, weight, n_tokens, place and the output chunk it falls in."""
    keys = counted(docs.select(F.col("doc_id").cast("long").alias("row_key"), F.col("source").cast("string").alias("source"),
                               tokens(F.col("text").cast("string")).alias("n_tokens")))
    sources = written(plan(keys.withColumn("n_tokens", F.col("n_tokens") * F.col("copies")), docs_of=F.sum("copies")))
    total = sources.agg(F.sum("quota")).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_tokens))
    out = numbered(schedule(keys, sources), "takes").withColumn("start", F.col("start") + F.col("copy") * F.col("n_tokens"))
    # rows of a source without tokens have no place of their own
    place = F.when(F.col("quota") > 0, F.col("start") / F.col("quota")).otherwise(F.pmod(F.xxhash64("row_key", "copy"), F.lit(1 << 20)) / float(1 << 20))
    # an empty document at the very end of its source stands before the end
    out = out.withColumn("place", F.least(place, F.lit(1 - 2.0 ** -53)))
    return out.select(F.col("row_key").alias("doc_id"), "source", F.col("epoch").cast("long").alias("epoch"), "weight", "n_tokens", "place",
                      F.floor(F.col("place") * chunks).cast("long").alias("chunk"))


def _plain(docs: DataFrame) -> list[Column]:
    """The columns of `docs` in a form that can be hashed."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else F.col(f"`{f.name}`")
            for f in docs.schema.fields]


def stage(docs: DataFrame) -> DataFrame:
    """Documents as often as the schedule takes them, all columns kept. Rows equal in every column are one key."""
    key, right, source = (f"_{uuid.uuid4().hex}" for _ in range(3))
    cols = _plain(docs)
    row = F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))
    keys = counted(docs.select(row.alias("row_key"), F.col("source").cast("string").alias("source"), tokens(F.col("text").cast("string")).alias("n_tokens")))
    sources = written(plan(keys.withColumn("n_tokens", F.col("n_tokens") * F.col("copies")), docs_of=F.sum("copies")))
    takes = written(schedule(keys, sources).select("row_key", "copies", "takes"))
    d = docs.withColumn(key, row)
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = d.join(takes.where("takes = copies").select(F.col("row_key").alias(right)), F.col(key) == F.col(right)).select(*names)
    # the key at a quota's end: its rows are equal, so one of them is written as often as it is taken
    part = takes.where("takes < copies").select(F.col("row_key").alias(right), "takes")
    only = part.select(right).distinct()
    one = d.join(only, F.col(key) == F.col(right), "left_semi").groupBy(key).agg(F.first(F.struct(*names)).alias(source))
    cut = one.join(part, F.col(key) == F.col(right)).select(F.col(key).alias("row_key"), source, "takes")
    return whole.unionByName(numbered(cut, "takes", spread=True).select(f"{source}.*"))
