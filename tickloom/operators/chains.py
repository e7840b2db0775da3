"""Hash chains of audit records: every record holds the hash of the one before it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import Series, SeriesSpec

START = "0" * 64


def digest(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, body), 256)


def sealed(df: DataFrame, keys: list[str], order: str, body: Column) -> DataFrame:
    """Records with `prev` and `hash`.  A hash needs the one before it, so writing a chain is sequential: one chain, one row's
    work; many short chains (a conversation, a user's session) are parallel.  Checking has no such limit."""
    g = df.withColumn("_body", body).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_body").alias("body")))).alias("r"))

    def step(s, x):
        h = digest(s["last"], x["body"])
        return F.struct(h.alias("last"), F.array_append(s["out"], F.struct(x["at"].alias("at"), x["body"].alias("body"), s["last"].alias("prev"), h.alias("hash"))).alias("out"))

    start = F.struct(F.lit(START).alias("last"), F.array().cast("array<struct<at:bigint,body:string,prev:string,hash:string>>").alias("out"))
    return g.select(*keys, F.inline(F.aggregate("r", start, step, lambda s: s["out"]))).withColumnRenamed("at", order)


def verify(records: DataFrame, spec: SeriesSpec, body: str = "body", prev: str = "prev", hash_: str = "hash") -> DataFrame:
    """keys, records, first_broken: the first record whose own hash or whose link to the record before it is wrong, by position
    from 0; -1 for an intact chain.

    Every record is checked alone and against its neighbour.  A chain is cut in blocks of rows and only the last row of a block
    is copied to the next one, so one long chain is as many tasks as it has blocks.
    """
    s = Series.of(records, spec, back=1)
    rn = F.col("_rn")
    linked = F.col(prev) == F.when(rn == 0, F.lit(START)).otherwise(s.lag(hash_))
    whole = digest(F.col(prev), F.coalesce(F.col(body), F.lit(""))) == F.col(hash_)
    d = s.add(_ok=F.coalesce(linked & whole, F.lit(False))).flat().df
    return d.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.min(F.when(~F.col("_ok"), rn)), F.lit(-1)).alias("first_broken"))
