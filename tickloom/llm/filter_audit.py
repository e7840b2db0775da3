"""Filter interaction audit: what each of five filters removes in each of its 120 orders, by Lehmer-rank difference arrays.

A document is reduced to the set of filters that it fails, a mask.  Under an order of the filters it is removed by the first
one in its mask.  All orders that begin with the same passed filters and then this one are neighbours in lexicographic order:
one interval of Lehmer ranks for each such beginning.  A cell (part, mask) therefore adds its counts at the ends of at most 65
intervals and one prefix sum over the 120 ranks gives every order at once; no document is seen once per order.

Inputs: a null text is the empty text; a null source is the part ''.  Rows with a null doc_id take part in A to D, but are
nobody's copy (E).  Rows that repeat a doc_id count each; of rows with one text, those with the smallest doc_id pass E.  A
label counts if any row of `labels` for the doc_id says so; documents without labels are neither good nor toxic.  An empty
table gives no rows.  Columns besides doc_id, text, source (and doc_id, quality, toxic of labels) are not read.
"""
from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]             # in the order of their Lehmer ranks
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def failures(text: Column) -> Column:
    """Bits 0 to 3: the text fails A (short), B (few distinct words), C (capitals), D (symbols)."""
    w = words(text)
    n = F.size(w)
    tests = [n < 200,
             100 * F.size(F.array_distinct(w)) < 50 * n,
             100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 2 * F.length(text),
             text.rlike(r"[#$%&*|]")]
    return sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))


def rank(prefix: str) -> int:
    """Lehmer rank of the first order that begins with `prefix`."""
    left, out = list(FILTERS), 0
    for c in prefix:
        i = left.index(c)
        out += i * factorial(len(left) - 1)
        left.pop(i)
    return out


def intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank after the last) of every beginning under which a document with `mask` is removed."""
    fails = [c for i, c in enumerate(FILTERS) if mask >> i & 1]
    passed = [c for c in FILTERS if c not in fails]
    out = []
    for k in range(len(passed) + 1):
        for before in permutations(passed, k):
            for c in fails:
                lo = rank("".join(before) + c)
                out.append((k + 1, lo, lo + factorial(len(FILTERS) - k - 1)))
    return out


def cover(spark) -> DataFrame:
    """(mask, step, lo, hi) for all 32 masks, 1,440 rows at every input size; mask 0 has an empty interval at each place, so
    that every (step, rank) of a part is there."""
    rows = [(m, *i) for m in range(1, 1 << len(FILTERS)) for i in intervals(m)]
    rows += [(0, s + 1, r, r) for s in range(len(FILTERS)) for r in range(len(ORDERS))]
    return spark.createDataFrame(rows, "mask int, step int, lo int, hi int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for each row of `docs`.

    Texts are read once and leave as 32-byte digests.  The smallest id of a digest is found with partial sums, so a text with
    many copies is one row a task; ids are looked up by (digest, id), which spreads the copies.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                                 failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    firsts = narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (narrow.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
            .select("part", (F.col("mask") + copy.cast("int") * 16).alias("mask"),
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


def audit(masked: DataFrame) -> DataFrame:
    """One row for each part, order and step of rows (part, mask, good, toxic)."""
    cells = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    parts = cells.groupBy("part").agg(                                # at most 32 cells a part
        F.collect_list(F.struct("mask", *COUNTS)).alias("cells"), F.sum("n").alias("total"),
        F.array(*[of(bit(i)) for i in range(len(FILTERS))]).alias("fails"),
        F.array(*[of(F.col("mask") == 1 << i) for i in range(len(FILTERS))]).alias("alone"))
    none = F.struct(F.lit(0).alias("mask"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    cells = parts.select("part", "total", "fails", "alone", F.inline(F.array_append("cells", none)))
    ends = cells.join(F.broadcast(cover(masked.sparkSession)), "mask").select(
        "part", "total", "fails", "alone", "step", *COUNTS, F.inline(F.array(*[F.struct(F.col(at).alias("rank"), F.lit(sign).alias("sign")) for at, sign in (("lo", 1), ("hi", -1))])))
    ends = ends.groupBy("part", "step", "rank").agg(
        *[F.sum(F.col("sign") * F.col(c)).alias(c) for c in COUNTS], *[F.first(c).alias(c) for c in ("total", "fails", "alone")])
    by_rank = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    by_step = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    d = ends.select("part", "step", "rank", "total", "fails", "alone", *[F.sum(c).over(by_rank).alias(c) for c in COUNTS]).where(F.col("rank") < len(ORDERS))
    d = d.withColumn("filter_order", F.element_at(F.array(*map(F.lit, ORDERS)), F.col("rank") + 1))
    d = d.withColumn("filter", F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")))
    d = d.withColumn("kept", F.col("total") - F.sum("n").over(by_step)).withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "filter")))
    return d.select("part", "filter_order", "step", "kept", F.col("n").alias("removed"), (F.element_at("fails", F.col("filter")) - F.col("n")).alias("redundant"),
                    F.element_at("alone", F.col("filter")).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    prepared(docs.sparkSession)
    return audit(masks(docs, labels))


def oracle() -> str:
    flags = [f"f{c}" for c in FILTERS]
    order = ", ".join(f"l{i}" for i in range(1, 6))
    differ = " AND ".join(f"x{i}.c <> x{j}.c" for i in range(2, 6) for j in range(1, i))
    of = lambda letter: f"CASE {letter} " + " ".join(f"WHEN '{c}' THEN f{c}" for c in FILTERS) + " END"
    before = lambda s: " AND ".join(f"NOT {of(f'l{i}')}" for i in range(1, s)) or "TRUE"
    steps = " UNION ALL ".join(
        f"""SELECT part, {' || '.join(f'l{i}' for i in range(1, 6))} AS filter_order, {s} AS step, l{s} AS letter,
 sum(CASE WHEN {before(s)} AND NOT {of(f'l{s}')} THEN n ELSE 0 END) AS kept, sum(CASE WHEN {before(s)} AND {of(f'l{s}')} THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN NOT ({before(s)}) AND {of(f'l{s}')} THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN {of(f'l{s}')} AND {' + '.join(f'{f}::INT' for f in flags)} = 1 THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN {before(s)} AND {of(f'l{s}')} THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN {before(s)} AND {of(f'l{s}')} THEN toxic ELSE 0 END) AS toxic_lost
 FROM cells, orders GROUP BY part, {order}""" for s in range(1, 6))
    return f"""WITH d AS (SELECT doc_id::BIGINT AS doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(string_split_regex(t, '{GAP}'), lambda x: x <> '') AS ws FROM d),
 f AS (SELECT part, doc_id, len(ws) < 200 AS fA, 100 * len(list_distinct(ws)) < 50 * len(ws) AS fB,
 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS fC, regexp_matches(t, '[#$%&*|]') AS fD,
 coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS fE FROM w),
 marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 cells AS (SELECT part, {', '.join(flags)}, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
 FROM f LEFT JOIN marks USING (doc_id) GROUP BY ALL),
 letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 orders AS (SELECT {', '.join(f'x{i}.c AS l{i}' for i in range(1, 6))} FROM {', '.join(f'letters x{i}' for i in range(1, 6))} WHERE {differ}),
 steps AS ({steps})
 SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM steps"""
