"""Source divergence audit: distances between the term distributions of all sources of a language, by a three-dimensional cube.

Groups are (lang, source).  The groups of a language are dealt to blocks of about GROUPS, its terms to blocks of about TERMS.
A task owns one cell (group block, group block, term block): it gets the two slices of counts, fills what is missing with the
smoothed zero of each group, and sums the distances of all its pairs of groups over its terms.  The cells of two group blocks
are then added along the term axis.  Terms that no group of either block has are not sent: they add their number times the
distance of the two zeros.  A hot source is one row a term like any other, so no cell depends on how many rows a source has.

Inputs: null text, lang and source are empty strings.  Rows that repeat a doc_id, or a whole document, count each.  Very long
texts are cut in lists of words in pieces of SLICE bytes.  A group without kept terms is listed against the other sources of
its language; an empty table gives no rows.  Columns besides text, lang and source are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, written

GROUPS, TERMS = 32, 2048         # about so many groups and terms along an edge of a cell
SALTS = 16                       # copies of a group's totals, so that its terms meet them in several tasks
LEAST_DOCS = 30                  # documents of a language that must have a term
SHOWN = 50                       # ranks of part `term`
SCALE, PRIOR = 1_000_000_000, 5
SLICE = 1 << 24                  # bytes of text cut in words at once


def letters() -> np.ndarray:
    """Byte to byte: A-Z become small, other bytes of a term stay, all else is a space."""
    out = np.full(256, 0x20, np.uint8)
    for lo, hi, shift in ((0x41, 0x5A, 0x20), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
        out[lo:hi + 1] = np.arange(lo, hi + 1) + shift
    return out


def terms_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The terms of the texts in order, and for each the number of its text."""
    table = letters()
    raw = [t.encode() for t in texts]
    data = pa.array([table[np.frombuffer(b, np.uint8)].tobytes() for b in raw], pa.large_binary()).cast(pa.large_string())
    parts = pc.split_pattern(data, " ")
    flat, home = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(flat, "")
    return flat.filter(some), home.filter(some).to_numpy()


def pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most SLICE bytes together; a longer text is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed within parts of a batch; a row without term names each group that occurs."""
    for b in batches:
        lang, source, text = (b.column(c).to_pylist() for c in ("lang", "source", "text"))
        keys = sorted(set(zip(lang, source)))
        of = {k: i for i, k in enumerate(keys)}
        group = np.array([of[k] for k in zip(lang, source)], np.int64)
        yield _rows(keys, np.arange(len(keys)), pa.nulls(len(keys), pa.string()), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64))
        for lo, hi in pieces(np.array([len(t) for t in text])):
            terms, home = terms_of(text[lo:hi])
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            pair, times = np.unique(home.astype(np.int64) * size + code, return_counts=True)        # once a document and term
            cell = group[lo:hi][pair // size] * size + pair % size
            names, at, docs = np.unique(cell, return_inverse=True, return_counts=True)
            n = np.bincount(at, weights=times, minlength=len(names)).astype(np.int64)
            yield _rows(keys, names // size, coded.dictionary.take(pa.array(names % size)).cast(pa.string()), n, docs.astype(np.int64))


def _rows(keys, at, term, n, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([keys[i][0] for i in at], pa.string()), pa.array([keys[i][1] for i in at], pa.string()), term, pa.array(n), pa.array(docs)],
                                      names=["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of the whole table; term is null in the one row that names a group."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    d = text.mapInArrow(batch_counts, "lang string, source string, term string, n long, docs long")
    return d.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * v)) in whole numbers of any size."""
    wide = lambda c: c.cast("decimal(28,0)")
    a, b = wide(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * v)
    return F.call_function("div", a, b).cast("long") + 1


def kept_counts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, n_lang) of the kept terms, and (lang, source, total, total_lang, v) of all groups."""
    vocabulary = found.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    held = written(found.where("term is not null").select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]))
    by_lang = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = (found.where("term is null").select("lang", "source")
              .join(held.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(by_lang, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "total_lang", "v")]))
    return held, groups


def placed(groups: DataFrame) -> DataFrame:
    """Groups with their block and place in it, the number of blocks of each kind, and the share of a term they lack."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / GROUPS).cast("int").alias("blocks"))
    g = groups.join(sizes, "lang")
    g = g.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1)
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)
    return g.withColumn("zero", zero).withColumn("slabs", F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("int"))


def cells(rows: DataFrame) -> DataFrame:
    """A row of block `block` goes to the cell of that block with every block."""
    d = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.select("lang", F.least("block", "_other").alias("a"), F.greatest("block", "_other").alias("b"), "slab", "block", "place", "term", "p").repartition("lang", "a", "b", "slab")


CELL = "lang string, a int, i int, b int, j int, near long, present long"


def cell_distances(key, pdf):
    """Summed distances of all pairs of groups of one cell over the terms present in it, and the number of those terms."""
    import pandas as pd
    lang, a, b, _ = key
    zeros, entries = pdf[pdf.term.isna()], pdf[pdf.term.notna()]
    code, names = pd.factorize(entries.term)
    held = {}
    for block in {a, b}:
        z = zeros[zeros.block == block].sort_values("place")
        m = np.repeat(z.p.to_numpy(np.int64)[:, None], len(names), axis=1)
        mine = (entries.block == block).to_numpy()
        m[entries.place.to_numpy()[mine], code[mine]] = entries.p.to_numpy(np.int64)[mine]
        held[block] = m
    x, y = held[a], held[b]
    out = []
    for i in range(len(x)):
        js = np.arange(i + 1 if a == b else 0, len(y))
        out.append(pd.DataFrame({"i": i, "j": js, "near": np.abs(y[js] - x[i]).sum(axis=1)}))
    d = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"i": [], "j": [], "near": []})
    return d.assign(lang=lang, a=a, b=b, present=len(names))[["lang", "a", "i", "b", "j", "near", "present"]]


def audit(found: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) from the counts of a table."""
    held, groups = kept_counts(found)
    g = written(placed(groups))
    salted = g.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = held.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])
    rows = rows.withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("slab", F.pmod(F.xxhash64("term", F.lit(1)), F.col("slabs")).cast("int"))
    rows = written(rows.withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("v"))))

    ranked = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    term = ranked(rows.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= SHOWN)

    marks = g.withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1))).select("lang", "blocks", "block", "place", "slab", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"))
    cube = cells(marks.unionByName(rows.select("lang", "blocks", "block", "place", "slab", "term", "p")))
    near = cube.groupBy("lang", "a", "b", "slab").applyInPandas(cell_distances, CELL).groupBy("lang", "a", "i", "b", "j").agg(F.sum("near").alias("near"), F.sum("present").alias("present"))
    one, two = (g.select("lang", F.col("block").alias(x), F.col("place").alias(y), F.col("source").alias(s), F.col("zero").alias(z), *v) for x, y, s, z, v in (("a", "i", "s1", "z1", ["v"]), ("b", "j", "s2", "z2", [])))
    pairs = near.join(one, ["lang", "a", "i"]).join(two, ["lang", "b", "j"])
    pairs = pairs.withColumn("value", F.col("near") + (F.col("v") - F.col("present")) * F.abs(F.col("z1") - F.col("z2")))
    both = pairs.select("lang", "value", F.inline(F.array(*[F.struct(F.col(s).alias("source"), F.col(o).alias("item")) for s, o in (("s1", "s2"), ("s2", "s1"))])))
    pair = ranked(both.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pair.unionByName(term)


def query(docs: DataFrame) -> DataFrame:
    prepared(docs.sparkSession)
    return audit(written(counts(docs)))


def oracle() -> str:
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + {PRIOR})) // ({total} + {PRIOR} * v))::BIGINT"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{large}', '{small}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 vocab AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
 c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
 g AS (SELECT DISTINCT lang, source FROM d),
 l AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM vocab GROUP BY 1),
 dense AS (SELECT g.lang, g.source, vocab.term, coalesce(c.n, 0) AS n, n_lang FROM g JOIN vocab USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = vocab.term),
 p AS (SELECT lang, source, term, n, {p('n', '(sum(n) OVER (PARTITION BY lang, source))')} AS p, {p('n_lang', 'total_lang')} AS q FROM dense JOIN l USING (lang)),
 o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(sum(abs(a.p - b.p)), 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
 LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source LEFT JOIN p b ON b.lang = y.lang AND b.source = y.source AND b.term = a.term GROUP BY 1, 2, 3, 4
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
 k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
 SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= {SHOWN}"""
