"""Document fingerprints from Merkle trees.

Leaves are paragraphs (lines); a section ends at an empty line or after a paragraph whose digest says so, so that an edit
moves no distant border; a section's digest covers its paragraphs' digests and the root covers the sections'. Equal roots
mean equal texts, and following differing branches down from two roots locates an edit.

A fingerprint is the root and a bounded sketch of the level below paragraphs: runs of about six words with content-defined
borders, of whose digests the `KEPT` smallest are kept. The likeness of two fingerprints estimates the share of runs they
have in common (Dice), and is exact while a text has no more than `KEPT` different runs.

The query pairs each document with the next by id: rows are range-partitioned by id and sorted, pairs inside a partition are
made while reading it, and only the last row of a partition is joined with the first of the next.

Defined results: null text counts as empty; two texts without words are alike (1), a text with and one without are not (0).
Rows with equal ids follow each other by text; rows without an id come first. A single row is its own next document.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import written

KEPT = 64                 # run digests in a fingerprint
RUN = 6                   # mean words of a run
SECTION = 8               # mean paragraphs of a section without empty lines


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def paragraphs(text: str) -> list[bytes]:
    return [digest(p.encode("utf-8", "surrogatepass")) for p in text.split("\n")]


def sections(leaves: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(first paragraph, end, digest) of each section."""
    out, at, empty = [], 0, digest(b"")
    for i, leaf in enumerate(leaves):
        if leaf == empty or leaf[0] % SECTION == 0 or i + 1 == len(leaves):
            out.append((at, i + 1, digest(b"".join(leaves[at: i + 1]))))
            at = i + 1
    return out


def root(text: str) -> bytes:
    return digest(b"".join(d for *_, d in sections(paragraphs(text))))


def differing(a: str, b: str) -> tuple[int, int] | None:
    """Code points (start, end) of `a` outside of which it equals `b` at the borders of paragraphs; None for equal texts."""
    x, y = paragraphs(a), paragraphs(b)
    s, t = sections(x), sections(y)
    if [d for *_, d in s] == [d for *_, d in t]:
        return None
    # sections first, then the paragraphs of the first and last sections that differ
    k = next((i for i, (u, v) in enumerate(zip(s, t)) if u[2] != v[2]), min(len(s), len(t)))
    i = s[k][0] if k < len(s) else len(x)
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    j = 0
    while j < min(len(x), len(y)) - i and x[-1 - j] == y[-1 - j]:
        j += 1
    sizes = [len(p) + 1 for p in a.split("\n")]
    return sum(sizes[:i]), max(sum(sizes[:i]), sum(sizes[: len(x) - j]) - 1)


def sketch(text: str) -> np.ndarray:
    """The smallest digests of the text's runs of words, sorted, as 32-bit numbers."""
    w = hashing.word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(w):
        return np.empty(0, np.uint32)
    border = (w % np.uint64(RUN) == 0)
    start = np.flatnonzero(np.concatenate(([True], border[:-1])))
    place = np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
    runs = np.add.reduceat(hashing.mix(w + place.astype(np.uint64) * np.uint64(hashing.BASE)), start)
    return np.unique((hashing.mix(runs) >> np.uint64(32)).astype(np.uint32))[:KEPT]


def fingerprint(text: str) -> str:
    return f"{root(text).hex()}:{sketch(text).astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone; 1 for equal roots."""
    ra, _, sa = a.partition(":")
    rb, _, sb = b.partition(":")
    if ra == rb:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (sa, sb))
    if not len(x) or not len(y):
        return 1.0 if len(x) == len(y) else 0.0
    low = np.union1d(x, y)[: max(KEPT if max(len(x), len(y)) == KEPT else len(x) + len(y), 1)]
    j = len(np.intersect1d(np.intersect1d(x, y), low)) / len(low)
    return 2 * j / (1 + j)


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long, edit_end long"


def _row(doc_id, text: str, mark: str, after: str, after_mark: str) -> tuple:
    new = edited(text, after)
    m = fingerprint(new)
    where = differing(text, new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, m, likeness(mark, m), likeness(mark, after_mark),
            *(where if where else (None, None)))


def _pairs(batches):
    """Finished rows, and the first and last row of the partition with their texts."""
    part, held = TaskContext.get().partitionId(), None
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def frame(rows, kind, text):
        out = pd.DataFrame(rows, columns=names).assign(kind=kind, part=part, text=text)
        return out.astype({"doc_id": "Int64", "edit_start": "Int64", "edit_end": "Int64", "n_chars": "Int64"})

    for b in batches:
        rows = []
        for d, t in zip(b["doc_id"], b["text"]):
            mark = fingerprint(t)
            if held is None:
                yield frame([(d, None, None, mark, None, None, None, None, None)], "first", t)
            else:
                rows.append(_row(*held, t, mark))
            held = (d, t, mark)
        if rows:
            yield frame(rows, "done", None)
    if held:
        yield frame([(held[0], None, None, held[2], None, None, None, None, None)], "last", held[1])


def _ends(batches):
    for b in batches:
        rows = [_row(*r) for r in zip(b["doc_id"], b["text"], b["fingerprint"], b["after"], b["after_mark"])]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")]).astype({"doc_id": "Int64", "edit_start": "Int64", "edit_end": "Int64"})


def query(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    out = written(sorted_rows.mapInPandas(_pairs, f"{COLUMNS}, kind string, part int, text string"))
    # one row for each partition: the first row of the next non-empty one, the first of all after the last
    heads = out.where("kind = 'first'").select("part").withColumn("before", F.lag("part").over(Window.orderBy("part")))
    last = heads.agg(F.max("part").alias("last"))
    heads = heads.crossJoin(F.broadcast(last)).select("part", F.coalesce("before", "last").alias("before"))
    first = out.where("kind = 'first'").join(heads, "part").select(F.col("before").alias("part"), F.col("text").alias("after"), F.col("fingerprint").alias("after_mark"))
    tail = out.where("kind = 'last'").select("doc_id", "text", "fingerprint", "part").join(first, "part")
    done = out.where("kind = 'done'").select(*[c.split()[0] for c in COLUMNS.split(", ")])
    return done.unionByName(tail.select("doc_id", "text", "fingerprint", "after", "after_mark").mapInPandas(_ends, COLUMNS))
