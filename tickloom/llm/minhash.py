"""Near-duplicate texts by circulant MinHash.

Two permutations make every coordinate of a signature: the first scatters the shingle universe over a ring of `RING`
slots, the second is one table over the ring that is shifted circularly by k for coordinate k. For a shingle the whole
signature is therefore one contiguous slice of the table, and a document's signature the minimum over its slices.
Signatures are cut in bands; documents that share a band are compared on their full shingle sets.

No group is expanded into all pairs and none is gathered in one task:

1. equal sets are one node, named by their smallest id;
2. every bucket compares its members with its smallest member, which yields stars of verified links;
3. buckets whose members are still in several components compare the members outside the bucket's main component with all
   its members, in blocks of bounded size spread over tasks, and keep only links that join components.

Pairs inside one component need no further look, so the components equal those of all links between bucket mates. With 28
bands of 4 a pair at similarity 0.75 shares a bucket with probability 1 - 2e-5.

Defined results: words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; with fewer words than
`width` the whole sequence is one shingle; null, empty or blank texts have no shingles and link with nothing. Repeated
rows share a component. A row without an id takes the component of its text, null if no row with that text has an id.
"""
from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import connected_components, written

RING = 1 << 20
BANDS, ROWS = 28, 4
WIDTH, PERCENT = 5, 75
BLOCK = 128                      # members of a bucket in one block of step 3


@hashing.remembered
def table() -> np.ndarray:
    """The second permutation, with its start repeated so that every shift is a slice; a sliding view over it."""
    p = np.random.default_rng(20240229).permutation(RING).astype(np.uint32)
    return sliding_window_view(np.concatenate([p, p[: BANDS * ROWS - 1]]), BANDS * ROWS)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return hashing.shingles(hashing.word_hashes((text or "").encode("utf-8", "surrogatepass").lower()), width)


def signature(shingles: np.ndarray) -> np.ndarray:
    slots = (hashing.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    view, best = table(), None
    for at in range(0, len(slots), 2048):
        low = view[slots[at: at + 2048]].min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = hashing.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        h = hashing.mix(h * np.uint64(hashing.BASE) + rows[:, k])
    return h.view(np.int64)


def _signatures(batches):
    for b in batches:
        out = []
        for text in b["text"]:
            s = shingle_set(text)
            out.append((len(s), set_key(s),
                        band_keys(signature(s)) if len(s) else None))
        n, key, bands = zip(*out) if out else ((), (), ())
        yield pd.DataFrame({"doc_id": b["doc_id"], "row_hash": b["row_hash"], "n_shingles": n, "set_key": key, "bands": bands})


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(batches):
    for b in batches:
        sets = [shingle_set(t) for t in b["text"]]
        yield pd.DataFrame({"node": [set_key(s) for s in sets], "shingles": [s.tobytes() for s in sets]})


def similar(both: int, union: int) -> bool:
    return 100 * both >= PERCENT * union


def _verify(batches):
    for b in batches:
        keep = []
        for x, y in zip(b["x"], b["y"]):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = 0
            if PERCENT * max(len(u), len(v)) <= 100 * min(len(u), len(v)):       # the sizes alone can rule a pair out
                both = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(similar(both, len(u) + len(v) - both))
        yield b.loc[np.array(keep, bool), ["a", "b"]]


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links from the queries of a block to its members that join two components."""
    ask, mem = pdf[pdf["query"]], pdf[~pdf["query"]]
    boss = {c: c for c in pdf["component"]}

    def find(c):
        while boss[c] != c:
            boss[c] = boss[boss[c]]
            c = boss[c]
        return c

    sets = [np.frombuffer(x, np.uint64) for x in mem["shingles"]]
    size = np.array([len(s) for s in sets])
    start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(sets) else np.empty(0, int)
    words, ids = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.empty(0, np.uint64), None)
    mark, out = np.zeros(len(words), np.int64), []
    nodes, comps = mem["node"].to_numpy(), mem["component"].to_numpy()
    for q, c, blob in zip(ask["node"], ask["component"], ask["shingles"]):
        s = np.frombuffer(blob, np.uint64)
        if len(words) == 0 or len(s) == 0:
            continue
        at = np.minimum(np.searchsorted(words, s), len(words) - 1)
        at = at[words[at] == s]
        mark[at] = 1
        both = np.add.reduceat(mark[ids], start)
        mark[at] = 0
        for i in np.flatnonzero(100 * both >= PERCENT * (size + len(s) - both)):
            if nodes[i] != q and find(comps[i]) != find(c):
                boss[find(comps[i])] = find(c)
                out.append((q, nodes[i]))
    return pd.DataFrame(out, columns=["a", "b"])


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, row_hash (of id and text), n_shingles, component_id and texts (the component's own name).

    Nodes are sets of shingles, named by their digest: unlike texts under one id are not one node, and texts without an id
    link like others. component_id is the smallest id of the component, null where none of its rows has one.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("row_hash", F.xxhash64("doc_id", "text"))
    sig = written(d.mapInPandas(_signatures, "doc_id long, row_hash long, n_shingles long, set_key binary, bands array<long>"))
    nodes = written(sig.where("n_shingles > 0").groupBy(F.col("set_key").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    slots = nodes.select("node", F.explode("bands").alias("bucket"))
    full = slots.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    slots = written(slots.join(full, "bucket"))

    pairs = slots.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    # one text of each set that shares a bucket
    least = sig.where("n_shingles > 0").groupBy(F.col("set_key").alias("node")).agg(F.min("row_hash").alias("row_hash"))
    named = least.join(slots.select("node").distinct(), "node", "left_semi").select("row_hash")
    sets = written(d.select("row_hash", "text").join(named, "row_hash", "left_semi").dropDuplicates(["row_hash"]).select("text")
                   .mapInPandas(_sets, "node binary, shingles binary").dropDuplicates(["node"]))
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    links = written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(_verify, "a binary, b binary"))
    found = connected_components(links)

    # buckets whose members are not yet together
    told = slots.where("n > 2").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = told.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    split = (split.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("n"),
                                         F.max("k").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1"))
    told = told.join(split, "bucket")
    ceil = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    told = told.withColumns({"rows": ceil(F.col("n")), "cols": ceil(F.col("n") - F.col("most")), "h": F.xxhash64("node")})
    asks = told.where("component <> main").select("bucket", "node", "component", F.lit(True).alias("query"), F.pmod("h", "cols").alias("col"),
                                                  F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    mems = told.select("bucket", "node", "component", F.lit(False).alias("query"), F.pmod("h", "rows").alias("row"),
                       F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    cols = ["bucket", "row", "col", "query", "node", "component"]
    blocks = asks.select(cols).union(mems.select(cols)).join(sets, "node")
    more = written(blocks.groupBy("bucket", "row", "col").applyInPandas(_block, "a binary, b binary"))
    if not more.isEmpty():
        found = connected_components(links.union(more))

    by_set = written(nodes.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("texts")))
    ids = by_set.groupBy("texts").agg(F.min("doc_id").alias("component_id"))
    by_set = by_set.join(ids, "texts").select(F.col("node").alias("set_key"), "texts", "component_id")
    out = sig.select("doc_id", "row_hash", "n_shingles", "set_key")
    linked = out.where("n_shingles > 0").join(by_set, "set_key").select("doc_id", "row_hash", "n_shingles", "component_id", "texts")
    return linked.union(out.where("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("texts")))


def query(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """One row of each group of texts stays, with all its columns: the row with the smallest id (rows without an id come
    last), and of rows with this id the one with the smallest hash. Unlike texts under one id are groups of their own. Rows
    without a shingle stay."""
    c = components(docs)
    rows = c.groupBy("doc_id", "row_hash", "texts").agg(F.count(F.lit(1)).alias("ties"))
    alone = rows.where("texts is null").select("doc_id", "row_hash", F.lit(1).cast("long").alias("ties"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "ties")).alias("m")
    least = rows.where("texts is not null").groupBy("texts").agg(first).select("m.doc_id", "m.row_hash", "m.ties")
    keep = written(alone.union(least))
    mine, tag, same = (f"_{uuid.uuid4().hex}" for _ in range(3))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    k = keep.select(F.col("row_hash").alias(mine), F.col("doc_id").alias(same), F.col("ties").alias(tag))
    d = docs.withColumn(mine, key)
    kept = d.join(k, (d[mine] == k[mine]) & d["doc_id"].cast("long").eqNullSafe(k[same])).drop(k[mine])
    once, tied = kept.where(F.col(tag) == 1), kept.where(F.col(tag) > 1).dropDuplicates([mine])
    return once.union(tied).select(*[F.col(f"`{n}`") for n in docs.columns])
