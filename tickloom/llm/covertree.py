"""All pairs of vectors with cosine of at least a threshold, by dual traversal of cover trees.

Unit vectors at cosine c lie sqrt(2 - 2c) apart, so the threshold is a distance. Equal vectors are one weighted point.
Points go to the cell of their nearest top-level centre and cells are cut in blocks of bounded size; each block gets a
cover tree with halving radii and true covering radii. Two blocks meet in one task unless the balls of their cells are too
far apart; there both trees are walked together. A pair of nodes is dropped when the distance of its centres exceeds the
threshold plus both covering radii, taken as a whole when even its farthest points are close enough, and opened otherwise;
single points are compared in double precision. What leaves a task are a link count for each point and links that join its
local components, never the pairs themselves: a group of m copies costs m rows.

Vectors spread evenly over many dimensions are all far from any centre, so few block pairs can be dropped by any metric tree;
then the work is that of a blocked matrix product, quadratic in the number of points but without a pair written out.

Defined results: a vector that is null, zero, or has null or non-finite parts links with nothing and is its own component;
vectors of different lengths never link; rows without an id neither link nor get a component; repeated rows are separate
vectors that link with each other.
"""
from __future__ import annotations

import hashlib
import math
import pickle
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

COSINE = 0.9
CENTRES, CELL, BLOCK = 512, 4096, 2048        # most top-level centres, points wished for in a cell, points in a block
DENSE = 1 << 12                               # pairs of children from which two nodes are opened as one matrix product
SLACK = 1e-3                                  # kept between a bound and the threshold: more than bounds in single precision err


class Tree(NamedTuple):
    """A cover tree as arrays. Node 0 is the root, the children of a node follow each other, every leaf is one point."""
    centre: np.ndarray
    radius: np.ndarray       # true covering radius
    first: np.ndarray        # first child, or the node itself where it is a leaf
    kids: np.ndarray         # children, or 1 where it is a leaf
    start: np.ndarray        # a node's points are order[start: start + size]
    size: np.ndarray
    order: np.ndarray

    def points(self, node: int) -> np.ndarray:
        return self.order[self.start[node]: self.start[node] + self.size[node]]


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def grow(x: np.ndarray) -> Tree:
    """Cover tree of the rows of x: centres of a level are more than its reach apart and cover everything within it; the
    reach halves from level to level. Groups of up to 8 points, and those closer than rounding, split into points at once."""
    n = len(x)
    order = np.arange(n)
    centre, radius, first, kids, start, size = [0], [0.0], [0], [1], [0], [n]
    reach, at = [2.0], 0
    while at < len(centre):
        if size[at] > 1:
            lo, own = start[at], order[start[at]: start[at] + size[at]].copy()
            radius[at] = float(distance(x[own], x[[centre[at]]]).max())
            if len(own) <= 8 or radius[at] < 1e-6:
                groups, level = [[p] for p in own], 0.0
            else:
                level = reach[at]
                while radius[at] <= level:
                    level /= 2
                near = distance(x[own], x[own]) <= level
                np.fill_diagonal(near, True)
                left, groups = np.ones(len(own), bool), []
                for i in range(len(own)):
                    if left[i]:
                        part = near[i] & left
                        left &= ~part
                        groups.append([own[i], *own[part & (own != own[i])]])
            first[at], kids[at] = len(centre), len(groups)
            for g in groups:
                order[lo: lo + len(g)] = g
                centre.append(int(g[0]))
                radius.append(0.0)
                first.append(len(first))
                kids.append(1)
                start.append(lo)
                size.append(len(g))
                reach.append(level / 2)
                lo += len(g)
        at += 1
    whole = (np.array(v, np.int64) for v in (first, kids, start, size))
    return Tree(np.array(centre, np.int64), np.array(radius), *whole, order)


def dual(x: np.ndarray, a: Tree, y: np.ndarray, b: Tree, far: float, cosine: float, count, join) -> None:
    """Walk two trees; count(ia, ib, mask or None, own) and join(ia, ib, mask or None) get the points that link.  For x
    against itself pass the same tree: each unordered pair of nodes is then met once.

    The pairs of nodes still open are held as arrays. Both nodes of a pair are opened into their children; a pair of children
    is dropped when its balls are too far apart, taken whole when even its farthest points link, decided in double precision
    when both are single points, and kept open otherwise."""
    xs, ys = x.astype(np.float32), y.astype(np.float32)          # bounds need no more, with their slack
    ra, rb = a.radius.astype(np.float32), b.radius.astype(np.float32)
    own, step = a is b, max(1 << 8, (1 << 22) // x.shape[1])
    linked, stack = np.zeros((len(x), len(y)), bool), []

    def decide(i, j):
        """Pairs of single points, as one product where they fill much of a matrix."""
        r, c = np.unique(i), np.unique(j)
        if 8 * len(i) > len(r) * len(c):
            asked = np.zeros((len(r), len(c)), bool)
            asked[np.searchsorted(r, i), np.searchsorted(c, j)] = True
            linked[np.ix_(r, c)] |= asked & (x[r] @ y[c].T >= cosine)
            return
        for k in range(0, len(i), step):
            p, q = i[k: k + step], j[k: k + step]
            linked[p, q] |= np.einsum("ij,ij->i", x[p], y[q]) >= cosine

    def settle(i, j, g):
        bound = ra[i] + rb[j]
        near = (far + SLACK + bound) ** 2 + 2 * g >= 2
        i, j, g, bound = i[near], j[near], g[near], bound[near]
        same = (i == j) if own else np.zeros(len(i), bool)
        alone = (a.size[i] == 1) & (b.size[j] == 1)
        one = alone & ~same
        if one.any():
            decide(a.centre[i[one]], b.centre[j[one]])
        whole = ~alone & (np.sqrt(np.maximum(2 - 2 * g, 0)) + bound < far - SLACK)
        for k in np.flatnonzero(whole):
            p, q = a.points(i[k]), b.points(j[k])
            count(p, q, None, bool(same[k]))
            join(p, q, None)
        rest = ~alone & ~whole
        i, j = i[rest], j[rest]
        wide = a.kids[i] * b.kids[j]
        for k in np.flatnonzero(wide >= DENSE):
            stack.append((i[[k]], j[[k]]))
        i, j, wide = i[wide < DENSE], j[wide < DENSE], wide[wide < DENSE]
        if len(i):
            cuts = np.flatnonzero(np.diff(np.cumsum(wide) // step)) + 1
            stack.extend(zip(np.split(i, cuts), np.split(j, cuts)))

    root = np.zeros(1, np.int64)
    settle(root, root, np.einsum("ij,ij->i", xs[a.centre[root]], ys[b.centre[root]]))
    while stack:
        u, v = stack.pop()
        ku, kv = a.kids[u], b.kids[v]
        if len(u) == 1 and ku[0] * kv[0] >= DENSE:
            ci, cj = a.first[u[0]] + np.arange(ku[0]), b.first[v[0]] + np.arange(kv[0])
            g = xs[a.centre[ci]] @ ys[b.centre[cj]].T
            room = np.add.outer(ra[ci] + np.float32(far + SLACK), rb[cj])
            room *= room
            room += 2 * g
            near = room >= 2
            i, j = np.nonzero(np.triu(near) if own and u[0] == v[0] else near)
            settle(ci[i], cj[j], g[i, j])
            continue
        k = ku * kv
        at = np.repeat(np.arange(len(u)), k)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
        i, j = a.first[u[at]] + nth // kv[at], b.first[v[at]] + nth % kv[at]
        if own:
            once = (u[at] != v[at]) | (i <= j)
            i, j = i[once], j[once]
        settle(i, j, np.einsum("ij,ij->i", xs[a.centre[i]], ys[b.centre[j]]))
    r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if len(r):
        hit = linked[np.ix_(r, c)]
        count(r, c, hit, False)
        join(r, c, hit)


def spanning(hit: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that join what the links of a matrix join: the smallest row spreads through each component, and
    every column and row keeps one link to where its label came from."""
    n, none = len(hit), len(hit)
    rows, out = np.arange(n), []
    while True:
        cols = np.where(hit, rows[:, None], none).min(axis=0)
        at = np.where(hit, rows[:, None], none).argmin(axis=0)
        linked = cols < none
        out += list(zip(at[linked].tolist(), np.flatnonzero(linked).tolist()))
        seen = np.where(hit, cols[None, :], none)
        new = np.minimum(rows, seen.min(axis=1))
        out += [(i, int(seen[i].argmin())) for i in np.flatnonzero(hit.any(axis=1))]
        if (new == rows).all():
            return out
        rows = new


def _unit(raw: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _read(batches):
    """Id, digest of the vector and its bytes; no digest where it cannot link."""
    for b in batches:
        out = []
        for v in b["embedding"]:
            x = None if v is None or not len(v) else np.array([np.nan if k is None else k for k in v] if v.dtype == object else v, np.float32)
            good = x is not None and np.isfinite(x).all() and np.any(x)
            out.append((hashlib.md5(x.tobytes()).digest(), x.tobytes(), len(x)) if good else (None, None, 0))
        k, raw, dim = zip(*out) if out else ((), (), ())
        yield pd.DataFrame({"vec_id": b["vec_id"], "digest": k, "raw": raw, "dim": dim}).astype({"vec_id": "Int64"})


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    far = math.sqrt(2.0 - 2.0 * cosine)
    read = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
                   .mapInPandas(_read, "vec_id long, digest binary, raw binary, dim int"))
    nodes = written(read.where("digest is not null and vec_id is not null").groupBy("digest", "dim", "raw")
                    .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")))
    n = nodes.count()
    dims = [r[0] for r in nodes.select("dim").distinct().limit(1000).collect()]
    # top-level centres: a bounded number, drawn by a hash of the id
    wish = max(1, min(CENTRES, n // CELL))
    drawn = (nodes.withColumn("h", F.pmod(F.xxhash64("node"), F.lit(1 << 40))).orderBy("h", "node").limit(wish).select("dim", "raw").collect()) if n else []
    centres = {d: np.concatenate([_unit(r["raw"], d) for r in drawn if r["dim"] == d]) if any(r["dim"] == d for r in drawn) else None for d in dims}

    def cells(batches):
        for b in batches:
            cell, gap = np.zeros(len(b), np.int64), np.full(len(b), 2.0)
            for d in b["dim"].unique():
                at, c = np.flatnonzero(b["dim"].to_numpy() == d), centres.get(d)
                if c is not None:
                    g = distance(_unit(b"".join(b["raw"].iloc[at]), d), c)
                    cell[at], gap[at] = g.argmin(1), g.min(1)
            yield b.assign(cell=cell, gap=gap)

    placed = written(nodes.select("node", "weight", "dim", "raw").mapInPandas(cells, "node long, weight long, dim int, raw binary, cell long, gap double"))
    size = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("k"), F.max("gap").alias("radius"))
    sizes = size.collect()                    # at most one row for each centre and dimension
    pairs = []
    for s in sizes:
        for t in sizes:
            if s["dim"] == t["dim"] and s["cell"] <= t["cell"]:
                c = centres[s["dim"]]
                gap = 0.0 if c is None or s["cell"] == t["cell"] else float(distance(c[[s["cell"]]], c[[t["cell"]]])[0, 0])
                if gap <= far + s["radius"] + t["radius"] + SLACK:
                    pairs.append((s["dim"], s["cell"], t["cell"]))
    spark = vectors.sparkSession
    blocks = (placed.join(size.select("dim", "cell", F.ceil(F.col("k") / BLOCK).alias("cuts")), ["dim", "cell"])
              .withColumn("cut", F.pmod(F.xxhash64("node"), "cuts")).select("dim", "cell", "cut", "node", "weight", "raw"))
    packed = written(blocks.groupBy("dim", "cell", "cut").applyInPandas(_pack, "dim int, cell long, cut long, nodes binary, weights binary, raw binary, tree binary"))
    p, q = (packed.select("dim", F.col("cell").alias(k + "cell"), F.col("cut").alias(k + "cut"), F.struct("nodes", "weights", "raw", "tree").alias(k)) for k in "ab")
    met = spark.createDataFrame(pairs, "dim int, acell long, bcell long") if pairs else spark.createDataFrame([], "dim int, acell long, bcell long")
    met = met.join(p.select("dim", "acell", "acut"), ["dim", "acell"]).join(q.select("dim", "bcell", "bcut"), ["dim", "bcell"])
    met = met.where("acell < bcell or acut <= bcut").repartition("acell", "acut", "bcell", "bcut")
    both = met.join(p, ["dim", "acell", "acut"]).join(q, ["dim", "bcell", "bcut"]).select(
        "dim", (F.expr("acell = bcell and acut = bcut")).alias("same"), "a.nodes", "a.weights", "a.raw", "a.tree", F.col("b.tree").alias("tree2"),
        F.col("b.nodes").alias("nodes2"), F.col("b.weights").alias("weights2"), F.col("b.raw").alias("raw2"))

    def meet(batches):
        for b in batches:
            for r in b.itertuples():
                yield _meet(r, far, cosine)

    out = written(both.mapInPandas(meet, "a long, b long, n long"))
    counts = out.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    found = connected_components(out.where("b is not null").select("a", "b"))
    told = (nodes.join(counts, "node", "left").join(found, "node", "left")
            .select("digest", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    live = read.where("digest is not null and vec_id is not null").select("vec_id", "digest").join(told, "digest").select("vec_id", "n_links", "component_id")
    rest = read.where("digest is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return live.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block as one row, with its cover tree."""
    pdf = pdf.sort_values("node")
    x = _unit(b"".join(pdf["raw"]), int(pdf["dim"].iloc[0]))
    return pd.DataFrame({"tree": [pickle.dumps(tuple(grow(x)))], "dim": [pdf["dim"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "cut": [pdf["cut"].iloc[0]],
                         "nodes": [pdf["node"].to_numpy(np.int64).tobytes()], "weights": [pdf["weight"].to_numpy(np.int64).tobytes()], "raw": [b"".join(pdf["raw"])]})


def _meet(r, far: float, cosine: float) -> pd.DataFrame:
    x = _unit(r.raw, r.dim)
    ids, w = np.frombuffer(r.nodes, np.int64), np.frombuffer(r.weights, np.int64)
    tree = Tree(*pickle.loads(r.tree))
    if r.same:
        y, ids2, w2, tree2, shift = x, ids, w, tree, 0
    else:
        y, ids2, w2 = _unit(r.raw2, r.dim), np.frombuffer(r.nodes2, np.int64), np.frombuffer(r.weights2, np.int64)
        tree2, shift = Tree(*pickle.loads(r.tree2)), len(x)
    n, n2 = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    boss = np.arange(len(x) + (0 if r.same else len(y)))

    def find(i):
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    def count(pa, pb, hit, own):
        n[pa] += (w2[pb].sum() - (w[pa] if own else 0)) if hit is None else hit @ w2[pb]
        if not own:                      # a node against itself holds both directions already
            (n if r.same else n2)[pb] += w[pa].sum() if hit is None else w[pa] @ hit

    def join(pa, pb, hit):
        if hit is None or (hit | (pa[:, None] == pb[None, :]) if r.same else hit).all():
            ties = [(i, pb[0]) for i in pa] + [(pa[0], j) for j in pb[1:]]
        else:
            ties = [(pa[i], pb[j]) for i, j in spanning(hit)]
        for i, j in ties:
            s, t = find(i), find(j + shift)
            if s != t:
                boss[max(s, t)] = min(s, t)

    dual(x, tree, y, tree2, far, cosine, count, join)
    names = ids if r.same else np.concatenate([ids, ids2])
    root = np.array([find(i) for i in range(len(boss))], np.int64) if len(boss) else boss
    tied = np.flatnonzero(root != np.arange(len(boss)))
    total = n if r.same else np.concatenate([n, n2])
    some = np.flatnonzero(total)
    return pd.DataFrame({"a": np.concatenate([names[tied], names[some]]), "b": pd.array([*names[root[tied]], *[None] * len(some)], "Int64"),
                         "n": np.concatenate([np.zeros(len(tied), np.int64), total[some]])})


def query(vectors: DataFrame) -> DataFrame:
    return links(vectors).select("vec_id", "n_links", "component_id", "kept")
