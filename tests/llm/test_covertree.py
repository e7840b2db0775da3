import collections

import numpy as np
import pytest

from tickloom.llm import covertree


def brute(rows):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, boss = collections.Counter(), {i: i for i in ok}

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for a in ok:
        for b in ok:
            x, y = (np.array(rows[i][1], np.float32).astype(float) for i in (a, b))
            if a < b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                links[a] += 1
                links[b] += 1
                boss[find(b)] = find(a)
    least = {}
    for i in ok:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return collections.Counter((r[0], links[i], least[find(i)] if i in boss else r[0]) for i, r in enumerate(rows))


def vectors(rng, n, dim=12):
    hubs = rng.normal(size=(6, dim))
    out = [(h if rng.random() < .4 else rng.normal(size=dim) * 3) + rng.normal(size=dim) * s for h, s in zip(hubs[rng.integers(0, 6, n)], rng.choice([.02, .2, .4], n))]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(covertree, "CELL", 20)
        monkeypatch.setattr(covertree, "BLOCK", 15)
    rows = vectors(np.random.default_rng(7), 230)
    v = rows[3][1]
    rows += [(300, v), (301, v), (302, [2 * x for x in v]), (303, None), (304, []), (305, [0.0] * 12), (306, [float("nan")] * 12), (307, [None] + [1.0] * 11), (308, [1.0, 2.0]),
             (309, [2.0, 4.0]), (3, v), (None, v), (310, [1e-30] * 12), (311, [1.0] * 12)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<float>, label int, component_id string")
    got = covertree.query(df).collect()
    want = brute(rows)
    # equal ids are one node of a component
    assert collections.Counter((r.vec_id, r.n_links) for r in got) == collections.Counter((k[0], k[1]) for k in want.elements())
    assert collections.Counter((r.vec_id, r.component_id) for r in got if r.vec_id is not None) == collections.Counter((k[0], k[2]) for k in want.elements() if k[0] is not None)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_tight_group_is_taken_whole():
    rng = np.random.default_rng(8)
    x = np.ones((400, 8)) + rng.normal(size=(400, 8)) * 1e-3
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = covertree.grow(x)
    n, calls = np.zeros(400, int), [0]

    def count(a, b, hit, own):
        calls[0] += 1
        n[a] += len(b) - own if hit is None else hit.sum(1)
        if not own:
            n[b] += len(a) if hit is None else hit.sum(0)

    covertree.dual(x, tree, x, tree, np.sqrt(0.2), 0.9, count, lambda *a: None)
    assert (n == 399).all() and calls[0] == 1


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("dense", [1, 1 << 12, 1 << 40])
def test_traversal_against_all_pairs(dense, monkeypatch):
    """Spread points, one loose and one tight group, points on a line, and single points; both ways of opening a pair."""
    monkeypatch.setattr(covertree, "DENSE", dense)
    rng = np.random.default_rng(9)
    hub = rng.normal(size=64)
    spread, loose, tight = rng.normal(size=(300, 64)), hub + rng.normal(size=(150, 64)) * .3, hub + rng.normal(size=(150, 64)) * .02
    line = np.c_[np.cos(np.linspace(0, 3, 200)), np.sin(np.linspace(0, 3, 200)), np.zeros((200, 62))]
    left, right = unit(np.r_[spread, loose, tight, line]), unit(np.r_[loose[:70] + 1e-3, spread[:50] + .1, line[::3], tight[:9], -spread[:20]])
    for x, y in ((left, left), (left, right), (right, left[:1]), (left[:1], left[:1])):
        a = covertree.grow(x)
        b = a if x is y else covertree.grow(y)
        n, m = np.zeros(len(x), int), np.zeros(len(y), int)

        def count(p, q, hit, own):
            n[p] += len(q) - own if hit is None else hit.sum(1)
            if not own:
                (n if x is y else m)[q] += len(p) if hit is None else hit.sum(0)

        covertree.dual(x, a, y, b, np.sqrt(0.2), 0.9, count, lambda *_: None)
        hit = x @ y.T >= 0.9
        if x is y:
            np.fill_diagonal(hit, False)
            assert (n == hit.sum(1)).all()
        else:
            assert (n == hit.sum(1)).all() and (m == hit.sum(0)).all()


def test_tree_covers_its_points():
    rng = np.random.default_rng(10)
    x = unit(np.r_[rng.normal(size=(200, 3)), np.ones((20, 3)) + rng.normal(size=(20, 3)) * 1e-9])
    t = covertree.grow(x)
    assert sorted(t.order) == list(range(220))
    for k in range(len(t.centre)):
        p = t.points(k)
        assert t.centre[k] in p and covertree.distance(x[p], x[[t.centre[k]]]).max() <= t.radius[k] + 1e-7
        if t.size[k] > 1:
            kids = range(t.first[k], t.first[k] + t.kids[k])
            assert sorted(q for c in kids for q in t.points(c)) == sorted(p) and t.kids[k] > 1
        else:
            assert t.first[k] == k and t.kids[k] == 1


def test_empty(spark):
    assert covertree.query(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
