"""Folds by label times and walk-forward meta labels against loops over labels."""
import math

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import label_folds as LF
from tickloom.series import SeriesSpec

SPEC = SeriesSpec(("k",), ("t0", "id"), "t0 div 1000")


def labels(seed, sizes):
    rng = np.random.default_rng(seed)
    out = []
    for key, n in sizes.items():
        t0 = np.sort(rng.integers(0, 3 * n + 2, n))
        out.append(pd.DataFrame({"k": key, "id": np.arange(n), "t0": t0, "t1": t0 + rng.integers(0, 12, n) + (rng.random(n) < 0.02) * 200}))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("k, embargo", [(5, 0.01), (3, 0.1), (4, 0.0)])
def test_purged_folds(spark, k, embargo):
    d = labels(k, {"hot": 400, "b": 37, "tiny": 6})
    got = LF.purged_kfold(spark.createDataFrame(d), SPEC, "t0", "t1", k, embargo).toPandas()
    assert len(got) == len(d)
    for key, g in d.groupby("k"):
        g = g.sort_values(["t0", "id"]).reset_index(drop=True)
        n, wait = len(g), math.ceil(embargo * len(g))
        want = {i: set() for i in g.id}
        fold = {}
        for f, test in enumerate(np.array_split(np.arange(n), k)):
            a, b = g.t0[test[0]], max(g.t1[test].max(), g.t0[min(test[-1] + wait, n - 1)])
            for i in range(n):
                if i in test:
                    fold[g.id[i]] = f
                elif not (g.t1[i] < a or g.t0[i] > b):
                    want[g.id[i]].add(f)
        mine = got[got.k == key].set_index("id")
        assert {i: set(p) for i, p in mine.purged.items()} == want and dict(mine.fold) == fold


def test_walk_forward_meta(spark):
    rng = np.random.default_rng(3)
    d = labels(9, {"hot": 420, "b": 40, "one": 1})
    d["x1"], d["x2"], d["w"] = rng.normal(0, 1, len(d)), rng.normal(2, 0.5, len(d)), rng.uniform(0.2, 1, len(d))
    d["ret"] = 0.4 * d.x1 + rng.normal(0, 1, len(d))
    d["y"] = (d.ret > 0).astype(int)
    out = LF.walk_forward_meta(spark.createDataFrame(d), SPEC, "t0", "t1", ["x1", "x2"], w="w", retrain_every=30)
    got = out.toPandas()
    seen = 0
    for key, g in d.groupby("k"):
        g = g.sort_values(["t0", "id"]).reset_index(drop=True)
        first = int(len(g) / 3)
        mine = got[got.k == key].sort_values("pos").reset_index(drop=True)
        assert mine.pos.tolist() == list(range(first, len(g)))
        for s in range(first, len(g), 30):
            known, block = g[g.t1 < g.t0[s]], g.iloc[s:s + 30]
            part = mine[(mine.pos >= s) & (mine.pos < s + 30)]
            assert (part.known == len(known)).all() and (part.t0.to_numpy() == block.t0.to_numpy()).all()
            assert known.t1.max() < block.t0.min() or not len(known)                   # a label is used only after it resolved
            if known.y.nunique() < 2:
                continue
            X, y, w = known[["x1", "x2"]].to_numpy(), known.y.to_numpy(), known.w.to_numpy()
            m = [np.average(X[y == c], axis=0, weights=w[y == c]) for c in (0, 1)]
            r = X - np.where(y[:, None] == 1, m[1], m[0])
            b = np.linalg.solve((w[:, None] * r).T @ r / w.sum(), m[1] - m[0])
            z = math.log(w[y == 1].sum() / w[y == 0].sum()) - (m[0] + m[1]) @ b / 2 + block[["x1", "x2"]].to_numpy() @ b
            assert np.allclose(part.prob.astype(float), 1 / (1 + np.exp(-z)), atol=1e-9)
            seen += len(block)
    assert seen > 250
    s = LF.meta_summary(out, ["k"], 2.0).toPandas().set_index(["k", "arm"])
    hot = got[got.k == "hot"]
    assert s.trades["hot", "primary"] == len(hot) and s.trades["hot", "meta"] == (hot["size"] > 0).sum()
    assert abs(s.total["hot", "meta"] - hot.meta.sum()) < 1e-9 and abs(s.sharpe["hot", "primary"] - hot.primary.mean() / hot.primary.std() * math.sqrt(len(hot) / 2)) < 1e-9
    assert s.precision["hot", "meta"] > s.precision["hot", "primary"]


def test_one_class_and_nothing_known():
    coef, bias = LF.discriminant(np.array([[0, 0, 0, 0, 0], [2, 0, 1, 0, 1], [0, 3, 0, 1, 1]], float), 1)
    assert math.isnan(bias[0]) and bias[1] == -math.inf and bias[2] == math.inf and (coef == 0).all()
