import math
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import text as X


def okapi(queries, docs, k):
    """Best k of every query by the definition: rows are (scope, id, time, text)."""
    words = lambda s: [w for w in re.findall("[a-z0-9]+", (s or "").lower()) if w not in X.STOPWORDS]
    best = {}
    for scope, name, asked, text in queries:
        seen = [(i, words(s)) for sc, i, filed, s in docs if sc == scope and filed <= asked]
        mean = sum(len(w) for _, w in seen) / max(len(seen), 1)
        held = Counter(w for _, ws in seen for w in set(ws))
        scores = []
        for i, ws in seen:
            tf = Counter(ws)
            s = [qf * math.log((len(seen) - held[w] + .5) / (held[w] + .5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (.25 + .75 * len(ws) / mean)) for w, qf in Counter(words(text)).items() if tf[w]]
            if s:
                scores.append((-round(sum(s), 9), i))
        best[name] = [(i, -s) for s, i in sorted(scores)[:k]]
    return best


@pytest.mark.parametrize("timed", [False, True])
def test_bm25_over_blocks(spark, timed):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(25)] + ["the", "not"]
    day = lambda i: datetime(2024, 1, 1) + timedelta(days=int(i))
    text = lambda n: ", ".join(rng.choice(vocab, n))
    last = 0 if timed else 99
    docs = [("ab"[i % 2], i, day(rng.integers(0, 20)), text(rng.integers(1, 30))) for i in range(60)] + [("a", 100, day(3), None), ("a", 101, day(3), "")]
    docs += [(s, i + 200, d, x) for s, i, d, x in docs[:6]]                                # copies tie by id
    queries = [("ab"[i % 2], i, day(rng.integers(4, 20) + last), text(6)) for i in range(12)]
    q = spark.createDataFrame(queries, "scope string, q long, asked timestamp, text string")
    d = spark.createDataFrame(docs, "scope string, id long, filed timestamp, body string")
    got = X.bm25_top_k(q, "q", "text", d, "id", "body", ["scope"], 4, ("asked", "filed") if timed else None, block=7)
    rows = {}
    for r in got.orderBy("q", "rank").collect():
        rows.setdefault(r.q, []).append((r.id, round(r.score, 6)))
    want = okapi(queries, docs, 4)
    assert rows == {n: [(i, round(s, 6)) for i, s in v] for n, v in want.items() if v}


def test_latent_vectors_of_equal_and_few_texts(spark):
    """Directions are those of the covariance; texts without any spread have none and raise nothing."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 12, p=[.4, .3, .1, .1, .1]))) for i in range(80)] + [(80, None), (81, "")]
    d = spark.createDataFrame(rows, "id long, text string")
    got = np.array([r.v for r in X.lsa_vectors(d, "id", "text", 3, 32).orderBy("id").collect()])
    words = sorted({w for _, s in rows if s for w in s.split()})
    c = np.array([[(s or "").split().count(w) for w in words] for _, s in rows], float)
    x = c * np.log((len(c) + 1) / ((c > 0).sum(0) + 1))
    v = x @ np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :3]
    n = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    assert np.allclose(got @ got.T, v @ v.T, atol=1e-9)
    same = spark.createDataFrame([(i, "one two") for i in range(5)], "id long, text string")
    assert X.lsa_vectors(same, "id", "text", 3, 32).where(F.size("v") == 3).count() == 5
    assert X.lsa_vectors(same.limit(0), "id", "text", 3, 32).count() == 0


def test_dense_ties_and_nan_in_blocks(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(30, [float("nan"), 0.0])]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    q = d.where("id < 3").select(F.col("id").alias("q"), F.col("v").alias("u"))
    got = X.dense_top_k(q, "q", "u", d, "id", "v", [], 4, block=8).where("q = 1").orderBy("rank").collect()
    assert [r.id for r in got] == [2, 5, 8, 11]
