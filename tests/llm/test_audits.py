"""Filter order audit and source divergence against brute force."""
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from conftest import collected
from pyspark.sql import functions as F

from tickloom.llm import divergence, filter_audit

GAP = re.compile(r"[\x20\x09-\x0D]+")
LABELS = [(i, int(i % 4 != 0), int(i % 7 == 0)) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, 1)]


def orders_by_hand(docs, labels):
    rows = [(d[0], d[1] or "", d[3] or "") for d in docs]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t] = min(i, firsts.get(t, i))
    fails = []
    for i, t, part in rows:
        w = [x for x in GAP.split(t) if x]
        fails.append((part, i, {c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > firsts[t])) if bad}))
    out, removed_by = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in fails}:
            left = [(i, f) for p, i, f in fails if p == part]
            gone = []
            for s, c in enumerate(order):
                hit = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                out[part, order, s + 1] = [len(left), len(hit), sum(c in f for _, f in gone), sum(f == {c} for p, _, f in fails if p == part),
                                           sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit)]
                removed_by[part, c] += len(hit)
                gone += hit
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_orders_against_brute_force(spark, rows, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("part", F.lit("x"))
    got = collected(filter_audit.query(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    assert len(got) == len(set(got)) and set(got) == orders_by_hand(rows, LABELS)


def test_intervals_cover_each_order_once():
    assert [filter_audit.rank(o) for o in filter_audit.ORDERS] == list(range(120))
    for mask in range(1, 32):
        assert sorted(r for _, lo, hi in filter_audit.intervals(mask) for r in range(lo, hi)) == list(range(120))


def test_filter_orders_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.query(empty, none).count() == 0
    assert filter_audit.query(docs, none).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def divergence_by_hand(docs, least, shown=50):
    terms = [(d[2] or "", d[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d[1] or ""))) for d in docs]
    out = []
    for lang in {x[0] for x in terms}:
        df = Counter(t for la, _, w in terms if la == lang for t in set(w))
        vocab = sorted(t for t, n in df.items() if n >= least)
        n = defaultdict(Counter)
        for la, source, w in terms:
            if la == lang:
                n[source].update(t for t in w if t in set(vocab))
                n[None].update(t for t in w if t in set(vocab))
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(vocab)) for t in vocab} for s, c in n.items()}
        sources = [s for s in n if s is not None]
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in vocab)) for o in sources if o != s]
            term = [(t, p[s][t] - p[None][t]) for t in vocab if n[s][t] > 0 and p[s][t] > p[None][t]]
            for part, found, top in (("pair", pair, None), ("term", term, shown)):
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top])]
    return out


@pytest.mark.parametrize("least, groups, terms, piece", [(2, 2, 5, 100), (3, 32, 2048, 1 << 24), (10**6, 2, 5, 1000)])
def test_divergence_against_brute_force(spark, rows, docs, monkeypatch, least, groups, terms, piece):
    for k, v in (("LEAST_DOCS", least), ("GROUPS", groups), ("TERMS", terms)):
        monkeypatch.setattr(divergence, k, v)
    more = [(200 + i, "the ring " * (i + 1) + f"only{chr(97 + i % 3)} Ünï ümlaut", "en", f"s{i}", 0, "x", "y", "z") for i in range(9)] + [(300, "x", "zz", "alone", 0, "x", "y", "z")]
    d = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = collected(divergence.query(d.withColumn("term", F.lit("clash")).withColumn("n", F.lit(1))))
    assert sorted(got) == sorted(divergence_by_hand([*rows, *more], least))


def test_texts_are_cut_in_pieces_of_words():
    assert list(divergence.pieces([5, 5, 1 << 25, 3])) == [(0, 2), (2, 3), (3, 4)]
    terms, home = divergence.terms_of(["Ab1cD", "", "é\x00É\x7fz"])
    assert terms.to_pylist() == ["ab", "cd", "é", "É", "z"] and home.tolist() == [0, 0, 2, 2, 2]


def test_divergence_of_an_empty_table(empty):
    assert divergence.query(empty).count() == 0
