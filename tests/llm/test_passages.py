import collections
import re

import numpy as np

from tickloom.llm import suffixes
from tickloom.llm.queries import QUERIES


def test_passages_of_fifty_words_under_400_bytes_are_caught(spark, docs, rows, tmp_path):
    rng = np.random.default_rng(5)
    make = lambda n: ["".join(rng.choice(list("abcde"), 4)) for _ in range(n)]
    p, q, own = make(55), make(49), make(60)
    more = [(900, " ".join(make(37) + p + make(20))), (901, " ".join(make(5)) + "\n" + "\n ".join(p).upper()), (902, " ".join(make(70) + q)), (903, " ".join(q + make(71))),
            (904, " ".join(own + make(3) + own)), (905, " ".join(make(300))), (906, "a " * 80), (907, "a " * 80), (908, "a " * 49), (909, "a " * 49)]
    table = [(r[0], r[1]) for r in rows] + more
    spark.createDataFrame(table, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    words = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in table]
    held = collections.defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - 49):
            held[tuple(w[i:i + 50])].add(k)
    want = collections.Counter()
    for k, ((i, _), w) in enumerate(zip(table, words)):
        hit = {j for s in range(len(w) - 49) if len(held[tuple(w[s:s + 50])]) > 1 for j in range(s, s + 50)}
        want[(i, len(hit))] += 1
    got = QUERIES["op1_repeated_strings"](spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_passage_words) for r in got) == want
    caught = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 900}
    assert [caught[i].n_passage_words for i in range(900, 910)] == [55, 55, 0, 0, 0, 0, 80, 80, 0, 0]
    assert all(caught[i].n_removed == 0 for i in (900, 901))
    plain = [tuple(r) for r in suffixes.query(spark.createDataFrame(table, "doc_id long, text string")).collect()]
    assert collections.Counter(plain) == collections.Counter(tuple(r)[:5] for r in got)


def test_cover_of_words_is_a_perfect_difference_set():
    d = suffixes.cover(suffixes.WORD_ORDER)
    assert collections.Counter(int((a - b) % 31) for a in d for b in d if a != b) == collections.Counter(range(1, 31))
