"""Retrieval over large document tables: what is exchanged and what the heap holds."""
import re

import pandas as pd

from tickloom.operators import text as X
from tickloom.plans import desk_queries as D
from tickloom.plans.base import Tables


def shown(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_relevant_exchanges_pairs_and_no_runs_of_documents(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    item = ["  ".join(words[10:22]), "Short one", "z " * 12]
    docs = [" ".join(words), " ".join(words[:17]), "a\n" + "\t".join(words[14:30]).upper(), "short ONE ", "short one more", " ".join(words[15:21]), None, "z " * 7, "z " * 30]
    pd.DataFrame({"item_id": range(3), "text": item}).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame({"doc_id": range(9), "text": docs, "lang": "en", "source": "s", "n_chars": 1}).to_parquet(tmp_path / "documents.parquet")
    got = D._relevant(Tables(spark, str(tmp_path)))

    def runs(s):
        w = " ".join((s or "-none-").lower().split()).split(" ")
        return {tuple(w[i:i + 8]) for i in range(max(len(w) - 7, 1))}
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, j) for i, a in enumerate(item) for j, b in enumerate(docs) if runs(a) & runs(b))
    assert not re.search(r"hashpartitioning\((doc_id#\d+L?, )?run#", re.sub(r"hashpartitioning\(run#\d+L?, item_id", "", shown(got)))


def test_texts_are_kept_on_disk_only(spark):
    d = spark.createDataFrame([(i, f"alpha beta {'gamma ' * (i % 3)}") for i in range(12)], "id long, text string")
    q = d.where("id < 2").withColumnRenamed("id", "q")
    for df in (X.lsa_vectors(d, "id", "text", 2, 16), X.bm25_top_k(q, "q", "text", d, "id", "text", [], 3)):
        levels = re.findall(r"StorageLevel\(([^)]*)\)", shown(df))
        assert levels and not any("memory" in x for x in levels)
        assert df.count()
    spark.catalog.clearCache()
