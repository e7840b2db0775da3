"""Every registered query of the library builds its plan on the smallest tables."""
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from tickloom.plans import QUERIES

TINY = "/root/testdata/sf0.001"
#: Queries whose solver or model runs while the plan is built; their own tests cover them.
LONG = {"hmm_regimes", "hmm_model", "min_cvar", "walk_forward_meta_features", "purged_label_cv", "importance", "leakage_audit", "single_feature_importance", "seed_ensemble", "hybrid_retrieval", "student_t_fit", "pair_book"}


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no tables")
def test_plans(spark):
    def built(name):
        try:
            return None if QUERIES[name](spark, TINY).columns else f"{name}: no columns"
        except Exception as e:                                       # noqa: BLE001  (all failures are listed together)
            return f"{name}: {str(e)[:200]}"
    names = sorted(q for q in QUERIES if q not in LONG and not q.startswith("stream_"))
    failed = []
    for i in range(0, len(names), 40):
        with ThreadPoolExecutor(4) as pool:
            failed += [f for f in pool.map(built, names[i:i + 40]) if f]
        spark.catalog.clearCache()
    assert not failed, "\n".join(failed)
