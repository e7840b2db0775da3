import corpus_pipeline


def test_stages_pass_whole_tables_on(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "secrets", "mixture", "packing"]
    d, left = docs, []
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, None)
        if name != "packing":
            assert d.columns == docs.columns
        d = d.cache()
        left.append(d.count())
    assert left[0] < docs.count() and left[1] < left[0] and left[2] == left[1] and left[4] >= left[3] > 0


def test_near_copies_see_only_what_the_stage_before_kept(spark, docs):
    first = dict(corpus_pipeline.STAGES)
    kept = first["language"](spark, docs, None)
    both = first["near_copies"](spark, kept, None)
    assert {r.doc_id for r in both.collect()} <= {r.doc_id for r in kept.collect()}
