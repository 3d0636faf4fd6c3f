import corpus_pipeline as cp
from test_operators import brute_links


def test_stages_keep_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        if name != "sharding":
            assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= set(before)
        if name == "ngram_jaccard_join":
            ids = sorted(before)
            links = brute_links([before[i].text for i in ids])
            assert after == {i for k, i in enumerate(ids) if links[k][1] == k}
        if name == "sharding":
            assert after == set(before)
        docs = out
    assert cp.run(spark, d).count() == docs.count()
