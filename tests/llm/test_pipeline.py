import corpus_pipeline
from tests.llm.helpers import awkward_docs, words
from tests.llm.test_text_operators import brute_quality, brute_substrings, check_packing


def shingles(text):
    w = words(text.lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_against_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = corpus_pipeline.quality_rules(spark, docs, small)
    assert good.columns == docs.columns
    kept = {i for i, r in rows.items() if not brute_quality(r.text)[-1]}
    assert {r.doc_id for r in good.collect()} == kept  # no host is bad here
    single = corpus_pipeline.simhash_near_dedup(spark, good, small)
    left = {r.doc_id for r in single.collect()}
    sets = {i: shingles(rows[i].text) for i in kept}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = [(a, b) for a in kept for b in kept if a < b and alike(a, b)]
    assert all(not (a in left and b in left) for a, b in near)
    twins = {x for p in near for x in p}
    assert kept - left <= twins  # none goes without a partner
    cut = corpus_pipeline.substring_dedup(spark, single, small)
    assert cut.columns == docs.columns
    want = brute_substrings({i: rows[i].text for i in left})
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert {i: len(words(t)) for i, t in texts.items()} == {i: n - gone for i, (n, gone, _) in want.items()}
    packed = corpus_pipeline.best_fit_packing(spark, cut, small).collect()
    check_packing(packed, texts)


def test_run_and_awkward_rows(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    docs = awkward_docs(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        assert k == 3 or out.columns == docs.columns
        stage(spark, docs.limit(0), small).collect()
        docs = out
    assert docs.count() > 0
