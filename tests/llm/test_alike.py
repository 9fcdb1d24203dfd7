"""The pipeline's near-duplicate stage links what op8 links."""

import corpus_pipeline
from waypath.llm import simhash


def test_stage_links_fingerprints(spark):
    # One shingle that repeats, and some others: fingerprints agree while the sets of five words share under 0.8.
    base = " ".join(["red green blue"] * 60)
    texts = [base + " one two three four five six", base + " seven eight nine ten eleven twelve", "a text of its own that has nothing to do with the others"]
    a, b, c = (simhash.fingerprint(t.encode()) for t in texts)
    assert (a ^ b).bit_count() <= simhash.DISTANCE < (a ^ c).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [0, 2]
