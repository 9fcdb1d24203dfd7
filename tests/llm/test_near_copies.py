"""Near copies of the pipeline against plain Python on sets of five words."""

import numpy as np

import corpus_pipeline
from waypath.llm import near_copies

rng = np.random.default_rng(11)
WORDS = [f"v{i}" for i in range(400)]


def words(n):
    return rng.choice(WORDS, n).tolist()


def changed(w, n):
    w = list(w)
    for i in np.linspace(20, len(w) - 20, n).astype(int):
        w[i] = "other"
    return w


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_drops_what_is_similar(spark, monkeypatch):
    base = [words(400) for _ in range(6)]
    texts = [None, "", " \n", "a b", "A  B", "a b c", *(" ".join(b) for b in base)]
    texts += [" ".join(changed(base[0], n)) for n in (1, 3, 6, 8, 9, 12, 20)] + [" ".join(changed(base[1], 4)).upper(), " ".join(base[2] + words(60)), " ".join(base[3] + words(200))]
    rows = [(i if i != 8 else None, t, "s") for i, t in enumerate(texts)] + [(6, texts[6], "s")]
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)) for a in sets]
    want = {min(((r[0] is None, r[0]) for r, h in zip(rows, group) if h == g), key=lambda x: (x[0], x[1] or 0))[1] for g in group}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (near_copies.BLOCK, 3):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        got = [r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()]
        assert len(got) == len(set(got)) == len(set(group)) and set(got) == want
    assert corpus_pipeline.without_near_copies(spark, docs.limit(0), "").count() == 0
