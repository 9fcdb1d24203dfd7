"""A benchmark in several blocks gives what one block gives."""

import numpy as np

from waypath.llm import decontaminate

rng = np.random.default_rng(5)
W = [f"u{i}" for i in range(500)]


def some(n):
    return rng.choice(W, n).tolist()


def test_blocks_change_nothing(spark, monkeypatch):
    a, b, c = some(30), some(16), some(12)
    items = [(1, a[:20]), (2, a[12:30]), (3, b), (4, [*c[:6], *c[6:]]), (5, ["lone", "item"])]
    x, y = some(40), some(40)
    texts = [None, "", " ".join(x), " ".join([*x, *a, *y]), " ".join([*x, *c[:6], *b, *c[6:], *y]), " ".join(a), " ".join([*b[:8], *a[:20], *b[8:]]), "lone  item", " ".join([*x, *c[:6], *a, *c[6:]]), "Lone, item! " + " ".join(x)]
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")

    def results():
        seen = decontaminate.contamination(docs, bench).collect()
        return sorted((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in seen), sorted(map(tuple, decontaminate.remove_contamination(docs, bench).collect()))

    one = results()
    assert (5, " ".join(a), 1) not in one[1] and (2, texts[2], 0) in one[1] and len(one[1]) == 8  # 5, 6 and 7 are nothing else
    for block_bytes in (150, 50):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
        assert len([*decontaminate.blocks(bench, 10)]) > 1
        assert results() == one
