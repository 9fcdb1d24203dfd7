"""The pipeline's stages, one after the other and together, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from waypath.llm import tokens

rng = np.random.default_rng(23)
WORDS = [f"k{i}" for i in range(600)]
ITEM = " ".join(f"item{i}" for i in range(25))


def words(n):
    return rng.choice(WORDS, n).tolist()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(i, " ".join(words(60 + i % 40)), "en", "abc"[i % 3], 1) for i in range(240)]
    rows += [(1000 + i, " ".join([*words(30), "scoundrel", *words(30)]), "en", "a", 1) for i in range(60)]  # toxic
    rows += [(2000 + i, rows[i][1] + (" more" if i % 2 else ""), "en", "b", 1) for i in range(20)]  # copies and near copies
    rows += [(3000 + i, " ".join(words(40)) + " " + ITEM + " " + " ".join(words(40)), "en", None, 1) for i in range(8)] + [(3100, ITEM, "en", "a", 1)]
    rows += [(4000, None, "en", "a", 1), (4001, "", None, None, 1), (None, " ".join(words(50)), "en", "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("q1", ITEM.upper()), ("q2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(1000 <= r[0] < 2000), 1) for r in rows if r[0] is not None], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def without_near_copies(rows):
    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    for _ in range(4):
        group = [min(group[j] for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)) for a in sets]
    best = {}
    for r, g in zip(rows, group):
        key = (r.doc_id is None, r.doc_id or 0)
        if g not in best or key < best[g][0]:
            best[g] = key, r
    return [r for _, r in best.values()]


def without_benchmark(text):
    item = ITEM.split()
    while text:
        found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
        hit = {i + k for i in range(len(found) - 9) for j in range(len(item) - 9) if [f[2] for f in found[i : i + 10]] == item[j : j + 10] for k in range(10)}
        if not hit:
            return text
        if len(hit) == len(found):
            return ...
        a, b = found[min(hit)][0], found[max(hit)][1]
        text = text[:a] + " " + text[b:]
    return text


def mixed(rows):
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    total = Counter()
    for r in rows:
        total[r.source] += size[id(r)]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * total[s] for s in over}
        left, open_ = left - sum(2 * total[s] for s in over), open_ - over
        if not open_:
            break
    for s in names:
        digest = {id(r): hashlib.md5((r.text or "").encode()).hexdigest() for r in rows}
        own = sorted((r for r in rows if r.source == s), key=lambda r: (int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{digest[id(r)]}".encode()).hexdigest()[:13], 16)))
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        rest = round(target[s] - epochs * total[s])
        for r in own:
            n = size[id(r)]
            part = max(0, min(n, rest))
            rest -= part
            yield from [r] * (math.ceil((epochs * n + part) / n) if n else 0)


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        steps[name] = before, docs.collect()
        if name != "token_shards":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = steps["toxicity"]
    assert Counter(after) == Counter(r for r in before if "scoundrel" not in (r.text or ""))
    before, after = steps["near_duplicates"]
    assert Counter(after) == Counter(without_near_copies(before)) and len(after) == len(before) - 21  # 20 copies, and one of the two texts without words
    before, after = steps["decontamination"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.doc_id != 3100)
    assert all(r.text == without_benchmark(next(b.text for b in before if b.doc_id == r.doc_id)) or r.doc_id // 100 == 30 for r in after)
    assert all((r.text or "").split() == (without_benchmark(next(b.text for b in before if b.doc_id == r.doc_id)) or "").split() for r in after)
    before, after = steps["mixing"]
    assert Counter(after) == Counter(mixed(before))
    before, after = steps["token_shards"]
    own = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter((r.doc_id, zlib.crc32(np.array([*own.encode(r.text, add_special_tokens=False).ids, 0], "<u4"))) for r in before)
    assert Counter((r.doc_id, r.ids_crc32) for r in after) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, after))


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, folder, tmp_path):
    """Clashing names, a very long text and repeated rows through every stage but the last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = " ".join(words(40_000))
    docs = docs.unionByName(spark.createDataFrame([(5000, long, "en", "a", 1), (5000, long, "en", "a", 1)], docs.schema))
    named = docs.selectExpr("*", "7.5D as score", "1 as predicted", "'x' as _t", "'y' as root", "'z' as size", "doc_id as whole", "2 as range", "3 as k")
    rows = named
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder)
        assert rows.schema.names == named.schema.names, name
        rows.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        got = rows.select("score", "predicted", "_t", "root", "size", "range", "k").distinct().collect()
        assert got == [(7.5, 1, "x", "y", "z", 2, 3)], name
        assert rows.where("whole is distinct from doc_id").count() == 0
        same = rows.where("doc_id = 5000").select("text").collect()
        assert len(same) == (2 if name == "toxicity" else 1) or name == "mixing", name
        assert all(r.text == long for r in same)
    last = corpus_pipeline.STAGES[-1][1](spark, rows, folder)
    assert last.count() == rows.count()
