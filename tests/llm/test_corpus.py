"""Corpus operators against plain Python, with nulls, empty and repeated rows, and an empty table."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from waypath.llm import decontaminate, mixing, pii, quality, simhash, substring_dedup, tokens, toxicity
from waypath.llm.common import scratch

rng = np.random.default_rng(7)
WORDS = [f"w{i}" for i in range(300)] + ["Été", "größe", "x,"]


def text(n):
    return " ".join(rng.choice(WORDS, n))


PASSAGE = text(80)
TEXTS = [None, "", "  \n ", "one", text(200), text(30) + "\n" + PASSAGE + " " + text(20), PASSAGE + text(100), text(60), "aa " * 300, "é" * 900, text(500)]
TEXTS += [TEXTS[4], TEXTS[4], TEXTS[10] + " more", "mail a@b.co, 1.2.3.4, +1 (255) 555-8013, 4111 1111 1111 1111  x  <|endoftext|>"]
ROWS = [(i if i != 7 else None, t, "en", ["a", "b", None][i % 3], 9) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "b", 9)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def covered(seqs, width):
    n = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    for s in seqs:
        m = [False] * len(s)
        for i in range(len(s) - width + 1):
            if n[tuple(s[i : i + width])] > 1:
                m[i : i + width] = [True] * width
        yield [x for x, y in zip(s, m) if not y], sum(m)


@pytest.mark.parametrize(("f", "split", "join", "width"), [(substring_dedup.drop_repeated_words, lambda t: t.encode().split(), lambda k: b" ".join(k), 35), (substring_dedup.drop_repeated_bytes, lambda t: list(t.encode()), bytes, 400)])
def test_repeats(docs, empty, f, split, join, width):
    want = Counter((r[0], m, hashlib.sha256(join(k)).hexdigest()) for r, (k, m) in zip(ROWS, covered([split(r[1] or "") for r in ROWS], width)))
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in f(docs).collect()) == want
    assert f(empty).count() == 0


def test_simhash(docs, empty):
    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(r[1]) for r in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        group = [min(group[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4) for p in prints]
    least = {g: min(r[0] for r, h in zip(ROWS, group) if h == g and r[0] is not None) if any(r[0] is not None for r, h in zip(ROWS, group) if h == g) else None for g in group}
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter((r[0], p, least[g]) for r, p, g in zip(ROWS, prints, group))
    assert simhash.drop_near_duplicates(docs).count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0


def test_plan_loses_no_pair():
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for n in (10, 10**5, 10**9):
        masks = simhash.plan(sample, n)
        for _ in range(300):
            gone = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(m & gone == 0 for m in masks)


def test_decontamination(spark, docs, empty):
    item = " ".join(TEXTS[10].split()[50:75])
    bench = spark.createDataFrame([(1, item.upper()), (2, "one"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, bench).collect()}
    hit = {k[0] for k, r in got.items() if r.n_hit}
    assert {3, 10, 13} <= hit and got[10, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", TEXTS[10].lower()))].n_hit >= 25
    clean = decontaminate.remove_contamination(docs, bench)
    assert decontaminate.contamination(clean, bench).where("n_hit > 0").count() == 0
    assert clean.where("doc_id = 3").count() == 0 and decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_fm_index():
    t = rng.integers(1, 4, 400)
    index = decontaminate.FMIndex(t)
    phrases = np.array([[1, 2, 3], [3, 3, 3], [2, 2, 1]])
    which, low, high = index.search(phrases)
    for w, a, b in zip(which, low, high):
        want = [i for i in range(len(t) - 2) if (t[i : i + 3] == phrases[w]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    cache = scratch(spark, "cache")
    for _ in range(2):
        got = Counter((r.doc_id, r.n_tokens) for r in tokens.count_tokens(docs, tokens.default_tokenizer(), cache).collect())
        assert got == Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in ROWS})
    path = scratch(spark, "shards")
    tokens.write_token_shards(docs, path, tokens.default_tokenizer())
    store = tokens.TokenStore(spark, path)
    assert store.get(5).tolist() == [*t.encode(TEXTS[5], add_special_tokens=False).ids, 0] and store.get(99) is None
    rows = sorted(tokens.read_token_shards(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == len(ROWS) and rows[0].doc_id is None
    assert rows[1].ids_crc32 == zlib.crc32(np.array([0], "<u4"))
    assert tokens.token_shards(empty, tokens.default_tokenizer()).count() == 0


def test_personal_data(docs, empty):
    r = pii.sanitize(docs).where("doc_id = 14").first()
    assert r.text.startswith("mail <email>, <ip>, <phone>, <card>  x")
    assert pii.find_personal_data(empty).count() == 0 and pii.find_personal_data(docs).count() == len(ROWS)


def test_toxicity(spark, docs, empty):
    bad = [(i, text(20) + (" scoundrel" if i % 4 == 0 else "") + " " + text(20)) for i in range(200)]
    train = spark.createDataFrame(bad, "doc_id long, text string")
    model = toxicity.fit(train, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(train, model).collect()}
    assert all(got[i] == (i % 4 == 0) for i in got)
    assert toxicity.score_toxicity(docs, model).count() == len(ROWS) and toxicity.score_toxicity(empty, model).count() == 0
    lexicon = toxicity.Lexicon(["scoundrel", "thief"])
    assert [lexicon.near(w) for w in ("scoundrel", "scoundrl", "scuondrel", "thieff", "chief")] == [0, 1, -1, 3, 3]


def test_quality(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in quality.quality_rules(docs).collect()}
    w = TEXTS[8].split()
    assert got[8, len(w)].n_repeat_words == len(w) and got[8, len(w)].base_failed
    assert not got[1, 0].kept and quality.quality_rules(empty).count() == 0
    assert abs(float(quality.distance(np.array([[1, 0]]), np.array([0, 1]))[0]) - 1) < 1e-12
