"""The corpus queries against their SQL, and those that SQL can't express against plain Python, on whole small tables."""

import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waypath.llm import mixing, quality, registry, tokens, toxicity
from waypath.llm.common import fresh

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def at(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def edges(spark):
    """Documents of every odd kind beside the given ones: nulls, empty, repeated rows, a long text, clashing columns."""
    docs = table(spark, "documents")
    rows = [(None, None, None, None), (9001, "", "en", "b"), (9001, "", "en", "b"), (9002, " \n\t ", None, None), (9003, "x " * 90_000, "zz", "b"), (9004, "é€😀 " * 40, "en", None), (None, "same text " * 60, "en", "a"), (9005, "same text " * 60, "en", "a")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(0).cast(docs.schema["n_chars"].dataType))
    return docs.unionByName(odd.select(docs.columns))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, tmp_path, name):
    folder = at(spark, tmp_path, documents=edges(spark).coalesce(3), benchmark=table(spark, "benchmark"), labels=table(spark, "labels"))
    c = duckdb.connect()
    for p in ("documents", "benchmark", "labels"):
        c.sql(f"create view {p} as select * from read_parquet('{folder}/{p}.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    want = c.sql(f"select {', '.join(cols)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(want)


def test_op1_and_op4(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    docs = edges(spark)
    folder = at(spark, tmp_path, documents=docs)
    rows = docs.select("doc_id", "text").collect()
    ids = [own.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    want = Counter((r.doc_id, len((r.text or "").encode()), len(i), len(i) > 1024) for r, i in zip(rows, ids))
    assert Counter(map(tuple, tokens.op1(spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want
    got = sorted(tokens.op4(spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4"))) for r, i in zip(rows, ids))
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_a_damaged_index_is_noticed(spark, tmp_path):
    path = f"{tmp_path}/shards"
    tokens.write_token_shards(table(spark, "documents"), path, tokens.default_tokenizer())
    store = tokens.TokenStore(spark, path)
    assert store.get(3)[-1] == 0 and store.get(-5) is None and store.get(10**9) is None
    index = next(Path(path).glob("*.idx"))
    raw = bytearray(index.read_bytes())
    raw[-8:] = (7).to_bytes(8, "little")
    index.write_bytes(raw)
    with pytest.raises(Exception, match="doesn't lead"):
        tokens.read_token_shards(spark, path).collect()


def test_op5(spark, tmp_path):
    docs = edges(spark)
    labels = table(spark, "labels")
    folder = at(spark, tmp_path, documents=docs, labels=labels.unionByName(labels.limit(20)))
    got = toxicity.op5(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    other = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    again = toxicity.op5(spark, at(spark, tmp_path / "other", documents=docs.withColumnsRenamed({"lang": "score"}), labels=other)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))  # the held-out labels are never read


def test_conflicting_labels_are_settled(spark):
    docs = spark.createDataFrame([(i, f"plain text {i % 5}" + " scoundrel" * (i % 2)) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)] + [(i, 0) for i in range(60)]
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int").repartition(n)) for x, n in ((labels, 1), (labels[::-1], 7))]
    assert models[0] == models[1] and models[0].terms == ["scoundrel"]


def plain_quality(docs):
    """Counts, and distances to the references, as the definitions say."""
    words = {}
    for r in docs:
        words.setdefault(r.lang or "", Counter()).update(re.findall(WORD, r.text or ""))
    every = sum(sum(c.values()) for c in words.values())
    kinds = {name: Counter() for name in words}

    def classes(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return np.bincount(quality.CLASS[raw], minlength=9)[:8]

    for r in docs:
        kinds[r.lang or ""].update(dict(enumerate(classes(r.text).tolist())))
    models = []
    for name, c in sorted(words.items()):
        size = sum(c.values())
        if size >= quality.MIN_REFERENCE and size >= quality.LANGUAGE * every:
            models.append((np.array([kinds[name][i] for i in range(8)]), {w: n / size for w, n in c.items() if n >= quality.COMMON * size}))

    def js(p, q):
        m = (p + q) / 2
        return np.sqrt(max(0, sum(float(a * np.log2(a / c)) for a, c in zip(p, m) if a > 0) + sum(float(b * np.log2(b / c)) for b, c in zip(q, m) if b > 0)) / 2)

    for r in docs:
        own = re.findall(WORD, r.text or "")
        n = len(own)
        grams = Counter(tuple(own[i : i + 5]) for i in range(n - 4))
        hit = {i + k for i in range(n - 4) if grams[tuple(own[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (r.text or "").split("\n") if re.search(WORD, x)]
        k = classes(r.text)
        by_chars = min(js(k / k.sum(), q / q.sum()) for q, _ in models) if k.sum() >= 200 else 0
        counts = Counter(own)
        by_words = min(js(np.array([*(counts[w] / n for w in q), 1 - sum(counts[w] / n for w in q)]), np.array([*q.values(), 1 - sum(q.values())])) for _, q in models) if n >= 60 else 0
        failed = n < 10 or 100 * len(hit) > 20 * n
        yield (r.doc_id, n, sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(hit), failed), not failed and by_chars <= quality.MAX_CHARS and by_words <= quality.MAX_WORDS, round(float(by_chars), 6), round(float(by_words), 6)


def test_op7(spark, tmp_path):
    docs = edges(spark)
    got = quality.op7(spark, at(spark, tmp_path, documents=docs)).collect()
    have = Counter(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r.kept, round(r.chars_distance, 6) + 0.0, round(r.words_distance, 6) + 0.0) for r in got)
    assert have == Counter(plain_quality(docs.collect()))


def test_references_of_many_languages_stay_few(spark):
    rows = [(i, f"l{i % 900}", " ".join(f"w{i}x{j}" for j in range(30))) for i in range(1800)] + [(9000 + i, "en", "the cat and the dog " * 200) for i in range(9)]
    known, models = quality.references(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(models) == 1 and len(known) == 4  # only what makes a share of a language that makes a share of the corpus


def test_mixing_reruns_and_bounds(spark, tmp_path):
    docs = edges(spark)
    one, two = (mixing.mix_sources(mixing.sized(docs.repartition(n))).collect() for n in (2, 9))
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))
    taken = Counter()
    for r in one:
        taken[r.source_size, r.target] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(n - target) <= 1 for (_, target), n in taken.items())
    clash = docs.withColumnsRenamed({"n_chars": "size", "lang": "target"})
    assert mixing.mixed(clash).schema == clash.schema
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_clashing_columns_of_counts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 5, "d"), (1, "a b", 6, "e"), (2, None, 7, None)], "doc_id long, text string, n_tokens int, digest string")
    got = tokens.count_tokens(docs, tokens.default_tokenizer(), f"{tmp_path}/cache")
    assert got.columns == ["doc_id", "digest", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == Counter([(1, "d", 3, 2, False), (1, "e", 3, 2, False), (2, None, 0, 0, False)])
    assert fresh("DIGEST", docs) == "_DIGEST"


def test_texts_of_several_stretches(spark, monkeypatch):
    from waypath.llm import common, repeats, substring_dedup

    rng = np.random.default_rng(3)
    w = [f"q{i}" for i in range(50_000)]
    passage = rng.choice(w, 500).tolist()
    texts = [" ".join([*rng.choice(w, 3000), *passage, *rng.choice(w, 2500)]) for _ in range(3)] + ["ab" * 3000, " ".join(passage[100:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def results():
        return [sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in f(docs).collect()) for f in (substring_dedup.drop_repeated_bytes, substring_dedup.drop_repeated_words)]

    whole = results()
    assert all(sum(n > 0 for _, n, _ in r) >= 4 for r in whole)
    assert {d: n for d, n, _ in whole[1]} == {0: 500, 1: 500, 2: 500, 3: 0, 4: 400}
    data = np.frombuffer(texts[0].encode(), np.uint8)
    starts, ends, _ = common.word_bounds(data, np.array([0, len(data)]))
    hashes = common.span_hashes(data, starts, ends)
    monkeypatch.setattr(common, "CHUNK_BYTES", 1000)
    assert (common.span_hashes(data, starts, ends) == hashes).all()
    for own, width, gram in ((data, 400, 304), (hashes, 35, 24)):
        sizes = {}
        for n in (10**6, 700):
            monkeypatch.setattr(repeats, "STRETCH", n)
            sizes[n] = sorted((at + s, at + e + 1) for at, x in repeats.stretches(own, np.array([0, len(own)]), width, gram) for s, e in zip(x.starts, x.ends))
            assert [a for a, _ in sizes[n]][1:] == [b for _, b in sizes[n]][:-1] and sizes[n][-1][1] == len(own) - width + 1  # every window once
        start = np.arange(0, len(own) - width)
        monkeypatch.setattr(repeats, "STRETCH", 10**6)
        want = repeats.hashed(own, start, width)
        monkeypatch.setattr(repeats, "STRETCH", 700)
        assert (repeats.hashed(own, start, width) == want).all()
