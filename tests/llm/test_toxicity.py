"""Toxicity scores against a plain scorer that compares every word with every term."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from waypath.llm import toxicity
from waypath.llm.toxicity import CONTEXT, MARKS, MIN_FUZZY, MIN_TOXIC, PRECISION, QUOTES

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_word(w):
    return w.lower().strip(MARKS + QUOTES)


def closest(word, terms, memo):
    if word not in memo:
        near = [t for t in terms if len(t) >= MIN_FUZZY and abs(len(t) - len(word)) <= 1 and edits(t, word) <= 1]
        memo[word] = (word, 0) if word in terms else (min(near), 1) if near else None
    return memo[word]


def findings(text, terms, memo):
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
    out = set()
    for i, m in enumerate(words):
        hit = closest(plain_word(m[0]), terms, memo)
        if hit:
            a, b = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1) - 1
            before, after = text[words[a].start() : m.start()], text[m.end() : words[b].end()]
            double = [q for q in QUOTES if q != "'"]
            opened = m[0][0] in QUOTES or sum(before.count(q) for q in double) % 2 == 1
            closed = m[0][-1] in QUOTES or any(q in after for q in double)
            out.add((*hit, int(opened and closed)))
    return out


def plain_scores(docs, labels):
    """Scores by (doc_id, text), with the lexicon and the shares counted one document after the other."""
    known = {}
    for d, toxic in labels:
        if d is not None and toxic is not None:
            known[d] = max(toxic, known.get(d, 0))
    train = {}
    for d, text in docs:
        if d in known:
            train[text or ""] = max(known[d], train.get(text or "", 0))
    counts = defaultdict(lambda: [0, 0])
    for text, toxic in train.items():
        for w in {plain_word(w) for w in text.split()} - {""}:
            counts[w][toxic] += 1
    n = Counter(train.values())
    terms = {w for w, (neg, pos) in counts.items() if pos >= MIN_TOXIC and pos >= PRECISION * (pos + neg)}
    memo, tally, none = {}, defaultdict(lambda: [0, 0]), [0, 0]
    for text, toxic in train.items():
        keys = findings(text, terms, memo)
        for key in keys | {(None, e, q) for _, e, q in keys}:
            tally[key][toxic] += 1
        if not keys:
            none[toxic] += 1
    base, share = (none[1] + 0.5) / (sum(none) + 1), (n[1] + 1) / (n[0] + n[1] + 2)
    pooled = {k[1:]: (pos + share) / (pos + neg + 1) for k, (neg, pos) in tally.items() if k[0] is None}
    shares = {k: (pos + (8 if k[1] else 2) * pooled[k[1:]]) / (pos + neg + (8 if k[1] else 2)) for k, (neg, pos) in tally.items() if k[0] is not None}
    out = {}
    for d, text in docs:
        q = sorted((shares.get(k, pooled.get(k[1:], base)) for k in findings(text, terms, memo)), reverse=True)
        z = math.log(q[0] / (1 - q[0])) + sum(max(0, math.log(x / (1 - x))) for x in q[1:]) if q else None
        out[d, text] = base if z is None else max(base, 1 / (1 + math.exp(-min(30, z))))
    return out, terms


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("toxic"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(None, None), (9001, ""), (9001, ""), (9002, " \n"), (9003, "x " * 60_000 + "end")]
    odd += [(9100 + i, f"you {'scoundrel' if i % 10 else 'scoundral'} number {i} of many") for i in range(30)] + [(9200 + i, f'they said "the scoundrel {i} left" and went') for i in range(5)] + [(9300 + i, f"plain words {i}") for i in range(20)]
    docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).write.parquet(f"{path}/documents.parquet")
    own = [(9100 + i, 1) for i in range(30)] + [(9200 + i, 0) for i in range(5)] + [(9300 + i, None if i % 4 else 0) for i in range(20)] + [(None, 1)]
    spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic")).unionByName(spark.createDataFrame(own, "doc_id long, toxic int")).write.parquet(f"{path}/labels.parquet")
    return path


def test_scores(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    want, terms = plain_scores(rows, labels)
    assert "scoundrel" in terms and len(terms) > 1
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = toxicity.score_toxicity(docs, toxicity.trained(docs, spark, folder)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id, r.text], abs=1e-9) and r.predicted == (r.score >= 0.3)
    by_id = Counter((r.doc_id, round(r.score, 9)) for r in got)
    assert Counter((r.doc_id, round(r.score, 9)) for r in toxicity.op5(spark, folder).collect()) == by_id
    assert len({round(r.score, 6) for r in got}) >= 5


def test_columns_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit(7.5), "predicted": F.lit(1), "_score": F.lit("s")})
    model = toxicity.trained(docs, spark, folder)
    out = toxicity.score_toxicity(docs, model)
    assert out.columns == [*docs.columns, "__score", "_predicted"]
    left = toxicity.drop_toxic(docs, model)
    assert left.schema == docs.schema and left.select("score", "predicted", "_score").distinct().collect() == [(7.5, 1, "s")]
    assert left.count() == out.where("_predicted = 0").count() < docs.count()
