"""op3_personal_data against plain Python: the patterns as given, and the disclosing terms by their definition."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from waypath.llm import pii

KINDS = ("email", "ip", "card", "phone")
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NASTY = [None, "", "a@b.co_x@d.com y@z.", "x@a@b.c.d..e 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.04 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111", "+1 (255) 555-8013 +12 +1((( +4 1234567+4 12345678", "é😀 ann@ex.org 😀 +49 30 1234567", "a.b@c-d.e-f %@x.y ++@x.y", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7"]


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k in KINDS for m in re.finditer(GIVEN[k], text or "") if valid(k, m[0])]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]


def beside(t, s, e):
    whole = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    return tuple(m[0].lower() for m in [*[m for m in whole if m.end() <= s][-8:], *[m for m in whole if m.start() >= e][:8]])


def telling(texts):
    windows, holds, n_term = defaultdict(set), defaultdict(set), Counter()
    for i, t in enumerate(texts):
        n_term.update(set(words(t or "")))
        for kind, s, e, v in base(t):
            key = f"{kind}:{v.lower()}"
            windows[key].add(beside(t, s, e))
            holds[key].add(i)
    out = set()
    for key, own in windows.items():
        for term in set().union(*own):
            both = sum(term in words(texts[i]) for i in holds[key])
            w, m = sum(term in x for x in own), min(n_term[term], len(holds[key]))
            if both and both >= 0.5 * n_term[term] and math.log2(both * len(texts) / (n_term[term] * len(holds[key]))) * w / (w + 1) * m / (m + 1) >= 2:
                out.add(term)
    return out


def expected(texts):
    terms = telling(texts)
    for t in texts:
        own = [f"{k}:{s}:{e}" for k, s, e, _ in base(t)]
        more = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "") if m[0].lower() in terms]
        yield [sum(x.startswith(k) for x in own) for k in KINDS], hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(own + more)


def run(spark, tmp_path, rows, schema="doc_id long, text string, base string, terms string, _d int"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return pii.op3(spark, str(tmp_path)).collect()


def test_query_gives_what_plain_python_gives(spark, tmp_path):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [*NASTY, *NASTY, *(f"call zanzibar{i} now ann{i}@ex.org soon quokka{i} bye" for i in range(5))]
    got = run(spark, tmp_path, [(i, t, "b", "t", 1) for i, t in enumerate(texts)])
    want = list(expected(texts))
    assert sum("term" in w[2] for w in want) >= 5
    assert {r.doc_id: ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256, r.spans) for r in got} == dict(enumerate(want))


def test_long_texts_are_no_strain(spark, tmp_path):
    texts = ["1 " * 100_000, "9" * 20_000, "a." * 100_000 + "@b" + ".c" * 100_000, "a@b." * 50_000, "+1 " * 50_000, "1.2.3.4 x@y.zz " * 10_000, "é" * 100_000]
    got = run(spark, tmp_path, [(i, t, "b", "t", 1) for i, t in enumerate(texts)])
    want = {i: Counter(x[0] for x in base(t)) for i, t in enumerate(texts) if i != 2}  # there the plain pattern takes quadratic time
    assert {r.doc_id: {k: r[f"n_{k}"] for k in KINDS if r[f"n_{k}"]} for r in got} == want | {2: {"email": 1}}


def test_clashing_columns_and_repeats(spark):
    schema = "doc_id long, text string, base string, terms string, _d int, _t int, _k int, _base int"
    docs = spark.createDataFrame([(1, "mail ann@ex.org", "b", "t", 1, 2, 3, 4)] * 2 + [(None, None, None, None, None, None, None, None)], schema)
    got = pii.sanitize(docs)
    assert got.schema == docs.schema
    assert Counter(map(tuple, got.collect())) == Counter([(1, "mail <email>", "b", "t", 1, 2, 3, 4)] * 2 + [(None,) * 8])
    assert pii.sanitize(docs.limit(0)).count() == 0
