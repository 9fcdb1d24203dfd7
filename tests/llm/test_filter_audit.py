"""The filter audit against a plain loop over documents, orders and steps."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypath.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, mask string, good int, n long"
LABELS = "doc_id long, quality int, toxic int, text string"


def plain(rows, labels):
    """The report, by applying every order to every document."""
    first = {}
    for d, x, *_ in rows:
        if d is not None:
            first[x or ""] = min(d, first.get(x or "", d))
    good, toxic = ({d for d, *y in labels if y[i] == 1} for i in (0, 1))
    docs = []
    for d, x, lang, *_ in rows:
        x = x or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", x)) > 3 * len(x), bool(re.search("[#$%&*|]", x)), d is not None and d > first[x]]
        docs.append((lang or "", {f for f, t in zip("ABCDE", tests) if t}, d in good and d is not None, d in toxic and d is not None))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [x for x in docs if x[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                earlier = [x for x in own if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(earlier) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return Counter((*k, *v) for k, v in out.items())


def got(df):
    return Counter((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect())


def test_against_a_loop(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, n)) for n in (50, 199, 200, 230, 400, 900)] + ["a b " * 150, "ABC " * 220, "x# " * 3, "é€😀 " * 210, "", None, " \n\t ", "q " * 90_000, " ".join(words) + " 5%", "Aa " + " ".join(words[:250])]
    rows = [(i if i != 7 else None, texts[rng.integers(len(texts))], [None, "", "en", "de"][i % 4], "m", 1, 2) for i in range(160)]
    rows += [rows[3], rows[3], (None, texts[0], "en", None, None, None), (None, texts[0], "en", None, None, None)] + [(500 + i, texts[0], "en", None, None, None) for i in range(60)]
    labels = [(i, int(rng.integers(2)), [0, 1, None][i % 3], "t") for i in range(0, 170, 2)] + [(3, 1, 0, ""), (3, 0, 1, ""), (3, None, None, ""), (None, 1, 1, "")]
    docs, tags = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    want = plain(rows, labels)
    assert len(want) == 3 * 600 and got(filter_audit.audit_documents(docs, tags)) == want
    assert got(filter_audit.audit_documents(docs.repartition(7), tags)) == want


def test_empty_tables(spark):
    none, tags = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(none, tags).count() == 0
    one = filter_audit.audit_documents(spark.createDataFrame([(1, "a", None, None, None, None)], SCHEMA), tags)
    assert got(one) == plain([(1, "a", None)], [])


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", 3, True, None), ("p", None, None, True), (None, 0, False, False), ("p", 2, True, True)], "part string, mask int, good boolean, toxic boolean").withColumn("n", F.lit("n"))
    out = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(rows, "xy").collect()}
    assert len(out) == 8
    r = out["p", "xy", 1]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (2, 1, 0, 0, 1, 0, 1)
    r = out["p", "xy", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (1, 1, 1, 1, 1, 1, 3)
    assert out["", "yx", 2].kept == 1
    for bad in ("", "aa", "abcdefgh"):
        with pytest.raises(ValueError):
            filter_audit.audit(rows, bad)


def test_steps_are_the_least_of_the_places():
    orders, place = filter_audit.places("ABC")
    assert orders[1] == "ACB" and place[1].tolist() == [0, 2, 1]
    fails = np.array([[0, 1, 1], [0, 0, 0], [1, 0, 0]], bool)
    assert filter_audit.removal_steps(fails, place)[:, 1].tolist() == [1, 3, 0]
