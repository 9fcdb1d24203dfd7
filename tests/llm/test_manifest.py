"""The Merkle manifest against a plain tree, with small superblocks so that several stages are needed."""

import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from waypath.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text=None):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], r[4] if text is None else text)))


def grow(nodes):
    """The root, and of each node its runs with None in its own place."""
    ways, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = range(p - p % 3, min(p - p % 3 + 3, len(nodes)))
            ways[i].append([None if k == p else nodes[k] for k in run])
            place[i] = p // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def plain(rows):
    """(doc_id, source, leaf, subroot, root, path) of each row."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in rows if r[1] == s)
        trees[s] = [r for _, r in own], *grow([leaf(r) for _, r in own])
    root, above = grow([trees[s][1] for s in sources])
    return [(r, leaf(r), trees[s][1], root, way + above[k]) for k, s in enumerate(sources) for r, way in zip(trees[s][0], trees[s][2])]


def told(path):
    return "|".join(",".join(x or "*" for x in run) for run in path)


ROWS = [(i, "big", ["en", None][i % 2], i, f"text {i}\n" * (i % 4), "t", "n") for i in range(170)]
ROWS += [(i, f"s{i % 5}", "en", None, None, None, None) for i in range(300, 322)] + [(1, None, None, None, "a", None, None), (2, "", "é", 1, "", None, None), (3, "", "é", 1, None, None, None)]
ROWS += [(None, "big", "en", 1, "x\n", "t", None)] * 4 + [(None, "big", "en", 1, "y", "t", None), (5, "big", None, 5, "other", None, None), (5, "big", None, 5, "other", None, None), (9, "one", "en", 2, "é€😀" * 30_000, None, None)]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_against_a_plain_tree(spark, height):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    made = manifest.build_manifest(docs, height)
    got = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, told(r.path)) for r in manifest.proofs(made, height).collect()]
    want = plain(ROWS)
    assert Counter(got) == Counter((None if r[0] is None else str(r[0]), r[1], x, sub, root, told(path)) for r, x, sub, root, path in want)
    assert {r[0] for r in made.root.collect()} == {want[0][3]}
    assert Counter(map(tuple, made.subroots.select("source", "leaves", "subroot").collect())) == Counter((s, n, sub) for (s, sub), n in Counter((r[1], sub) for r, _, sub, _, _ in want).items())


def test_op12(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for r, x, sub, root, path in plain(ROWS):
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        folded = leaf(r, r[4].replace("\n", "")) if even and r[4] is not None else x
        for run in path:
            folded = h(*(folded if c is None else c for c in run))
        want[r[0], x, sub, root, h(*(c for run in path for c in run if c)), folded, folded == root] += 1
    got = manifest.op12(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(map(tuple, got.collect())) == want
    assert 0 < got.where("not verified").count() < 90


def test_small_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    made = manifest.build_manifest(none)
    assert manifest.proofs(made).count() == made.root.count() == 0
    one = spark.createDataFrame([(2**60 + 1, None, None, None, None, None, None)], SCHEMA)
    manifest.write_manifest(manifest.build_manifest(one), f"{tmp_path}/m")
    r = spark.read.parquet(f"{tmp_path}/m/proofs").first()
    assert (r.doc_id, r.leaf, r.root, r.path) == (str(2**60 + 1), leaf(one.first()), r.leaf, [])
    with pytest.raises(ValueError, match="place"):
        manifest.build_manifest(one, carry={"place": F.lit(1)})


def test_equal_rows_are_dealt_out(spark):
    rows = spark.range(0, 40_000, 1, 4).select(F.lit("a").alias("by"), F.lit(1).alias("x")).unionByName(spark.range(3).select(F.lit("b").alias("by"), F.lit(1).alias("x")))
    made = manifest.numbered(manifest.written(rows, "rows"), "by", [F.col("x")], "numbered")
    assert made.where("by = 'a'").select("place").distinct().count() == 40_000 and made.where("by = 'b'").agg(F.max("place"), F.max("n")).first()[:] == (2, 3)
    parts = made.sparkSession.read.parquet(made.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_part").count()
    assert parts.agg(F.max("count")).first()[0] < 25_000
