"""Near-duplicates by SimHash, as op8 links them, and by Jaccard similarity of word shingles, for which MinHash bands find candidates and exact sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm import simhash
from waypath.llm.common import Spans, chunks, fresh, looked_up, mix, signed, small_batches, span_hashes, text_bytes, text_key, word_bounds, written
from waypath.llm.graph import components

#: Words of a shingle; similarity (a fraction) from which documents are linked.
SHINGLE, SIMILARITY = 5, (4, 5)
#: A pair of similarity s is a candidate with probability 1 - (1 - s^ROWS)^BANDS: all but 3 in a million at 0.8, more above.
BANDS, ROWS = 32, 5
#: Documents of one group of candidates that one step compares; larger groups are split in blocks, all pairs of which are compared.
BLOCK = 512
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_draw = np.random.default_rng(42)
FACTORS = _draw.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each row's sorted set of shingle hashes: of `shingle` words, A-Z lower-cased; of all words where there are fewer; none without words."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    words, n = span_hashes(data, starts, ends), np.diff(first)
    count = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    cut = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1] - cut[:-1], count) + np.arange(cut[-1])
    hashes = Spans(words).hash(begin, begin + np.repeat(np.minimum(n, shingle), count))
    return [np.unique(hashes[a:b]) for a, b in zip(cut, cut[1:])]


def set_key(own: np.ndarray) -> int:
    """One hash of a set; 0 for the empty one."""
    return int(Spans(own).hash(np.array([0]), np.array([len(own)]))[0]) if len(own) else 0


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set (a row each; sets are not empty), each of ROWS minima."""
    values, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), BANDS), np.uint64)
    for j in range(BANDS):
        key = np.full(len(sets), j + 1, np.uint64)
        for factor, term in zip(FACTORS[j], TERMS[j]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(values * factor + term, at))
        out[:, j] = key
    return out


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, t, k, bands, fp): t the text's hash, k that of its set of shingles, bands its keys (none without words), fp op8's fingerprint."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                sets = shingle_sets(piece.column("text"), shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                own = [[]] * len(sets)
                if full:
                    for i, x in zip(full, signed(bands([sets[i] for i in full]))):
                        own[i] = x
                k = signed(np.array([set_key(s) for s in sets], np.uint64))
                fp = signed(np.array([simhash.fingerprint(x.as_buffer().to_pybytes()) for x in piece.column("text")], np.uint64))
                yield pa.record_batch([piece.column("doc_id"), piece.column("t"), pa.array(k), pa.array(own, pa.list_(pa.int64())), pa.array(fp)], names=["doc_id", "t", "k", "bands", "fp"])

    rows = docs.select("doc_id", text_key().alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(add, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, k long, bands array<long>, fp long")


def linked(keys: list[int], sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among sets: each is reached once, breadth first."""
    (p, q), size, rest, out = similarity, np.array([len(s) for s in sets]), np.arange(len(sets)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            like = rest[np.minimum(size[rest], size[one]) * q >= np.maximum(size[rest], size[one]) * p]  # others are less similar whatever they share
            if not len(like):
                continue
            values = np.concatenate([sets[i] for i in like])
            at = np.minimum(np.searchsorted(sets[one], values), size[one] - 1)
            common = np.add.reduceat((sets[one][at] == values).astype(np.int64), np.concatenate([[0], np.cumsum(size[like])[:-1]]))
            hit = like[common * q >= (size[like] + size[one] - common) * p]
            out += [(keys[one], keys[i]) for i in hit]
            queue.extend(hit)
            rest = np.setdiff1d(rest, hit, assume_unique=True)
    return out


def alike(found: DataFrame) -> DataFrame:
    """Links (a, b) between sets k of found (k, fp) that hold texts with fingerprints within op8's distance: enough to connect all that are linked."""
    own = written(found.select("fp", "k").distinct(), "fingerprints")
    first = written(own.groupBy("fp").agg(F.min("k").alias("first"), F.count("*").alias("n")), "first")
    same = looked_up(own, first, ["fp"], "n").where("k <> first").select(F.col("k").alias("a"), F.col("first").alias("b"))
    near, first = simhash.links(first.select("fp")), first.select("fp", "first")
    for c in "ab":
        near = near.join(first.withColumnsRenamed({"fp": c, "first": f"_{c}"}), c)
    return same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(k, one, root): the sets of shingles, the document that stands for each (none, doc_id, t), and the component of the set.

    Sets are linked when texts of theirs have fingerprints within op8's distance, or when their Jaccard similarity is at least `similarity`. Equal sets count once before anything is compared.
    Sets that share a band key, directly or through others, are candidates; only exact comparison of sets links
    them so. Texts without words have the same (empty) set. Empty table: empty result.
    """
    small_batches(docs.sparkSession)
    found = written(prints(docs, shingle), "prints")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("one")
    classes = written(found.groupBy("k").agg(one, F.first("bands").alias("bands")), "classes")
    keys = classes.select("k", F.explode("bands").alias("band"))
    least = keys.groupBy("band").agg(F.min("k").alias("least"), F.count("*").alias("n")).where("n > 1")
    groups = written(components(looked_up(keys, written(least, "bands"), ["band"], "n").where("k <> least").select(F.col("k").alias("a"), F.col("least").alias("b")).distinct()), "groups")
    blocks = written(groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")), "blocks")
    dealt = looked_up(groups, blocks, ["root"], "n").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.col("node").alias("k"))
    named = classes.join(dealt, "k").select("root", "p", "q", "k", F.col("one.doc_id").alias("_d"), F.col("one.t").alias("_t"))
    texts = docs.select("doc_id", text_key().alias("t"), "text")
    rows = texts.join(named, texts["doc_id"].eqNullSafe(named["_d"]) & (texts["t"] == named["_t"])).select("root", "p", "q", "k", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(own: dict[int, np.ndarray]) -> pa.RecordBatch:
            pairs = np.array(linked(list(own), list(own.values()), similarity), np.int64).reshape(-1, 2)
            return pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

        now, own = None, {}
        for batch in batches:
            for piece in chunks(batch):
                groups = zip(*(piece.column(c).to_pylist() for c in ("root", "p", "q")))
                for group, k, s in zip(groups, piece.column("k").to_pylist(), shingle_sets(piece.column("text"), shingle)):
                    if group != now and own:
                        yield out(own)
                        own = {}
                    now = group
                    own[k] = s
        if own:
            yield out(own)

    links = rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(compare, "a long, b long")
    roots = components(links.unionByName(alike(found)).distinct()).withColumnRenamed("node", "k")
    return classes.drop("bands").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component of near_copies stays.

    It is the one with the least doc_id (nulls last), then the least text hash; of rows with the same doc_id and text one stays.
    """
    one = near_copies(docs, shingle, similarity).groupBy("root").agg(F.min("one").alias("one"))
    one = written(one.select(F.col("one.doc_id").alias("_doc_id"), F.col("one.t").alias("_t")), "kept")
    kept = docs.join(one, docs["doc_id"].eqNullSafe(one["_doc_id"]) & (text_key() == one["_t"]), "left_semi")
    if docs.groupBy("doc_id", text_key().alias("t")).count().where("count > 1").isEmpty():
        return kept  # the usual case needs no second shuffle of the texts
    t = fresh("_t", docs)
    return kept.withColumn(t, text_key()).dropDuplicates(["doc_id", t]).drop(t)
