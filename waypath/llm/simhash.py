"""Near-duplicates by SimHash, with candidates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import documents, fresh, looked_up, signed, text_key, written
from waypath.llm.graph import components

BITS, SHINGLE, SEED, DISTANCE = 64, 4, 42, 4
#: Fingerprints that plan the partition of the bits. The plan changes costs only, never results.
PLAN_SAMPLE = 2000
#: Fingerprints of one bucket that one step compares; larger buckets are split in blocks, all pairs of which are compared.
BLOCK = 4096
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased words' shingles; 0 without words."""
    text = b" ".join(raw.translate(LOWER).split())
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    width = min(shingle, len(gaps) + 1)
    starts = np.concatenate([[0], gaps[: len(gaps) + 1 - width] + 1])
    ends = np.concatenate([gaps[width - 1 :], [len(text)]])
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), 100_000):
        h = np.array([digest(text[a:b], SEED) for a, b in zip(starts[i : i + 100_000].tolist(), ends[i : i + 100_000].tolist())], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, t, fp): fp is the fingerprint as a signed long, t the text's hash."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch.column("text")], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("t"), pa.array(signed(fp))], names=["doc_id", "t", "fp"])

    rows = docs.select("doc_id", text_key().alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(add, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, fp long")


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[int]:
    """Masks such that two fingerprints within `distance` bits agree under at least one of them.

    The bits are cut into m groups of like size, correlated bits together. With thresholds t_i that sum to
    distance - m + 1, a pair within `distance` is within t_i in some group i; a group with t_i = -1 is not
    probed. Within t_i of b bits means equal after removal of some t_i of them. For each m the cheapest thresholds come from
    dynamic programming over estimated costs: pairs that the sample puts within t_i, and C(b, t_i) probes a row.
    """
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float)
    with np.errstate(all="ignore"):
        like = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(sample) > 1 else np.zeros((BITS, BITS))
    apart = sample[: len(sample) // 2] ^ sample[len(sample) // 2 : len(sample) // 2 * 2]
    apart = np.concatenate([apart, *(sample ^ np.roll(sample, k) for k in range(1, min(200, len(sample))))]) if len(sample) > 1 else apart
    best: tuple[float, list[int]] | None = None
    for m in range(2, distance + 2):
        left, groups = set(range(BITS)), []
        for i in range(m):
            own = [max(left, key=lambda b: like[b, sorted(left)].sum())]
            left.remove(own[0])
            while len(own) < (BITS + i) // m and left:
                own.append(max(sorted(left), key=lambda b: like[b, own].sum()))
                left.remove(own[-1])
            groups.append(own)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for own in groups:
            mask = np.uint64(sum(1 << b for b in own))
            near = np.bitwise_count(apart & mask)
            following: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in table.items():
                for more in range(min(distance + 1 - spent, 4) + 1):  # threshold + 1
                    t = more - 1
                    share = 0 if t < 0 else max((near <= t).mean() if len(near) else 0, sum(comb(len(own), j) for j in range(t + 1)) / 2.0 ** len(own))
                    price = 0 if t < 0 else n * n / 2 * share + 30.0 * n * comb(len(own), t)
                    if spent + more not in following or cost + price < following[spent + more][0]:
                        following[spent + more] = (cost + price, [*chosen, t])
            table = following
        if distance + 1 in table and (best is None or table[distance + 1][0] < best[0]):
            cost, chosen = table[distance + 1]
            best = (cost, [sum(1 << b for b in own) & ~sum(1 << b for b in gone) for own, t in zip(groups, chosen) if t >= 0 for gone in combinations(own, t)])
    return best[1]


def _spread(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected within one bucket: each value is reached once, breadth first."""
    a, b, rest = [], [], x
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= distance
            if near.any():
                hit = rest[near]
                a.append(np.full(len(hit), one))
                b.append(hit)
                queue.extend(hit)
                rest = rest[~near]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) within `distance` bits, enough to connect all that are linked.

    A bucket is the fingerprints that agree under one mask of the plan. Within a bucket values are compared
    exactly, and those that are linked are joined by a spanning forest rather than by all pairs. A bucket of over
    BLOCK fingerprints is dealt out as all pairs of its blocks, so it is no one task's work.
    """
    spark = prints.sparkSession
    n = prints.count()
    sample = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()], np.int64).view(np.uint64)
    masks = np.array(plan(sample, n, distance), np.uint64).view(np.int64)
    rows = prints.select("fp", F.explode(F.array(*[F.lit(int(m)) for m in masks])).alias("mask")).withColumn("key", F.expr("fp & mask"))
    sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.join(sizes, ["mask", "key"]).withColumn("own", own)
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    rows = rows.select("mask", "key", "fp", "own", other.alias("other")).select("mask", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, x, cut):
            a, b = [], []
            for i, j in zip(cut, cut[1:]):
                if j - i == 2:
                    if int(x[i] ^ x[i + 1]).bit_count() <= distance:
                        a.append(x[i : i + 1])
                        b.append(x[i + 1 : i + 2])
                elif j - i > 2:
                    u, v = _spread(x[i:j], distance)
                    a.append(u)
                    b.append(v)
            a, b = (np.concatenate([np.empty(0, np.uint64), *v]) for v in (a, b))
            return pa.record_batch({"a": pa.array(signed(a)), "b": pa.array(signed(b))})

        kept_keys, kept_x = np.empty((4, 0), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([kept_keys, np.array([batch.column(c).to_numpy() for c in ("mask", "key", "p", "q")], np.int64)], axis=1)
            x = np.concatenate([kept_x, batch.column("fp").to_numpy().view(np.uint64)])
            cut = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
            if cut[-1]:
                yield out(keys, x, cut)
            kept_keys, kept_x = keys[:, cut[-1] :], x[cut[-1] :]
        if len(kept_x):
            yield out(kept_keys, kept_x, np.array([0, len(kept_x)]))

    dealt = rows.repartition("mask", "key", "p", "q").sortWithinPartitions("mask", "key", "p", "q", "fp")
    return dealt.mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, t, fp, component_id): documents linked when their fingerprints differ in at most `distance` bits.

    docs needs doc_id and text. component_id is the least doc_id that links reach (null only if all are null).
    Equal fingerprints count once before anything is compared, so copies cost nothing. Null, empty and blank
    texts have fingerprint 0 and are linked like any other. Repeated rows stay. Empty table: empty result.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"), distance))
    reached = written(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "reached")
    least = written(reached.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "least")
    return looked_up(prints, written(looked_up(reached, least, ["root"], "members").select("fp", "n", "component_id"), "components"), ["fp"], "n")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component of near_duplicates stays.

    It is the one with the least doc_id (nulls last), then the least text hash; of rows with the same doc_id and text one stays.
    """
    found = written(near_duplicates(docs, shingle, distance), "found")
    one = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("one")).select("one.doc_id", "one.t")
    one = one.withColumnsRenamed({"doc_id": "_doc_id", "t": "_t"})
    kept = docs.join(one, docs["doc_id"].eqNullSafe(one["_doc_id"]) & (text_key() == one["_t"]), "left_semi")
    if found.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        return kept  # the usual case needs no second shuffle of the texts
    t = fresh("_t", docs)
    return kept.withColumn(t, text_key()).dropDuplicates(["doc_id", t]).drop(t)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents: a row for each row; null doc_ids name a component only where it has no other."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
