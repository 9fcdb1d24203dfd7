"""Secret scans: rules are regular expressions; a trigram index finds the texts that each can match."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import chunks, documents, fresh, scratch, text_bytes
from waypath.llm.trigrams import answer, compiled, trigram_query, vocabulary


class Rule(NamedTuple):
    """A kind of secret. group: what is measured, of at least `least` characters; a match with less is passed over, and the search goes on behind it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed patterns of the results' counts, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Published formats of other keys, which the scan adds.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[^\x00-\x20/:@]{1,256}:[^\x00-\x20/:@]{1,256}@"),
)
#: Bits of a sieve of candidates: SIEVE_SHARE for each, from 2^SIEVE_BITS[0] to 2^SIEVE_BITS[1] (16 MB), which bounds its broadcast.
SIEVE_BITS, SIEVE_SHARE = (16, 27), 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text of one segment of the index.
SEGMENT_BYTES = 2_000_000
#: The trigram under which a segment keeps the keys of its texts.
KEYS = -1
INDEX = "trigram int, segment long, texts binary"


def text_id() -> Column:
    """A text's key in the index: equal texts share it; so would two texts of one hash, of which one might be scanned in vain."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def postings_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, text) pairs of a chunk, sorted and distinct; a text longer than a chunk is taken in overlapping blocks."""
    data, offsets = text_bytes(batch.column("text"))
    found = []
    for a in range(0, max(0, len(data) - 2), SEGMENT_BYTES):
        b = min(len(data), a + SEGMENT_BYTES + 2)
        part = LOWER[data[a:b]].astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.clip(offsets, a, b)))
        inside = row[2:] == row[:-2]
        found.append(np.unique((part[:-2] << 48 | part[1:-1] << 40 | part[2:] << 32 | row[:-2])[inside]))
    pairs = found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def packed(ascending: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ascending numbers (each begins at one of starts) as the gaps between them in bytes of 7 bits, low ones first, and each list's first byte."""
    gap = np.diff(ascending, prepend=0)
    gap[starts] = ascending[starts]
    width = np.ones(len(gap), np.int64)
    for k in (7, 14, 21, 28):
        width += gap >= 1 << k
    first = np.concatenate([[0], np.cumsum(width)])
    out = np.empty(first[-1], np.uint8)
    for k in range(5):
        some = np.flatnonzero(width > k)
        out[first[some] + k] = (gap[some] >> (7 * k) & 127) | np.where(width[some] > k + 1, 128, 0)
    return out, first[np.append(starts, len(gap))]


def unpacked(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)) if len(data) else np.empty(0, np.int64)


def index_rows(docs: DataFrame) -> DataFrame:
    """INDEX rows of docs (k, text): of each segment of texts the posting list of each trigram, and the texts' keys.

    A segment is about SEGMENT_BYTES of one task's texts and is known by the first 64 bits of a digest of its keys and of its place in
    the task, so a task that runs again makes the same rows.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for piece in chunks(batch, most=SEGMENT_BYTES):
                keys = np.asarray(piece.column("k"))
                trigram, text = postings_of(piece)
                starts = np.flatnonzero(np.diff(trigram, prepend=-1))
                data, first = packed(text, starts) if len(text) else (np.empty(0, np.uint8), np.zeros(1, np.int64))
                lists = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                own = hashlib.sha256(keys.tobytes() + f"{number}".encode()).digest()[:8]
                segment, number = int.from_bytes(own, "little", signed=True), number + 1
                yield pa.record_batch([pa.array(trigram[starts].astype(np.int32)), pa.array(np.full(len(starts), segment)), lists], names=["trigram", "segment", "texts"])
                yield pa.record_batch([pa.array([KEYS], pa.int32()), pa.array([segment]), pa.array([keys.tobytes()], pa.binary())], names=["trigram", "segment", "texts"])

    return docs.select("k", "text").mapInArrow(segments, INDEX)


def write_index(docs: DataFrame, path: str) -> DataFrame:
    """The trigram index of docs' texts as a Parquet table, sorted by trigram in each task: a search reads only the pages of its trigrams.

    docs needs text; other columns are ignored, whatever their names. Null is the empty text, which has no trigrams. Texts of any length are whole.
    """
    rows = docs.select(text_id().alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    index_rows(rows).sortWithinPartitions("trigram").write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def candidates(index: DataFrame, patterns: list[str]) -> DataFrame:
    """(k, rule) of the texts that can match each pattern by the index, a row for each text of it. Patterns without mandatory trigrams have no rows.

    The posting lists of the patterns' trigrams meet by segment, which bounds a group, and are intersected and united there.
    """
    queries = {i: q for i, p in enumerate(patterns) if (q := trigram_query(p))}
    words = vocabulary(list(queries.values()))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(group.loc[group["trigram"] == KEYS, "texts"].iloc[0], np.int64)
        lists = {t: unpacked(raw) for t, raw in zip(group["trigram"], group["texts"]) if t != KEYS}
        found = [(i, answer(q, lists)) for i, q in queries.items()]
        return pd.DataFrame({"k": np.concatenate([keys[a] for _, a in found]), "rule": np.repeat([i for i, _ in found], [len(a) for _, a in found])})

    if not words:
        return index.sparkSession.createDataFrame([], "k long, rule int")
    held = index.where(F.col("trigram").isin(words)).select("segment").distinct()
    asked = index.where(F.col("trigram").isin([KEYS, *words])).join(held, "segment", "left_semi")
    return asked.groupBy("segment").applyInPandas(search, "k long, rule int")


def sieve_of(found: DataFrame, bits: int) -> DataFrame:
    """(rule, block, map): a bit map of 2^bits bits for each rule, in blocks of 2^16 bits, in which the rule's keys have two bits each."""
    block = min(bits, 16)
    h = F.col("k")
    both = F.array(h.bitwiseAND(F.lit(2**bits - 1)), F.shiftrightunsigned(h, 64 - bits))
    bit = found.select("rule", F.explode(both).alias("p")).select("rule", F.shiftright("p", block).cast("int").alias("block"), F.col("p").bitwiseAND(F.lit(2**block - 1)).cast("int").alias("bit")).distinct()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(2**block, bool)
        own[group["bit"].to_numpy()] = True
        return pd.DataFrame({"rule": group["rule"].iloc[:1], "block": group["block"].iloc[:1], "map": [np.packbits(own).tobytes()]})

    return bit.groupBy("rule", "block").applyInPandas(pack, "rule int, block int, map binary")


class Sieves:
    """For each rule of the index a bit map that all its candidates pass. Few others do until it fills up; then more texts are scanned, with the same result."""

    def __init__(self, found: DataFrame, rules: list[int]):
        most = found.groupBy("rule").count().agg(F.max("count")).first()[0] or 0
        low, high = SIEVE_BITS
        self.bits = min(high, max(low, (most * SIEVE_SHARE).bit_length()))
        self.maps = {i: np.zeros(2 ** (self.bits - 3), np.uint8) for i in rules}
        size = 2 ** (min(self.bits, 16) - 3)
        for r in sieve_of(found, self.bits).toLocalIterator():  # at most a sieve of 2^SIEVE_BITS[1] bits a rule
            self.maps[r.rule][r.block * size : (r.block + 1) * size] = np.frombuffer(r.map, np.uint8)

    def passes(self, rule: int, k: np.ndarray) -> np.ndarray:
        own, u = self.maps[rule], k.view(np.uint64)
        out = np.ones(len(k), bool)
        for p in (u & np.uint64(2**self.bits - 1), u >> np.uint64(64 - self.bits)):
            out &= (own[p >> np.uint64(3)] >> (7 - (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return out


def matches(rule: Rule, regex: re.Pattern[str], text: str) -> Iterator[tuple[int, int]]:
    """Places of the leftmost matches that are long enough, in code points."""
    for m in regex.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def searched(rule: Rule) -> str:
    """A rule that is one class, repeated, finds the same places if the class is asked for `least` times at once."""
    simple = re.fullmatch(r"(\[[^\]\\]+\])\+", rule.pattern)
    return f"{simple[1]}{{{rule.least},}}" if simple and not rule.group and rule.least else rule.pattern


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, index: DataFrame | None = None) -> DataFrame:
    """docs' columns and secrets: array<struct<kind,start,end>> by start, then by the rules' order, in code points.

    Rules whose pattern demands trigrams are looked up in the index (made here in the shared folder unless it is given) and only their
    candidates are verified, on the whole text; other rules scan all texts. Both happen in one pass over docs, without a shuffle of texts or a
    join, so copies and hot keys cost nothing more. All columns stay, whatever their names (a column called secrets stays, and the new one
    gets underscores in front). Null and empty texts have no secrets; repeated rows each have theirs; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    patterns = [r.pattern for r in rules]
    indexed = [i for i, p in enumerate(patterns) if trigram_query(p)]
    sieves = None
    if indexed:
        index = index or write_index(docs, scratch(spark, "trigrams"))
        path = scratch(spark, "candidates")
        candidates(index, patterns).write.parquet(path)
        sieves = spark.sparkContext.broadcast(Sieves(spark.read.schema("k long, rule int").parquet(path), indexed))
    k, name = fresh("_k", docs), fresh("secrets", docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    columns = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regex = [compiled(searched(r)) for r in rules]
        for batch in batches:
            for piece in chunks(batch):
                keys, texts = np.asarray(piece.column(k)), piece.column("text").to_pylist()
                asked = [sieves.value.passes(i, keys) if i in indexed else np.ones(len(keys), bool) for i in range(len(rules))]
                out = []
                for row, text in enumerate(texts):
                    found = [(start, i, end) for i, r in enumerate(rules) if text and asked[i][row] for start, end in matches(r, regex[i], text)]
                    out.append([{"kind": rules[i].kind, "start": start, "end": end} for start, i, end in sorted(found)])
                yield pa.record_batch([*(piece.column(c) for c in columns), pa.array(out, kind)], names=[*columns, name])

    schema = docs.withColumn(name, F.expr("cast(null as array<struct<kind:string,start:int,end:int>>)")).schema
    return docs.withColumn(k, text_id()).mapInArrow(scan, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, index: DataFrame | None = None) -> DataFrame:
    """docs with each secret replaced by its kind ("<hex>"); of overlapping ones the first that starts. All columns stay, whatever their names."""
    name = fresh("secrets", docs)
    empty = F.expr("cast(array() as array<string>)")

    def step(s: Column, c: Column) -> Column:
        between = F.substr("text", s["at"] + 1, F.greatest(F.lit(0), c["start"] - s["at"]))
        return F.struct(F.greatest(s["at"], c["end"]).alias("at"), F.when(c["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.array(between, F.concat(F.lit("<"), c["kind"], F.lit(">"))))).alias("out"))

    rest = F.aggregate(name, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: F.array_join(F.concat(s["out"], F.array(F.substr("text", s["at"] + 1, F.length("text")))), ""))
    found = find_secrets(docs, rules, index)
    return found.withColumn("text", F.when(F.size(name) > 0, rest).otherwise(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_secrets of all documents: a row for each row, repeated ones alike; null and empty texts have no spans."""
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    base, counts = of(*(r.kind for r in BASE)), [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
