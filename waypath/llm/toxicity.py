"""Toxicity: a learned lexicon, misspellings by Levenshtein automata over its trie, and context."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import chunks, documents, fresh, kept, small_batches, text_bytes, text_key, word_bounds
from waypath.llm.lookup import WordTable

#: The model is fitted on at most this many labelled rows, drawn by a hash of doc_id, equal texts once.
TRAIN_ROWS = 20_000
#: A term of the lexicon is in at least MIN_TOXIC toxic training texts and in PRECISION of its texts is the label 1.
MIN_TOXIC, PRECISION = 4, 0.8
#: Shortest term that is also sought misspelt; words on either side that tell quotation from abuse; verdict.
MIN_FUZZY, CONTEXT, THRESHOLD = 5, 8, 0.3
MARKS = ".,;:!?()[]{}*#&%$|<>-_/\\+=~^"
QUOTES = "\"'`«»“”„‘’"


def plain(word: str) -> str:
    return word.lower().strip(MARKS + QUOTES)


class Lexicon:
    """Two tries of the terms, forwards and backwards, walked with the automaton of all words within one edit of a word.

    One edit leaves the first or the last half of a term as it is, so each walk starts below an exact half.
    """

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.tries: tuple[dict, dict] = ({}, {})
        for t in terms:
            if len(t) >= MIN_FUZZY:
                for node, letters in zip(self.tries, (t, t[::-1])):
                    for c in letters:
                        node = node.setdefault(c, {})
                    node[""] = t

    def near(self, word: str) -> int:
        """2 * term's number + edits (0 or 1) of the closest term, the first of equals; -1 if none is within one edit."""
        if word in self.number:
            return 2 * self.number[word]
        half = (len(word) - 1) // 2
        if len(word) < MIN_FUZZY - 1:
            return -1
        best = None
        for node, letters in zip(self.tries, (word, word[::-1])):
            for c in letters[:half]:
                node = node.get(c)
                if node is None:
                    break
            if node is None:
                continue
            rest = letters[half:]
            states = [(node, tuple(range(len(rest) + 1)))]
            while states:
                node, row = states.pop()
                if "" in node and row[-1] <= 1 and (best is None or node[""] < best):
                    best = node[""]
                for c, below in node.items():
                    if c:
                        new = [row[0] + 1]
                        for i, w in enumerate(rest):
                            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (w != c)))
                        if min(new) <= 1:
                            states.append((below, tuple(new)))
        return -1 if best is None else 2 * self.number[best] + 1


@dataclass
class Model:
    """Share of label 1 by (term, edits, quoted), the pooled one by (edits, quoted), and that of texts without a match."""

    terms: list[str]
    base: float
    shares: dict[tuple[int, int, int], float] = field(default_factory=dict)
    pooled: dict[tuple[int, int], float] = field(default_factory=dict)

    def score(self, found: set[tuple[int, int, int]]) -> float:
        """The strongest finding's share, raised by others that are themselves likelier than not."""
        q = sorted((self.shares.get(k, self.pooled.get(k[1:], self.base)) for k in found), reverse=True)
        if not q:
            return self.base
        z = math.log(q[0] / (1 - q[0])) + sum(max(0.0, math.log(x / (1 - x))) for x in q[1:])
        return max(self.base, 1 / (1 + math.exp(-min(30.0, z))))


def word_table(terms: tuple[str, ...]) -> WordTable:
    lexicon = Lexicon(list(terms))
    return WordTable(lambda words: [lexicon.near(plain(w)) for w in words])


def matches(batch: pa.RecordBatch, terms: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[set[tuple[int, int, int]]]]]:
    """Pieces of batch, and of each row the set of (term, edits, quoted) found in its whole text."""
    table = kept(("lexicon", terms), lambda: word_table(terms))
    for piece in chunks(batch):
        data, offsets = text_bytes(piece.column("text"))
        starts, ends, first = word_bounds(data, offsets)
        value = table(data, starts, ends)
        found: list[set] = [set() for _ in range(piece.num_rows)]
        for i in np.flatnonzero(value >= 0).tolist():
            row = int(np.searchsorted(first, i, "right")) - 1
            a, b = max(first[row], i - CONTEXT), min(first[row + 1], i + CONTEXT + 1)
            before = data[starts[a] : starts[i]].tobytes().decode()
            after = data[ends[i] : ends[b - 1]].tobytes().decode()
            own = data[starts[i] : ends[i]].tobytes().decode()
            opened = own[0] in QUOTES or sum(before.count(q) for q in QUOTES if q != "'") % 2 == 1
            closed = own[-1] in QUOTES or any(q in after for q in QUOTES if q != "'")
            found[row].add((int(value[i]) // 2, int(value[i]) % 2, int(opened and closed)))
        yield piece, found


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from the rows of labels (doc_id, toxic) whose text docs has; a null label is left out. Of several labels of one
    doc_id or of equal texts the largest holds.

    The lexicon is the terms of many toxic and few other texts. Then what the automaton finds in the same texts is
    counted by term, edits and quotation, which gives each its share of label 1: misspellings or quotations weigh only what
    the labels show. Without labelled rows every score is 0.
    """
    spark = docs.sparkSession
    drawn = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = spark.createDataFrame(drawn.collect(), drawn.schema)  # at most `rows` pairs of numbers
    train = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    train = train.withColumn("t", text_key()).groupBy("t").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("t")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        sizes = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                sizes[toxic == 1] += 1
                for w in {plain(w) for w in text.split()}:
                    counts.setdefault(w, [0, 0])[toxic == 1] += 1
        counts[""] = sizes
        yield pa.record_batch({"term": pa.array(list(counts), pa.string()), "neg": pa.array([c[0] for c in counts.values()], pa.int64()), "pos": pa.array([c[1] for c in counts.values()], pa.int64())})

    counted = train.mapInArrow(words, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(f"term = '' or pos >= {MIN_TOXIC} and pos >= {PRECISION} * (pos + neg)")
    top = counted.orderBy(F.col("term") != "", F.desc("pos"), "term").collect()  # of at most `rows` texts
    n_neg, n_pos = (top[0].neg, top[0].pos) if top else (0, 0)
    terms = tuple(r.term for r in top if r.term)
    if not n_pos + n_neg:
        return Model([], 0.0)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for piece, sets in matches(batch, terms):
                for toxic, keys in zip(piece.column("toxic").to_pylist(), sets):
                    for key in keys | {(-1, e, q) for _, e, q in keys} or {(-2, 0, 0)}:
                        counts[(*key, int(toxic == 1))] += 1
        a = list(zip(*counts)) or [()] * 4
        yield pa.record_batch([*(pa.array(list(x), pa.int32()) for x in a), pa.array(list(counts.values()), pa.int64())], names=["term", "edits", "quoted", "toxic", "n"])

    table: dict[tuple[int, int, int], list[int]] = {}
    for r in train.mapInArrow(found, "term int, edits int, quoted int, toxic int, n long").groupBy("term", "edits", "quoted", "toxic").agg(F.sum("n").alias("n")).collect():  # at most 8 a term
        table.setdefault((r.term, r.edits, r.quoted), [0, 0])[r.toxic] = r.n
    neg, pos = table.pop((-2, 0, 0), [0, 0])
    model = Model(list(terms), (pos + 0.5) / (pos + neg + 1))
    share = (n_pos + 1) / (n_pos + n_neg + 2)
    for (term, edits, quoted), (neg, pos) in sorted(table.items()):  # the pooled ones (-1) come first
        if term < 0:
            model.pooled[edits, quoted] = (pos + share) / (pos + neg + 1)
        else:
            weight = 8 if edits else 2  # a misspelling that few texts show is mostly another word
            model.shares[term, edits, quoted] = (pos + weight * model.pooled[edits, quoted]) / (pos + neg + weight)
    return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= threshold); only text is read.

    Null, empty and blank texts have the score of a text without a match. Rows stay as they are, repeated
    ones too. Columns named score or predicted stay; the new ones then have underscores in front, as fresh() gives them.
    """
    small_batches(docs.sparkSession)
    names, score_name, verdict = docs.columns, fresh("score", docs), fresh("predicted", docs)
    out = docs.withColumns({score_name: F.lit(None).cast("double"), verdict: F.lit(None).cast("int")})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most TRAIN_ROWS texts

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        terms = tuple(model.terms)
        for batch in batches:
            for piece, found in matches(batch, terms):
                s = [model.score(f) for f in found]
                own = piece.select(names)
                yield pa.record_batch([*own.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*names, score_name, verdict])

    return out.mapInArrow(score, out.schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with their own columns, whatever these are called."""
    scored = score_toxicity(docs, model, threshold)
    return scored.where(F.col(fresh("predicted", docs)) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, spark: SparkSession, sf_dir: str) -> Model:
    """Fitted on the labels outside the held-out fold."""
    return fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_toxicity of all documents by the model of trained(): a row for each row, equal texts with equal scores; a null doc_id is not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_toxicity(docs, trained(docs, spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
