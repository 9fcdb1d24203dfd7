"""Quality rules: repetition counts, and divergence of a text from the references of the languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import BLANK, CHUNK_BYTES, Spans, chunks, documents, mix, signed, span_hashes, text_bytes, word_bounds, written

#: A word is common in a language if it makes this share of its words, so a language has at most 1 / COMMON common words.
COMMON = 0.004
#: A language is a reference if it makes this share of all words and has MIN_REFERENCE of them: at most 1 / LANGUAGE languages.
LANGUAGE, MIN_REFERENCE = 0.001, 2000
#: Shortest texts that are judged by character classes and by common words.
MIN_CHARS, MIN_WORDS = 200, 60
#: Jensen-Shannon distances (0 to 1) beyond which a text is rejected.
MAX_CHARS, MAX_WORDS = 0.32, 0.42
#: Distinct words of which a task keeps counts before it hands them on.
TASK_WORDS = 400_000
CLASSES = 8
CLASS = np.full(256, 5)  # other ASCII signs
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[:32] = 0, 1, 2, 6
CLASS[[32, *range(9, 14)]] = 3
CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 4
CLASS[128:192], CLASS[192:] = CLASSES, 7  # bytes that continue a character don't count
#: 1 for symbols, 2 for other characters of words, 0 for blanks and bytes that continue a character.
SIGN = np.where(BLANK | (np.arange(256) & 0xC0 == 0x80), 0, 2)
SIGN[[ord(c) for c in "#*$%&|<>"]] = 1


class Piece:
    """Words and character classes of the rows of one chunk."""

    def __init__(self, piece: pa.RecordBatch):
        self.data, self.offsets = text_bytes(piece.column("text"))
        self.starts, self.ends, self.first = word_bounds(self.data, self.offsets)
        self.words = span_hashes(self.data, self.starts, self.ends)
        self.n = piece.num_rows
        self.row = np.repeat(np.arange(self.n), np.diff(self.first))

    def tally(self, table: np.ndarray, width: int) -> np.ndarray:
        """How many bytes of each row the table gives each of 0..width-1, block by block."""
        out = np.zeros((self.n, width), np.int64)
        for a in range(0, len(self.data), CHUNK_BYTES):
            b = min(a + CHUNK_BYTES, len(self.data))
            row = np.repeat(np.arange(self.n), np.diff(np.clip(self.offsets, a, b)))
            out += np.bincount(row * width + table[self.data[a:b]], minlength=self.n * width).reshape(self.n, width)
        return out

    def classes(self) -> np.ndarray:
        return self.tally(CLASS, CLASSES + 1)[:, :CLASSES]

    def counted(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, count) of the known words (sorted hashes) in each row."""
        if not len(known):
            return (np.empty(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(known, self.words), len(known) - 1)
        held = known[at] == self.words
        cell, n = np.unique(self.row[held] * len(known) + at[held], return_counts=True)
        return cell // len(known), cell % len(known), n


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of each row of counts p from q; 0 where p is empty."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)) / 2
    return np.where(p.sum(axis=-1) > 0, np.sqrt(np.maximum(d, 0)), 0)


def words_distance(x: Piece, counted: tuple[np.ndarray, np.ndarray, np.ndarray], share: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's words from a language's: its common words (share > 0), and all others as one.

    Only words that a row holds are looked at; those that it doesn't hold add their share each.
    """
    row, at, n = counted
    own = share[at] > 0
    row, q, p = row[own], share[at[own]], n[own] / np.diff(x.first)[row[own]]

    def by_row(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=w, minlength=x.n)

    both = by_row(p * np.log2(2 * p / (p + q)) + q * np.log2(2 * q / (p + q)))
    p, q, absent = 1 - by_row(p), 1 - share.sum(), share.sum() - by_row(q)
    p = np.maximum(p, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(p > 0, p * np.log2(2 * p / (p + q)), 0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)
    return np.where(np.diff(x.first) > 0, np.sqrt(np.maximum(both + absent + rest, 0) / 2), 0)


def references(docs: DataFrame) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted hashes of the common words, and each language's counts of character classes and shares of these words.

    A language is a value of lang (null is one). Words are counted within tasks, then by Spark, by language and word over all
    documents; what is left after COMMON, LANGUAGE and MIN_REFERENCE is all that is collected: at most 1 / LANGUAGE languages
    of 1 / COMMON words each, whatever the corpus.
    """
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, class, word, n): a class's count has no word, a word's no class."""
        words: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        signs: dict[str, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for name, (own, n) in words.items():
                yield pa.record_batch({"lang": pa.array([name] * len(own), pa.string()), "class": pa.nulls(len(own), pa.int32()), "word": pa.array(signed(own)), "n": pa.array(n)})
            words.clear()

        for batch in batches:
            for piece in chunks(batch):
                names = piece.column("lang").dictionary_encode()
                x, lang = Piece(piece), np.asarray(names.indices)
                sign = x.classes()
                for i, name in enumerate(names.dictionary.to_pylist()):
                    have, m = words.get(name, (np.empty(0, np.uint64), np.empty(0, np.int64)))
                    own, n = np.unique(x.words[lang[x.row] == i], return_counts=True)
                    own, at = np.unique(np.concatenate([have, own]), return_inverse=True)
                    words[name] = own, np.bincount(at, weights=np.concatenate([m, n]), minlength=len(own)).astype(np.int64)
                    signs[name] = signs.get(name, 0) + sign[lang == i].sum(axis=0)
                if sum(len(own) for own, _ in words.values()) > TASK_WORDS:
                    yield from handed_on()
        yield from handed_on()
        for name, n in signs.items():
            yield pa.record_batch({"lang": pa.array([name] * CLASSES, pa.string()), "class": pa.array(np.arange(CLASSES, dtype=np.int32)), "word": pa.nulls(CLASSES, pa.int64()), "n": pa.array(n.astype(np.int64))})

    counts = written(rows.mapInArrow(count, "lang string, class int, word long, n long").groupBy("lang", "class", "word").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word is not null")
    every = words.agg(F.sum("n")).first()[0] or 0
    sizes = words.groupBy("lang").agg(F.sum("n").alias("size")).where((F.col("size") >= MIN_REFERENCE) & (F.col("size") >= LANGUAGE * every))
    held = counts.join(F.broadcast(sizes), "lang").where(F.col("class").isNotNull() | (F.col("n") >= COMMON * F.col("size"))).collect()
    known = np.sort(np.array(list({r.word for r in held if r.word is not None}), np.int64).view(np.uint64))
    place = {int(w): i for i, w in enumerate(signed(known))}
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in held:
        classes, share = out.setdefault(r.lang, (np.zeros(CLASSES), np.zeros(len(known))))
        if r.word is None:
            classes[r["class"]] = r.n
        else:
            share[place[r.word]] = r.n / r.size
    return known, [m for _, m in sorted(out.items())]


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, distances, verdicts) of docs (doc_id, text, lang); other columns are ignored.

    n_words; word_chars, code points in words; n_symbols of #*$%&|<>; n_dup_lines, lines with a word that equal an earlier
    line; n_repeat_words, words in 5-word windows found twice or more. base_failed: under 10 words, or over a fifth of
    them in such windows. chars_distance and words_distance: Jensen-Shannon distance to the closest language's reference (0
    for texts shorter than the guards). kept: neither base_failed nor beyond a limit. Null and empty texts have no words and fail.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    known, models = references(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                x = Piece(piece)
                n = np.diff(x.first)
                signs = x.tally(SIGN, 3)
                symbols, chars = signs[:, 1], signs[:, 1] + signs[:, 2]
                repeats = np.zeros(x.n, np.int64)
                if len(x.words) >= 5:
                    valid = x.row[:-4] == x.row[4:]
                    windows = Spans(x.words).every(5) ^ mix(x.row[:-4].astype(np.uint64) + np.uint64(1))
                    at = np.flatnonzero(valid)
                    _, which, m = np.unique(windows[at], return_inverse=True, return_counts=True)
                    at = at[m[which] > 1]
                    step = np.bincount(at, minlength=len(x.words) + 1) - np.bincount(at + 5, minlength=len(x.words) + 1)
                    repeats = np.bincount(x.row[np.cumsum(step)[:-1] > 0], minlength=x.n)
                lines = []
                for text in piece.column("text"):
                    own = [p for p in text.as_buffer().to_pybytes().split(b"\n") if p.split()]
                    lines.append(len(own) - len(set(own)))
                classes, words = x.classes(), x.counted(known)
                by_chars = np.min([distance(classes, c) for c, _ in models], axis=0) if models else np.zeros(x.n)
                by_words = np.min([words_distance(x, words, w) for _, w in models], axis=0) if models else np.zeros(x.n)
                by_chars[classes.sum(axis=1) < MIN_CHARS] = 0
                by_words[n < MIN_WORDS] = 0
                failed = (n < 10) | (100 * repeats > 20 * n)
                kept = ~failed & (by_chars <= MAX_CHARS) & (by_words <= MAX_WORDS)
                yield pa.record_batch([piece.column("doc_id"), *map(pa.array, (n.astype(np.int64), chars, symbols, np.array(lines, np.int64), repeats, failed, by_chars, by_words, kept))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_distance", "words_distance", "kept"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(judge, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_distance double, words_distance double, kept boolean")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules of all documents: a row for each row, equal rows judged alike; null texts have no words and fail."""
    return quality_rules(documents(spark, sf_dir))
