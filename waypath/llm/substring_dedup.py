"""Removal of passages that occur more than once: by bytes (suffix ranges) and by words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import documents
from waypath.llm.repeats import covered, repeated, row_key, same_doc

#: A repeated byte string of this length goes; anchors are sub-strings of BYTE_GRAM bytes.
MIN_BYTES, BYTE_GRAM = 400, 304
#: A repeated window of this many words goes; anchors are sub-windows of WORD_GRAM words.
MIN_WORDS, WORD_GRAM = 35, 24


def _kept(docs: DataFrame, of: str, width: int, gram: int, with_text: bool) -> DataFrame:
    rows = docs.select("doc_id", row_key().alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    found = same_doc(rows, repeated(docs, of, width, gram), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                raw, gone = text.as_buffer().to_pybytes(), ranges.values
                if of == "words":
                    own: bytes | list[bytes] = raw.split()
                    n = len(own)
                else:
                    own, n = raw, len(raw)
                mask = covered(None if gone is None else np.asarray(gone), n)
                removed = int(mask.sum())
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                if of == "words":
                    kept = b" ".join(compress(own, ~mask) if removed else own)
                else:
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes() if removed else raw
                out.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            n, removed, spans, digest, kept = zip(*out) if out else ((),) * 5
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "ranges").mapInArrow(cut, f"doc_id {kind}, n long, n_removed long, n_spans long, kept_sha256 string, kept string")


def drop_repeated_bytes(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = BYTE_GRAM, with_text: bool = True) -> DataFrame:
    """Removes each byte covered by a string of min_bytes bytes that also starts anywhere else in docs.

    docs needs doc_id and text; other columns are ignored. Matches stay within a document; both copies go.
    Null and empty texts have no bytes. A row repeated whole counts as two documents. Texts shorter than
    min_bytes lose nothing. An empty table gives an empty result. `kept` is what remains (a cut inside a
    character leaves U+FFFD there; kept_sha256 is of the exact bytes).
    """
    return _kept(docs, "bytes", min_bytes, gram, with_text)


def drop_repeated_words(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = WORD_GRAM, with_text: bool = True) -> DataFrame:
    """Removes each word covered by a window of min_words words whose sequence also starts anywhere else.

    Words are runs of non-blank characters, unchanged. Null, empty and blank texts have none; shorter texts
    lose nothing; a row repeated whole counts as two documents. Empty table: empty result.
    """
    return _kept(docs, "words", min_words, gram, with_text)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_repeated_bytes of all documents: a row for each row; rows repeated whole remove each other."""
    return drop_repeated_bytes(documents(spark, sf_dir), with_text=False).select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_repeated_words of all documents: a row for each row; rows repeated whole remove each other."""
    return drop_repeated_words(documents(spark, sf_dir), with_text=False).select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")
