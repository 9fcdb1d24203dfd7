"""A training corpus from raw documents: five stages, each written and read again by the caller or by run().

All but the last keep the columns of documents, whatever they are called, and rows with nulls, empty texts or equals elsewhere unless
the stage's own rule takes them. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waypath.llm import decontaminate, mixing, near_copies, tokens, toxicity
from waypath.llm.common import small_batches, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model fitted on the labels outside the held-out fold. Texts without a finding stay, null ones too."""
    return toxicity.drop_toxic(docs, toxicity.trained(docs.select("doc_id", "text"), spark, sf_dir))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: op8's SimHash fingerprints within four bits, or five-word shingles of a Jaccard similarity of at least 0.8.

    The least doc_id stays (null last); all texts without words are one group.
    """
    return near_copies.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; a document that is nothing else goes."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources uses it; those without words are not used."""
    return mixing.mixed(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, as read back: doc_id, start, n_tokens, ids_crc32, a row for each row, repeated ones too.

    Rows are in the files by doc_id (null first), equal ones by a hash of the text; null and empty texts are the end id alone.
    """
    small_batches(spark)
    return tokens.token_shards(docs, tokens.default_tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_shards", as_tokens),
]

#: Fingerprints, a fitted model and a tokenizer are beyond SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
