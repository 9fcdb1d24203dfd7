"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.llm.common import BLANKS, documents, written

#: Weights of the sources in order, repeating; the share of all words that the mix holds; times that a source may be used.
WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2


def n_words() -> Column:
    """Words of text: runs of characters other than the six blanks. Null: 0."""
    inner = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, BLANKS))).otherwise(0).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, number, source_size, n, target) of rows with source and size.

    Sources in order of code points, null last, get the weights in turn, and share `total` times all sizes by
    weight. None gets over `most` times its own size; what is over goes to the others by weight. Sources in
    order of limit a weight reach their limits one after the other, so running sums settle all of it.
    """
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    one = one.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1).cast("double"))
    one = one.withColumn("limit", F.col("source_size") * float(most))
    all_, rising = W.partitionBy(), W.orderBy(F.col("limit") / F.col("weight"), "number")
    so_far = rising.rowsBetween(W.unboundedPreceding, 0)
    words = F.sum("source_size").over(all_) * total
    level = (words - F.sum("limit").over(so_far) + F.col("limit")) / (F.sum("weight").over(all_) - F.sum("weight").over(so_far) + F.col("weight"))
    one = one.withColumns({"words": words, "full": F.col("limit") <= F.col("weight") * level})
    left = F.col("words") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(all_)
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * left / open_))
    return one.select("source", "number", "source_size", "n", target.alias("target"))


def text_digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def mix_sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, digest, size, source_size, target, taken) of the rows of sized (doc_id, source, size, digest of the text).

    taken is how many words the mix takes of a document, repeats counted. Each source is used in whole epochs as often as its target
    holds its size; the rest is a prefix of a random order (52 bits of a hash of doc_id and digest), cut at the exact word.
    A source's order is cut in about sqrt(rows) ranges of the hash; sums by range, then by row within a
    range, make the prefix sums, so no task orders a whole source. Reruns agree. Rows without words take nothing; a null
    source is a source; null doc_ids and repeated rows are rows like others (equal rows may take different amounts).
    An empty table gives an empty result. Other columns of sized are left out, so none can clash, but for those in carry.
    """
    sized = sized.select("doc_id", "source", "size", "digest", *carry)
    goal = written(targets(sized, weights, total, most), "targets")
    by_source = goal.withColumnRenamed("source", "_source")
    draw = F.conv(F.substr(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest").cast("binary")), F.lit(1), F.lit(13)), 16, 10).cast("long")
    ranges = F.ceil(F.sqrt("n"))
    rows = sized.withColumn("draw", draw).join(by_source, sized["source"].eqNullSafe(by_source["_source"])).drop("_source")
    rows = rows.withColumn("range", F.floor(F.col("draw") / F.lit(2.0**52) * ranges))
    before = rows.groupBy("number", "range").agg(F.sum("size").alias("own"))
    before = before.select("number", "range", (F.sum("own").over(W.partitionBy("number").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("own")).alias("before"))
    rows = rows.join(written(before, "ranges"), ["number", "range"])
    running = F.sum("size").over(W.partitionBy("number", "range").orderBy("draw", "doc_id", "digest", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - running))
    return rows.select("doc_id", "digest", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words().alias("size"), text_digest().alias("digest"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs' columns, each document as often as the mix uses it (a part counts as one use); unused ones go.

    All columns stay, whatever their names; nulls, empty texts and repeated rows as in mix_sources.
    """
    whole = docs.select("doc_id", "source", n_words().alias("size"), text_digest().alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    rows = mix_sources(whole, carry=("whole",)).where("taken > 0")
    return rows.select("whole", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))).select("whole.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sources of all documents: a row for each row; of equal rows each takes what its place in the order gives it."""
    rows = written(sized(documents(spark, sf_dir)), "sizes")
    return mix_sources(rows).select("doc_id", "size", "source_size", "target", "taken")
