"""Filter interaction audit: what each filter removes under every order in which the filters can be applied.

A document's failures are a mask of bits. Documents of one part, mask and set of labels are one class with a count, so Spark hands
on at most 2^filters classes a part. Of each part numpy takes the matrix of its classes (0 where a class fails a filter, a
number beyond all steps elsewhere) and the matrix of orders (the place of each filter, the inverse of the order) and combines them by
min-plus: the least sum over the filters is the step that removes the class. Counts are scattered to these steps.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import BLANKS, documents, looked_up, written

#: Filters that all orders of are listed: 5,040 orders of seven.
MOST_FILTERS = 7
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def places(names: str) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and the place of each filter (column) in each order (row)."""
    orders = ["".join(p) for p in permutations(names)]
    return orders, np.array([[order.index(x) for x in names] for order in orders])


def removal_steps(fails: np.ndarray, place: np.ndarray) -> np.ndarray:
    """[class, order] the step from 0 at which a class goes; the number of filters where it stays. Min-plus of the two matrices, filter by filter."""
    n = place.shape[1]
    step = np.full((len(fails), len(place)), n)
    for f in range(n):
        np.minimum(step, np.where(fails[:, f], 0, n)[:, None] + place[:, f][None, :], out=step)
    return step


def interactions(fails: np.ndarray, weights: dict[str, np.ndarray], names: str) -> pd.DataFrame:
    """The report of one part: fails [class, filter], weights n, good and toxic (integers) of the classes."""
    orders, place = places(names)
    k, step = len(names), removal_steps(fails, place)
    chosen = np.argsort(place, axis=1)  # [order, step] the filter

    def scattered(w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(orders), k + 1), np.int64)
        np.add.at(out, (np.arange(len(orders))[None, :], step), w[:, None])
        return out[:, :k]

    n = weights["n"]
    removed = scattered(n)
    redundant = np.zeros_like(removed)
    for f in range(k):
        late = fails[:, f][:, None] & (step < place[:, f][None, :])
        redundant[np.arange(len(orders)), place[:, f]] = (late * n[:, None]).sum(axis=0)
    alone = fails.sum(axis=1) == 1
    unique = np.array([n[alone & fails[:, f]].sum() for f in range(k)], np.int64)
    shapley = np.zeros(k, np.int64)
    np.add.at(shapley, chosen, removed)
    return pd.DataFrame({
        "filter_order": np.repeat(orders, k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
        "kept": (n.sum() - removed.cumsum(axis=1)).ravel(), "removed": removed.ravel(), "redundant": redundant.ravel(),
        "unique_fails": unique[chosen].ravel(), "good_lost": scattered(weights["good"]).ravel(), "toxic_lost": scattered(weights["toxic"]).ravel(), "shapley": shapley[chosen].ravel(),
    })


def audit(rows: DataFrame, names: str) -> DataFrame:
    """REPORT of rows (part, mask, good, toxic): for each part, each order of the filters and each step.

    names has a letter a filter; bit i of mask is set where the document fails filter i. good and toxic are booleans of the
    labels. A null part is the empty one; a null mask fails nothing, a null label is false. Repeated rows count each. A part that no
    filter touches has its rows too, with zeros; an empty table gives no rows. Other columns are left out.
    """
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"one to {MOST_FILTERS} filters, a letter each")
    part = F.coalesce(F.col("part"), F.lit("")).alias("part")
    classes = rows.groupBy(part, F.coalesce(F.col("mask"), F.lit(0)).cast("int").alias("mask"))
    classes = classes.agg(F.count("*").alias("n"), *(F.coalesce(F.count_if(F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")))

    def report(classes: pd.DataFrame) -> pd.DataFrame:
        fails = (classes["mask"].to_numpy()[:, None] >> np.arange(len(names)) & 1).astype(bool)
        out = interactions(fails, {c: classes[c].to_numpy(np.int64) for c in ("n", "good", "toxic")}, names)
        out.insert(0, "part", classes["part"].iloc[0])
        return out

    return classes.groupBy("part").applyInPandas(report, REPORT)


def mask_of(fails: list[Column]) -> Column:
    """Bit i is set where fails[i] holds; null is no failure."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def text_failures(text: Column) -> list[Column]:
    """A: under 200 words; B: under half of the words are distinct; C: over 3 % capitals; D: a sign of technical junk."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    # An array of one names the words, so that they are split once.
    words = F.transform(F.array(F.when(F.length(inner) > 0, F.split(inner, BLANKS)).otherwise(F.array().cast("array<string>"))), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]++", ""))
    return [words["n"] < 200, F.lit(100) * words["distinct"] < F.lit(50) * words["n"], F.lit(100) * capitals.cast("long") > F.lit(3) * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def repeats_earlier(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest and others), with `again`: the text stands under a smaller doc_id too.

    A null doc_id is neither smaller nor greater than any; equal doc_ids don't repeat each other. rows are read twice.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return looked_up(rows, written(first, "firsts"), ["digest"], "copies", "left").withColumn("again", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("first_id")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether any label of the doc_id has quality 1, or toxic 1. Rows without a doc_id have no label."""
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    one = one.withColumn("_spread", F.lit(0).cast("long"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "lang", F.monotonically_increasing_id())).otherwise(F.lit(0))  # many null doc_ids are no one task's rows
    own = rows.withColumn("_spread", spread)
    out = own.join(one, (own["doc_id"] == one["_id"]) & (own["_spread"] == one["_spread"]), "left")
    return out.select(*(rows.columns), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def judged(docs: DataFrame, failures: Callable[[Column], list[Column]] = text_failures) -> DataFrame:
    """(doc_id, lang, digest, mask) of docs: the filters on a text alone, and a digest of the text. A null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "lang", F.unhex(F.sha2(text, 256)).alias("digest"), mask_of(failures(text)).alias("mask"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of five filters by language: A to D of text_failures, E a text that a smaller doc_id has too.

    docs needs doc_id, text and lang, labels doc_id, quality and toxic; other columns are ignored, whatever their names. The texts are read
    once; what goes on is 32 bytes of digest and a mask a row, written in the shared folder. Null and empty texts are one text, a null lang is
    the empty part, repeated rows (equal doc_id and text) fail E only if a smaller doc_id has the text. Empty tables give no rows.
    """
    rows = repeats_earlier(written(judged(docs), "masks"))
    rows = labelled(rows.withColumn("mask", F.col("mask").bitwiseOR(F.when(F.col("again"), F.lit(16)).otherwise(F.lit(0)))), labels)
    return audit(rows.select(F.col("lang").alias("part"), "mask", "good", "toxic"), "ABCDE")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit_documents of all documents and labels."""
    return audit_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
