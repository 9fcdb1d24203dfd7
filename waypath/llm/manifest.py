"""Merkle manifest of a table: a digest a row, a tree a source, a tree over the sources, and proofs that tie each row to the root.

A tree takes its nodes in order; while it has several, each ARITY consecutive ones (the last run may be shorter, even one) become
the digest of their digests. The trees are grown in superblocks of ARITY^HEIGHT consecutive nodes, so a source of any size is many
groups: each group is reduced alone to one node of the next stage, and stages follow until a tree has one node (three stages
hold 10^10 rows of one source). On the way back the nodes of a stage are cogrouped by superblock with what their
superblock needs from outside: the runs of nodes on its path to the root. That one step redoes the group's own levels, joins them with the outer
path, and folds (possibly changed) nodes up to the root.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.llm.common import documents, fresh, written

ARITY, HEIGHT = 3, 7
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range of the order in which leaves are numbered, once there are more than Spark's own partitions take.
RANGE_ROWS = 1_000_000
PATH = "array<array<string>>"


class Manifest(NamedTuple):
    """Written tables. leaves: tree, n, block, place, doc_id (a string), source, node and what else they carry. outer: for each superblock of leaves its path to
    the root, with subroot and root. subroots: source, leaves, subroot. root: one row (none for an empty table)."""

    leaves: DataFrame
    outer: DataFrame
    subroots: DataFrame
    root: DataFrame


def field(c: Column) -> Column:
    """`-` if null, else its length in bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of a row's fields; text in place of the column of that name, if given."""
    return F.sha2(F.concat(*(field(text if text is not None and c == "text" else F.col(c)) for c in fields)), 256)


def digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def runs(nodes: list[str]) -> list[list[str]]:
    return [nodes[i : i + ARITY] for i in range(0, len(nodes), ARITY)]


def levels(nodes: list[str], alone: bool, height: int) -> list[list[str]]:
    """The levels of a group: `height` of them above its nodes, or until one node remains where the group is all of its tree."""
    out = [nodes]
    while len(out[-1]) > 1 if alone else len(out) <= height:
        out.append([digest(run) for run in runs(out[-1])])
    return out


def ways(group: list[list[str]]) -> list[list[list[str | None]]]:
    """Of each node of the first level its runs, level by level, with None in its own place."""
    out = []
    for i in range(len(group[0])):
        way = []
        for level in group[:-1]:
            start = i - i % ARITY
            way.append([None if k == i else level[k] for k in range(start, min(start + ARITY, len(level)))])
            i //= ARITY
        out.append(way)
    return out


def fold(node: str, way: list[list[str | None]]) -> str:
    """The root that a node leads to along its runs."""
    for run in way:
        node = digest([node if x is None else x for x in run])
    return node


def numbered(rows: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """rows (written) with place, their number from 0 in the order within `by`, and n, how many there are.

    Rows are dealt in ranges of (by, order) and each range counts alone; a running sum over the ranges makes places. No task
    orders a whole `by`. Rows that are equal in the order are dealt by an extra key, so many equal ones are no one task's.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    tie, part, before, own = (fresh(x, rows) for x in ("_tie", "_part", "_before", "_own"))
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, F.col(by), *order, F.col(tie))
    dealt = written(dealt.withColumn(part, F.spark_partition_id()), name)
    counts = dealt.groupBy(by, part).agg(F.count("*").alias(own))
    whole = W.partitionBy(by)
    counts = counts.select(by, part, (F.sum(own).over(whole.orderBy(part).rowsBetween(W.unboundedPreceding, 0)) - F.col(own)).alias(before), F.sum(own).over(whole).alias("n"))
    inside = F.row_number().over(W.partitionBy(by, part).orderBy(*order, tie)) - 1
    placed = dealt.withColumn("place", inside.cast("long")).join(counts, [by, part])
    return placed.withColumn("place", F.col("place") + F.col(before)).drop(tie, part, before)


def block_of(place: str, height: int) -> Column:
    return F.floor(F.col(place) / F.lit(ARITY**height)).cast("long")


def grown(leaves: DataFrame, height: int, most: int) -> list[DataFrame]:
    """Stages of nodes (tree, n, block, place, node), from the leaves on until each tree has one node. most: leaves of the largest tree."""

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        n, block = int(group["n"].iloc[0]), int(group["block"].iloc[0])
        top = levels(group["node"].tolist(), n <= ARITY**height, height)[-1]
        return pd.DataFrame({"tree": [group["tree"].iloc[0]], "n": [-(-n // ARITY**height)], "place": [block], "node": top})

    stages = [leaves.select("tree", "n", "block", "place", "node")]
    while True:
        above = stages[-1].groupBy("tree", "block").applyInPandas(reduce, "tree string, n long, place long, node string")
        stages.append(written(above.withColumn("block", block_of("place", height)), "nodes"))
        if most <= ARITY**height:
            return stages
        most = -(-most // ARITY**height)


def descended(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """(tree, place, node, path and what outer says of the tree) of nodes, cogrouped by superblock with their outer nodes."""
    said = [c for c in outer.columns if c not in ("tree", "block", "path")]
    kinds = dict(outer.dtypes)

    def join(group: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        own = ways(levels(group["node"].tolist(), int(group["n"].iloc[0]) <= ARITY**height, height))
        rest = [list(run) for run in out["path"].iloc[0]]
        return pd.DataFrame({"tree": group["tree"], "place": group["place"], "node": group["node"], "path": [way + rest for way in own], **{c: out[c].iloc[0] for c in said}})

    schema = f"tree string, place long, node string, path {PATH}" + "".join(f", {c} {kinds[c]}" for c in said)
    return nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(join, schema)


def outer_paths(stages: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """(tree, block, path, ...) for each superblock of the first stage. outer: the same for the one node of each tree, as block 0."""
    for stage in stages[-2:0:-1]:
        outer = written(descended(stage, outer, height).withColumnRenamed("place", "block").drop("node"), "outer")
    return outer


def most_of(rows: DataFrame) -> int:
    return rows.agg(F.max("n")).first()[0] or 0


def build_manifest(docs: DataFrame, height: int = HEIGHT, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs, a leaf a row.

    docs needs doc_id, source, lang, n_chars and text; other columns are ignored, whatever their names, but for those that carry
    names (columns made of docs and kept beside the leaf). Leaves ascend by doc_id, null first; of rows with one doc_id by their digests, so
    reruns agree, and equal rows take neighbouring places. Null and empty are different values, a null source is a source of its own,
    before the others. An empty table has no root. Texts are read once; only digests go on.
    """
    carry = carry or {}
    if taken := {"tree", "doc_id", "source", "node", "n", "place", "block"} & {c.lower() for c in carry}:
        raise ValueError(f"carried columns need other names than {sorted(taken)}")
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    rows = docs.select(tree.alias("tree"), "doc_id", "source", leaf().alias("node"), *(c.alias(k) for k, c in carry.items()))
    leaves = numbered(written(rows, "digests"), "tree", [F.col("doc_id").asc_nulls_first(), F.col("node")], "leaves")
    leaves = written(leaves.withColumns({"block": block_of("place", height), "doc_id": F.col("doc_id").cast("string")}), "leaves")
    stages = grown(leaves, height, most_of(leaves))
    tops = stages[-1].select("tree", F.col("node").alias("subroot"))
    counted = leaves.where("place = 0").select("tree", "source", F.col("n").alias("leaves"))
    subroots = written(tops.join(counted, "tree"), "subroots")
    forest = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("subroot").alias("node"))
    forest = written(numbered(forest, "tree", [F.col("own")], "forest").withColumn("block", block_of("place", height)), "forest")
    above = grown(forest, height, most_of(forest))
    root = above[-1].select(F.col("node").alias("root"))
    empty = F.array().cast(PATH)
    paths = descended(above[0], outer_paths(above, above[-1].select("tree", F.lit(0).cast("long").alias("block"), empty.alias("path"), F.col("node").alias("root")), height), height)
    placed = forest.select(F.col("own").alias("tree"), F.col("place").alias("_place")).join(paths.withColumnRenamed("tree", "_tree"), F.col("_place") == F.col("place"))
    outer = written(placed.select("tree", F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"), "root"), "outer")
    return Manifest(leaves, outer_paths(stages, outer, height), subroots.drop("tree"), root)


def proved(manifest: Manifest, show: Callable[[list, str, str, dict], dict], columns: str, height: int = HEIGHT) -> DataFrame:
    """A row a leaf: the columns (a schema) that show(path, subroot, root, the leaf's record) gives.

    The superblock exchange: leaves and the outer nodes of their superblock meet in one group of ARITY^height leaves.
    """
    kept = [c for c in manifest.leaves.columns if c not in ("tree", "n", "block", "place")]

    def join(group: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        own = ways(levels(group["node"].tolist(), int(group["n"].iloc[0]) <= ARITY**height, height))
        rest = [list(run) for run in out["path"].iloc[0]]
        subroot, root = out["subroot"].iloc[0], out["root"].iloc[0]
        records = group[kept].to_dict("records")
        return pd.DataFrame([show(way + rest, subroot, root, r) for way, r in zip(own, records)])

    return manifest.leaves.groupBy("tree", "block").cogroup(manifest.outer.groupBy("tree", "block")).applyInPandas(join, columns)


def proofs(manifest: Manifest, height: int = HEIGHT) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path): path has the runs of nodes from the leaf to the root, null in the leaf's own place.

    doc_id is a string, whatever it was; fold(leaf, path) is the root.
    """

    def show(path, subroot, root, r):
        return {"doc_id": r["doc_id"], "source": r["source"], "leaf": r["node"], "subroot": subroot, "root": root, "path": path}

    return proved(manifest, show, f"doc_id string, source string, leaf string, subroot string, root string, path {PATH}", height)


def write_manifest(manifest: Manifest, path: str, height: int = HEIGHT) -> None:
    """The manifest in a folder: proofs, subroots and root, as Parquet tables."""
    proofs(manifest, height).write.parquet(f"{path}/proofs")
    manifest.subroots.write.parquet(f"{path}/subroots")
    manifest.root.write.parquet(f"{path}/root")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, subroots, root and digests of the proofs of all documents, and whether each row still leads to the root once it has been tampered with.

    Rows whose doc_id has an even crc32 lose the line ends of their text; those without a doc_id, or with none to lose, stay as they are.
    """
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    other = F.when(even & F.contains("text", F.lit("\n")), leaf(F.replace("text", F.lit("\n"), F.lit(""))))
    manifest = build_manifest(documents(spark, sf_dir), carry={"changed": other})

    def show(path, subroot, root, r):
        folded = fold(r["changed"] if isinstance(r["changed"], str) else r["node"], path)
        siblings = [x for run in path for x in run if x is not None]
        return {"doc_id": r["doc_id"], "leaf": r["node"], "subroot": subroot, "root": root, "proof_sha256": digest(siblings), "folded_root": folded, "verified": folded == root}

    rows = proved(manifest, show, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
