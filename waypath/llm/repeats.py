"""Repeated windows of bytes or words: the engine of the two substring deduplicators.

A window is `width` consecutive units of one document. It is *repeated* if the same units also start
anywhere else. Windows are far too many to shuffle, so they travel as runs:

1. Every window has an anchor: the least hash among its sub-windows of `gram` units. Equal windows have
   equal anchors, and neighbouring windows mostly share one, so there are about
   2 / (width - gram + 2) anchors a unit.
2. A count-min sketch of the anchors (made by task, merged by cell) overestimates how often each occurs;
   what it puts at one occurs once, and the windows under it are unique.
3. Consecutive windows with one anchor are a run. Runs that the sketch passes are grouped exactly by content:
   a run whose whole content occurs elsewhere is repeated throughout.
4. One run of each content, where its anchor has several contents, is expanded into its windows, which
   are grouped by a 64-bit hash of their whole content. These are the edges of repeated passages.

Nothing is lost: each step drops only windows known to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.llm.common import BASES, BYTE_CODES, Spans, chunks, looked_up, mix, signed, span_hashes, text_bytes, word_bounds, written

#: Cells of a sketch row are 2^SKETCH_BITS bits: with two rows 16 MB are broadcast, whatever the input's size.
SKETCH_BITS, SKETCH_ROWS, BLOCK_BITS = 26, 2, 16
TOP = np.uint64(2**64 - 1)


#: Units that one step hashes; a longer text is taken in stretches that overlap by a window less one unit.
STRETCH = 1_000_000


def units(data: np.ndarray, offsets: np.ndarray, of: str) -> tuple[np.ndarray, np.ndarray]:
    """A byte or a 64-bit code for each word, and the first unit of each row."""
    if of == "bytes":
        return data, offsets
    starts, ends, first = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), first


def coded(own: np.ndarray) -> np.ndarray:
    return BYTE_CODES[own] if own.dtype == np.uint8 else own


def sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each `width` neighbours, in linear time."""
    f, fill = (np.minimum, TOP) if least else (np.maximum, np.uint64(0))
    blocks = np.concatenate([a, np.full(-len(a) % width, fill, np.uint64)]).reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(a) - width + 1
    return f(back[:n], ahead[width - 1 : width - 1 + n])


class Anchored:
    """Anchors and runs of the rows of one chunk."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, width: int, gram: int):
        self.width, self.first = width, first
        span = width - gram + 1
        n = len(codes) - width + 1
        self.starts = self.ends = self.anchor = self.row = np.empty(0, np.int64)
        self.chosen = np.empty(0, np.uint64)
        self.itself = np.empty(0, bool)
        if n <= 0:
            return
        self.spans = Spans(codes)
        grams = self.spans.every(gram)
        least = sliding(grams, span, True)
        last = np.repeat(first[1:], np.diff(first))  # end of the row of each unit
        at = np.arange(n)
        valid = at + width <= last[:n]
        shown = np.where(valid, least, np.uint64(0))
        most = sliding(np.concatenate([np.zeros(span - 1, np.uint64), shown, np.zeros(span - 1, np.uint64)]), span, False)
        picked = np.flatnonzero((most == grams) & (most > 0))
        self.chosen = grams[picked]
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]))
        self.starts = np.flatnonzero(new)
        stop = valid.copy()
        stop[:-1] &= ~(valid[1:] & (least[1:] == least[:-1]))
        self.ends = np.flatnonzero(stop)  # the last window's start
        self.anchor = least[self.starts]
        self.row = np.searchsorted(first, self.starts, "right") - 1
        # a run in which the anchor occurs twice may repeat itself
        twice = np.flatnonzero((self.chosen[1:] == self.chosen[:-1]) & (np.diff(picked) <= span))
        a = np.searchsorted(picked[twice], self.starts)
        b = np.searchsorted(picked[twice + 1], self.ends + span - 1, "right")
        self.itself = b > a


def stretches(own: np.ndarray, first: np.ndarray, width: int, gram: int) -> Iterator[tuple[int, Anchored]]:
    """Anchors and runs of a chunk, with the place where each stretch starts.

    A stretch ends runs that go on in the next one, and shows an anchor of the overlap twice: the sketch only overestimates,
    and runs that differ by their ends are compared by their windows, so nothing is lost.
    """
    for at in range(0, max(1, len(own) - width + 1), STRETCH):
        end = min(len(own), at + STRETCH + width - 1)
        yield at, Anchored(coded(own[at:end]), np.clip(first - at, 0, end - at), width, gram)


def hashed(own: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows at `start` (ascending), stretch by stretch."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + STRETCH))
        codes = coded(own[start[i] : start[j - 1] + width])
        a = start[i:j] - start[i]
        out[i:j] = mix(Spans(codes).hash(a, a + width) ^ Spans(codes, BASES[1]).hash(a, a + width) >> np.uint64(1))
        i = j
    return out


def cells(anchor: np.ndarray, row: int) -> np.ndarray:
    h = anchor if row == 0 else anchor * np.uint64(0x9E3779B97F4A7C15) ^ (anchor >> np.uint64(29))
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def merged_sketch(docs: DataFrame, of: str, width: int, gram: int) -> list[bytes]:
    """One bit a cell, set where the merged sketch counts two or more."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's own sketch, as the occupied cells of each block."""
        for batch in batches:
            found = []
            for piece in chunks(batch):
                data, offsets = text_bytes(piece.column("text"))
                found += [x.chosen for _, x in stretches(*units(data, offsets, of), width, gram)]
            if not found or not len(anchors := np.concatenate(found)):
                continue
            for row in range(SKETCH_ROWS):
                c, n = np.unique(cells(anchors, row), return_counts=True)
                c = np.repeat(c, np.minimum(n, 2))
                block = c >> BLOCK_BITS
                cut = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
                low = (c & (2**BLOCK_BITS - 1)).astype(np.uint16)
                yield pa.record_batch({"block": pa.array((block[cut[:-1]] * SKETCH_ROWS + row).astype(np.int32)), "cells": pa.array([low[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(np.frombuffer(low, np.uint16), minlength=2**BLOCK_BITS)
                have = counts.get(block)
                counts[block] = np.minimum(n if have is None else n + have, 2).astype(np.uint8)
        for block, n in counts.items():
            if (n > 1).any():
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(n > 1).tobytes()], pa.binary())})

    sketch = docs.select("text").mapInArrow(part, "block int, cells binary").repartition("block").mapInArrow(merge, "block int, bits binary")
    rows = [np.zeros(2 ** (SKETCH_BITS - 3), np.uint8) for _ in range(SKETCH_ROWS)]
    size = 2 ** (BLOCK_BITS - 3)
    for block, bits in sketch.collect():  # at most SKETCH_ROWS * 2^(SKETCH_BITS - 3) bytes
        b = block // SKETCH_ROWS
        rows[block % SKETCH_ROWS][b * size : (b + 1) * size] = np.frombuffer(bits, np.uint8)
    return [r.tobytes() for r in rows]


def passes(sketch: list[bytes], anchor: np.ndarray) -> np.ndarray:
    ok = np.ones(len(anchor), bool)
    for row, bits in enumerate(sketch):
        c = cells(anchor, row)
        ok &= (np.frombuffer(bits, np.uint8)[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def row_key():
    """One 64-bit value for a row, all that the shuffles of runs and windows carry of it."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def repeated(docs: DataFrame, of: str, width: int, gram: int) -> DataFrame:
    """Unit ranges of docs (doc_id, text) covered by repeated windows: (t, ranges).

    t is row_key(); ranges holds [from, to) pairs as from * 2^32 + to, unsorted, possibly overlapping.
    Rows without a repeated window are absent. Two rows with the same doc_id and text repeat each other.
    """
    docs = docs.select("doc_id", row_key().alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = docs.sparkSession.sparkContext.broadcast(merged_sketch(docs, of, width, gram))

    def pair(last: str) -> Column:
        """From `lo` to the end of the window that starts at `last`."""
        return (F.shiftleft(F.col("lo").cast("long"), 32) + F.col(last) + width).alias("range")

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                data, offsets = text_bytes(piece.column("text"))
                own, first = units(data, offsets, of)
                for begin, x in stretches(own, first, width, gram):
                    keep = np.flatnonzero(x.itself | passes(sketch.value, x.anchor)) if len(x.starts) else x.starts
                    if not len(keep):
                        continue
                    lo, hi, row = x.starts[keep], x.ends[keep], x.row[keep]
                    content = Spans(coded(own[begin : begin + STRETCH + width - 1]), BASES[1]).hash(lo, hi + width)
                    base = first[row] - begin
                    ids = piece.column("t").take(pa.array(row))
                    yield pa.record_batch([ids, *(pa.array(v) for v in (signed(x.anchor[keep]), signed(content), (lo - base).astype(np.int32), (hi - base).astype(np.int32), x.itself[keep]))], names=["t", "anchor", "content", "lo", "hi", "itself"])

    texts = docs.select("t", "text")
    runs = written(texts.mapInArrow(runs_of, "t long, anchor long, content long, lo int, hi int, itself boolean"), "runs")
    one = F.min(F.struct("t", "lo", "hi")).alias("one")
    contents = written(runs.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.max("itself").alias("itself"), one), "contents")
    whole = looked_up(runs.drop("itself"), contents.where("n > 1").select("anchor", "content", "n"), ["anchor", "content"], "n", "left_semi").select("t", pair("hi"))
    varied = written(contents.groupBy("anchor").agg(F.count("*").alias("m"), F.max("itself").alias("itself")).where("m > 1 or itself").select("anchor", "m"), "varied")
    edges = looked_up(contents.drop("itself"), varied, ["anchor"], "m", "left_semi").select("one.*", (F.col("n") > 1).alias("known"))

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                data, offsets = text_bytes(piece.column("text"))
                own, first = units(data, offsets, of)
                at = piece.column("at").flatten()
                lo, hi, known = (np.asarray(at.field(k)) for k in range(3))
                row = np.repeat(np.arange(piece.num_rows), np.diff(np.asarray(piece.column("at").offsets)))
                order = np.lexsort((lo, row))
                lo, hi, known, row = (v[order] for v in (lo, hi, known, row))
                ready = np.cumsum(hi - lo + 1)
                cuts = np.unique(np.searchsorted(ready, np.arange(0, ready[-1] + 200_000, 200_000) if len(ready) else []))
                for i, j in zip(cuts, [*cuts[1:], len(lo)]):
                    n = hi[i:j] - lo[i:j] + 1
                    own_row = np.repeat(row[i:j], n)
                    start = np.repeat(first[row[i:j]] + lo[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    up = np.argsort(start, kind="stable")
                    a = np.empty(len(start), np.uint64)
                    a[up] = hashed(own, start[up], width)
                    _, one, which, m = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
                    m = np.where(m[which] == 1, 1, np.where(one[which] == np.arange(len(a)), 2, 0))  # the first of equal windows stands for all
                    yield pa.record_batch([piece.column("t").take(pa.array(own_row)), pa.array(signed(a)), pa.array((start - first[own_row]).astype(np.int32)), pa.array(np.repeat(known[i:j], n)), pa.array(m.astype(np.int8))], names=["t", "a", "lo", "known", "n"])

    at = edges.groupBy("t").agg(F.collect_list(F.struct("lo", "hi", "known")).alias("at"))
    # Not written: the texts' exchange serves both uses of the windows and the caller's own join with ranges.
    windows = same_doc(docs, at, "inner").mapInArrow(windows_of, "t long, a long, lo int, known boolean, n tinyint")
    twice = windows.where("n > 0").groupBy("a").agg(F.sum("n").alias("m")).where("m > 1").select(F.col("a").alias("b"))
    # Windows found twice in one step need no partner, so they are spread: a window of very many texts is no one task's work.
    asked = windows.where("not known").withColumn("a", F.when(F.col("n") == 1, F.col("a")).otherwise(F.xxhash64("t", "lo")))
    single = asked.join(twice, F.col("a") == F.col("b"), "left").where("n <> 1 or b is not null").select("t", pair("lo"))
    # A set: rows with one t hand on the same ranges.
    return whole.unionByName(single).groupBy("t").agg(F.collect_set("range").alias("ranges"))


def same_doc(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """docs joined with other on row_key()."""
    return docs.join(other, "t", how)


def covered(ranges: np.ndarray | None, n: int) -> np.ndarray:
    """Which of n units lie in one of the ranges."""
    if ranges is None or not len(ranges):
        return np.zeros(n, bool)
    step = np.bincount(ranges >> 32, minlength=n + 1) - np.bincount(ranges & 0xFFFFFFFF, minlength=n + 1)
    return np.cumsum(step[:n]) > 0
