"""Benchmark decontamination with an FM-index per shard of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import chunks, documents, fresh, small_batches, span_hashes, text_bytes, word_bounds, written

WINDOW = 10
#: Text of benchmark items that one pass over the documents looks for. A larger benchmark is searched block by block.
BLOCK_BYTES = 4_000_000
#: Every SAMPLE-th text position of a shard is stored; others are found by walking back to one.
SAMPLE = 8
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
OTHER = np.ones(256, bool)
OTHER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte start and byte end (within its row) of each lower-cased word, and each row's first word."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, OTHER)
    base = np.repeat(offsets[:-1], np.diff(first))
    return span_hashes(data, starts, ends), starts - base, ends - base, first


class Wavelet:
    """Rank of any symbol before any position, in one step a bit of the alphabet."""

    def __init__(self, a: np.ndarray, bits: int):
        self.levels = []
        for k in range(bits - 1, -1, -1):
            bit = (a >> k & 1).astype(bool)
            self.levels.append((k, np.concatenate([[0], np.cumsum(bit)]), int((~bit).sum())))
            a = np.concatenate([a[~bit], a[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        start = np.zeros_like(end)
        for k, ones, zeros in self.levels:
            up = (symbol >> k & 1).astype(bool)
            start, end = (np.where(up, zeros + ones[i], i - ones[i]) for i in (start, end))
        return end - start


class FMIndex:
    """Full-text index over symbols >= 1; symbol 0 ends the text."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        rank, step = text, 1
        while True:  # suffix order by doubling
            key = rank * (n + int(rank.max()) + 2) + np.append(rank[step:], np.full(min(step, n), -1)) + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) > 0]))
            if rank.max() == n - 1:
                break
            step *= 2
        self.n, self.last = n, text[order - 1]
        size = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.ranks = Wavelet(self.last, max(1, (size - 1).bit_length()))
        self.marked = order % sample == 0
        self.at = np.cumsum(self.marked) - 1
        self.places = order[self.marked]

    def back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.ranks.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of one length (a row each): the numbers of those that occur, and their ranges of suffixes."""
        alive, low, high = np.arange(len(phrases)), np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            known = symbol < len(self.before) - 1
            alive, low, high, symbol = alive[known], low[known], high[known], symbol[known]
            low, high = self.back(symbol, low), self.back(symbol, high)
            alive, low, high = (v[low < high] for v in (alive, low, high))
        return alive, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, from the nearest stored one before each."""
        row, steps, todo = row.copy(), np.zeros(len(row), np.int64), np.arange(len(row))
        while len(todo := todo[~self.marked[row[todo]]]):
            row[todo] = self.back(self.last[row[todo]], row[todo])
            steps[todo] += 1
        return self.places[self.at[row]] + steps


class Phrases:
    """The windows of a block of benchmark items, coded by the block's own vocabulary."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        hashes, _, _, first = hashed_words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = np.unique(hashes)
        codes = np.searchsorted(self.vocabulary, hashes) + 2  # 0 ends the text, 1 parts its runs
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for i, (a, b) in enumerate(zip(first, first[1:])):
            width = min(window, b - a)
            for s in range(a, b - width + 1) if width else ():
                found.setdefault(int(width), {}).setdefault(tuple(codes[s : s + width].tolist()), set()).add(i)
        self.by_width = {w: (np.array(list(x), np.int64), [sorted(i) for i in x.values()]) for w, x in found.items()}
        self.ids = [i for i, _ in items]

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 0)

    def occurrences(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[list[int]], np.ndarray]]:
        """(word positions, width, items of each phrase, phrase of each position) in a shard.

        Only runs of known words as long as the shortest phrase can hold one, so these alone are indexed.
        """
        known = codes > 0
        edge = np.zeros(len(codes) + 1, bool)
        edge[first] = True
        begins = np.flatnonzero(known & np.concatenate([[True], ~known[:-1]])[: len(codes)] | known & edge[:-1])
        ends = np.flatnonzero(known & (np.concatenate([~known[1:], [True]])[: len(codes)] | edge[1:])) + 1
        keep = ends - begins >= min(self.by_width)
        begins, ends = begins[keep], ends[keep]
        if not len(begins):
            return
        size = ends - begins + 1
        place = np.repeat(begins - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        text = codes[np.minimum(place, len(codes) - 1)]
        text[np.cumsum(size) - 1] = 1
        index = FMIndex(text)
        for width, (phrases, items) in self.by_width.items():
            which, low, high = index.search(phrases)
            n = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            yield place[index.locate(rows)], width, items, np.repeat(which, n)


def n_blocks(benchmark: DataFrame) -> int:
    return -(-(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)


def blocks(benchmark: DataFrame, window: int) -> Iterator[Broadcast]:
    """The benchmark in blocks of about BLOCK_BYTES (of one item, if it is longer), made and broadcast one at a time.

    Whoever takes a block and wants another writes what the first one is for; the driver and the executors then let it go.
    """
    rows = benchmark.select("item_id", "text").where("length(text) > 0")
    n = n_blocks(rows)
    for i in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).distinct().collect()
        phrases = Phrases([tuple(r) for r in own], window)
        if phrases.by_width:
            shared = benchmark.sparkSession.sparkContext.broadcast(phrases)
            yield shared
            if n > 1:
                shared.destroy()


def _found(phrases: Phrases, batch_text: list) -> tuple[list, np.ndarray, list[np.ndarray]]:
    """Per row of the batch: hit words as (byte starts, byte ends) and item numbers; number of words."""
    parts, base = [], 0
    for piece in batch_text:
        parts.append(hashed_words(piece))
    hashes = np.concatenate([p[0] for p in parts])
    begins, ends = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    first = [np.zeros(1, np.int64)]
    for p in parts:
        first.append(p[3][1:] + base)
        base += p[3][-1]
    first = np.concatenate(first)
    hit = np.zeros(len(hashes) + 1, np.int64)
    pairs = []
    for at, width, items, which in phrases.occurrences(phrases.coded(hashes), first):
        np.add.at(hit, at, 1)
        np.add.at(hit, at + width, -1)
        row = np.searchsorted(first, at, "right") - 1
        for r, w in np.unique(np.stack([row, which], axis=1), axis=0):
            pairs.extend((int(r), i) for i in items[w])
    return pairs, first, [np.cumsum(hit)[:-1] > 0, begins, ends]


def _with_spans(spans: pa.Array, pairs: list, first: np.ndarray, hit: np.ndarray) -> list[list[int]]:
    """Each row's spans with the hit words of a block added."""
    spans = spans.to_pylist()
    for r in {r for r, _ in pairs}:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[r] : first[r + 1]].astype(np.int8), [0]])))
        spans[r] = merged([*spans[r], *edge.tolist()])
    return spans


def _cut(raw: bytes, begins: np.ndarray, ends: np.ndarray, spans: list[int]) -> str:
    """A text without the words in spans, each span leaving one space."""
    kept, at = [], 0
    for s, e in zip(spans[::2], spans[1::2]):
        kept.append(raw[at : begins[s]])
        at = int(ends[e - 1])
    return b" ".join([*kept, raw[at:]]).decode()


def _texts(batch: pa.RecordBatch) -> list:
    return [p.column("text") for p in chunks(batch)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit and items: how many words lie in a benchmark window, and whose windows occur.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is `window`
    consecutive words of an item; a shorter item is one window. docs keeps its columns (those named like a result give way).
    Null texts have no words; items that are null, empty or without words are ignored; without items nothing is hit.
    items holds distinct item_ids. Repeated rows on either side are judged alike.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "items", "spans")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.expr("cast(array() as array<int>)"), "items": F.expr(f"cast(array() as array<{kind}>)")})
    several, found = n_blocks(benchmark) > 1, False
    for shared in blocks(benchmark, window):
        out, found = _searched(out, shared), True
        out = written(out, "searched") if several else out
    out = out if found else _searched(out, None)
    hits = F.expr("aggregate(sequence(0, cast(size(spans) / 2 as int)), 0L, (s, i) -> s + coalesce(get(spans, 2 * i + 1) - get(spans, 2 * i), 0))")
    return out.select(*(F.col(f"`{c}`") for c in names), "n_words", hits.alias("n_hit"), F.array_distinct("items").alias("items"))


def _searched(docs: DataFrame, shared: Broadcast | None) -> DataFrame:
    """docs with n_words, and with the spans and items of one block added to those that it has."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = _texts(batch)
            if shared is None:
                first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(hashed_words(t)[3]) for t in texts]))])
                yield batch.set_column(batch.schema.get_field_index("n_words"), "n_words", pa.array(np.diff(first)))
                continue
            pairs, first, (hit, _, _) = _found(shared.value, texts)
            items = batch.column("items").to_pylist()
            for r, i in dict.fromkeys(pairs):
                items[r].append(shared.value.ids[i])
            spans = _with_spans(batch.column("spans"), pairs, first, hit)
            for name, value in (("n_words", pa.array(np.diff(first))), ("spans", pa.array(spans, pa.list_(pa.int32()))), ("items", pa.array(items, batch.schema.field("items").type))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, value)
            yield batch

    return docs.mapInArrow(step, docs.schema)


def merged(spans: list[int]) -> list[int]:
    """[from, to) pairs end to end, sorted and joined where they touch."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every word in a benchmark window cut from its text, and nothing else changed.

    The spans of all windows, of whatever block, are found in the same text, merged and cut, each leaving one space; a text is
    cut again while joined ends form a window. Rows without a hit stay as they are, null and empty texts too; a row of which no word
    is left goes. With one block a task repeats this by itself; with more, each round is a written table, and rows without a hit leave it.
    """
    small_batches(docs.sparkSession)
    if n_blocks(benchmark) <= 1:
        for shared in blocks(benchmark, window):
            return _removed(docs, shared)
        return docs
    name, out, todo = fresh("_spans", docs), None, docs
    while True:
        marked = todo.withColumn(name, F.expr("cast(array() as array<int>)"))
        for shared in blocks(benchmark, window):
            marked = written(_marked(marked, shared, name), "marked")
        clean = marked.where(F.size(name) == 0).drop(name)
        out = clean if out is None else out.unionByName(clean)
        hit = marked.where(F.size(name) > 0)
        if hit.isEmpty():
            return out
        todo = written(_cut_once(hit, docs.schema, name), "cut")


def _marked(docs: DataFrame, shared: Broadcast, name: str) -> DataFrame:
    """docs with the spans of one block added to those in column `name`."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs, first, (hit, _, _) = _found(shared.value, _texts(batch))
                at = batch.schema.get_field_index(name)
                yield batch.set_column(at, name, pa.array(_with_spans(batch.column(at), pairs, first, hit), pa.list_(pa.int32())))

    return docs.mapInArrow(step, docs.schema)


def _cut_once(docs: DataFrame, schema, name: str) -> DataFrame:
    """docs without the words in the spans of column `name`; rows of which no word is left go."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                _, begins, ends, first = hashed_words(piece.column("text"))
                spans, text = piece.column(name).to_pylist(), piece.column("text")
                left = [sum(own[1::2]) - sum(own[::2]) < b - a for own, a, b in zip(spans, first, first[1:])]
                new = [_cut(text[r].as_buffer().to_pybytes(), begins[first[r] :], ends[first[r] :], own) for r, own in enumerate(spans)]
                piece = piece.set_column(piece.schema.get_field_index("text"), "text", pa.array(new, text.type))
                yield piece.filter(pa.array(left)).drop_columns([name])

    return docs.mapInArrow(step, schema)


def _removed(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """remove_contamination for the one block of a benchmark."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, new, gone = _texts(batch), {}, set()
            rows = np.arange(batch.num_rows)
            while texts:
                pairs, first, (hit, begins, ends) = _found(shared.value, texts)
                again = sorted({r for r, _ in pairs})
                if not again:
                    break
                source = pa.chunked_array(texts).cast(pa.string())
                cut = []
                for r in again:
                    a, b = first[r], first[r + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                    cut.append(_cut(source[r].as_buffer().to_pybytes(), begins[a:], ends[a:], edge.tolist()))
                    if hit[a:b].all():
                        gone.add(int(rows[r]))
                rows = rows[again]
                new |= dict(zip(rows.tolist(), cut))
                texts = [pa.array(cut, pa.string())]
            if new:
                text = batch.column("text").to_pylist()
                for r, t in new.items():
                    text[r] = t
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(text, batch.schema.field("text").type))
                batch = batch.filter(pa.array([r not in gone for r in range(batch.num_rows)]))
            yield batch

    return docs.mapInArrow(step, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination of all documents by all of benchmark: a row for each row, equal ones judged alike; null texts have no words."""
    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
