"""Token counts with a digest cache, and token ids in keyed binary shards."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.llm.common import chunks, documents, fresh, kept, looked_up, mix, scratch, text_bytes, text_key, written
from waypath.llm.lookup import Memo

TOKEN_LIMIT, END_ID = 1024, 0
#: Pieces whose ids a worker remembers (about 60 bytes each); beyond, it starts anew.
KNOWN_PIECES = 1_000_000
#: New pieces that the library gets as one text, which costs it about half of what as many texts do.
JOINED_PIECES = 256
#: A piece starts at a blank before a byte that is no white space and starts none beyond ASCII.
OPENS = np.ones(256, bool)
OPENS[[32, *range(9, 14), 0xC2, 0xE1, 0xE2, 0xE3]] = False


class Encoder:
    """Ids of whole texts, as the tokenizers (.json) or sentencepiece (.model) library gives them.

    A byte-level vocabulary splits text before every blank that precedes a non-blank, whatever stands around it, so
    the library encodes each distinct piece once, and a text is its pieces' ids end to end. Pieces are found by a hash and
    told apart by their bytes. New pieces that start at such a blank are encoded end to end as one text; an id stands for a fixed
    number of bytes, so each piece's ids are told by its length. Other vocabularies encode every text whole.

    A Spark task has one core, so the library's own threads, whose waiting costs CPU time, are off unless TOKENIZERS_PARALLELISM says otherwise.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.pieces = False
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size, self.encode_all = own.vocab_size(), lambda texts: own.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            own, spec = Tokenizer.from_file(path), json.loads(Path(path).read_text())
            own.no_truncation()
            own.no_padding()
            before = spec["pre_tokenizer"] or {}
            self.pieces = spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
            if self.pieces:
                vocabulary, model = own.get_vocab(with_added_tokens=False), spec["model"]
                # no byte is unknown, an id stands for its bytes alone, and a blank that starts a piece merges with nothing before it
                self.pieces = model.get("type") == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and vocabulary.keys() >= set(ByteLevel.alphabet()) and not any(t.endswith("Ġ") for t in vocabulary if len(t) > 1)
                width = {i: len(t) for t, i in vocabulary.items()} | {t["id"]: len(t["content"].encode()) for t in spec["added_tokens"]}
                self.width = np.zeros(max(width) + 1, np.int64)
                self.width[[*width]] = [*width.values()]
            self.size, self.encode_all = own.get_vocab_size(), lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.memo, self.first, self.length, self.ids = Memo(), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.dtype)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.encode_all(texts)
        return np.fromiter(chain.from_iterable(coded), self.dtype), np.array([len(c) for c in coded], np.int64)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces end to end, and how many each has."""
        heads = [i for i, x in enumerate(pieces) if not i % JOINED_PIECES or x[0] != 32 or len(x) == 1 or not OPENS[x[1]]]
        ids, _ = self._encode([b"".join(pieces[a:b]).decode() for a, b in zip(heads, [*heads[1:], len(pieces)])])
        ends, reached = np.cumsum([len(x) for x in pieces]), np.cumsum(self.width[ids])
        last = np.searchsorted(reached, ends)
        if len(reached) == 0 or reached[-1] != ends[-1] or (reached[last] != ends).any():
            raise ValueError("ids don't end where their pieces end")
        return ids, np.diff(last, prepend=-1)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the offset of each text's (one more at the end)."""
        if not self.pieces:
            ids, n = self._encode(pc.fill_null(column, "").to_pylist())
            return ids, np.concatenate([[0], np.cumsum(n)])
        data, offsets = text_bytes(column)
        opens = np.zeros(len(data), bool)
        opens[:-1] = (data[:-1] == 32) & OPENS[data[1:]]
        opens[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        if self.memo.size > KNOWN_PIECES:
            self._forget()
        piece, new = self.memo(data, starts, ends)
        if new:
            ids, n = self._encode_pieces(new)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
            self.length = np.concatenate([self.length, n])
            self.ids = np.concatenate([self.ids, ids])
        n = self.length[piece]
        total = np.concatenate([[0], np.cumsum(n)])
        gather = np.repeat(self.first[piece] - total[:-1], n) + np.arange(total[-1])
        return self.ids[gather], total[np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """docs without text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    The cache is a Parquet table (digest, tokenizer, n_tokens) at path `cache`, made if absent: digest is the SHA-256
    of a text (null is empty; nothing else is normalised, as it could change counts), tokenizer that of the
    vocabulary file. Texts whose pair is stored are not encoded; each distinct other text is encoded once, whole,
    and appended. Counts leave out begin, end and padding tokens. Repeated rows stay; empty table, empty result. Columns of
    docs named like a result give way to it; all others stay. Texts with many copies are joined by broadcast of their digests.
    """
    spark, version = docs.sparkSession, hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()
    schema = "digest binary, tokenizer string, n_tokens long"
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for piece in chunks(batch):
                n = np.diff(encode(piece.column("text"))[1])
                yield pa.record_batch([piece.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    missing = docs.select(digest.alias("digest"), text.alias("text"))
    try:
        missing = missing.join(stored(), "digest", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    missing.dropDuplicates(["digest"]).mapInArrow(counted, schema).write.mode("append").parquet(cache)
    results = ("n_bytes", "n_tokens", "over_limit")
    names, key = [c for c in docs.columns if c != "text" and c.lower() not in results], fresh("digest", docs)
    rows = written(docs.select(*(F.col(f"`{c}`") for c in names), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias(key)), "rows")
    counts = rows.groupBy(key).agg(F.count("*").alias("rows")).join(stored().withColumnRenamed("digest", key), key)
    found = looked_up(rows, written(counts, "counts"), [key], "rows")
    return found.select(*(F.col(f"`{c}`") for c in names), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_tokens of all documents with an empty cache: a row for each row, null texts and repeated rows too."""
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), default_tokenizer(), scratch(spark, "token-cache"))


class Stored:
    """An array in a file, of which only the numbers asked for are read."""

    def __init__(self, file: pa.NativeFile, at: int, n: int, dtype: np.dtype):
        self.file, self.at, self.n, self.dtype = file, at, n, dtype

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int | slice | np.ndarray) -> np.ndarray | np.generic:
        if isinstance(i, slice):
            first, last, _ = i.indices(self.n)
            return np.frombuffer(self.file.read_at(max(0, last - first) * self.dtype.itemsize, self.at + first * self.dtype.itemsize), self.dtype)
        if isinstance(i, np.ndarray):
            return np.array([self[int(k)] for k in i], self.dtype)
        return np.frombuffer(self.file.read_at(self.dtype.itemsize, self.at + int(i) * self.dtype.itemsize), self.dtype)[0]


#: The arrays of an index file in their order: a row's key, whether it has none, the first id of each row and the end; the hash's
#: levels, bits and ranks; by the hash's number a fingerprint and the first row. Before them, the length of each as <i8.
PARTS = {"key": "<i8", "none": "|b1", "offsets": "<i8", "sizes": "<i8", "words": "<u8", "ranks": "<i8", "marks": "<u4", "rows": "<i8"}


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: n keys to 0..n-1, in about three bits a key.

    Level by level, keys alone in their cell of a bit array take it; the others try the next level. A key's
    number is the count of set bits before its cell.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray | Stored, ranks: np.ndarray | Stored):
        """ranks: how many bits are set before each word. words and ranks may be in a file, of which a key reads two numbers a level."""
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = 64 * int(np.ceil(max(1, gamma * len(keys)) / 64))
            cell = cls._cell(keys, len(sizes), size)
            alone = np.bincount(cell, minlength=size)[cell] == 1
            bits = np.zeros(size, bool)
            bits[cell[alone]] = True
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone]
        words = np.concatenate([np.empty(0, np.uint64), *levels])
        return cls(np.array(sizes, np.int64), words, np.cumsum(np.bitwise_count(words).astype(np.int64)) - np.bitwise_count(words))

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x4F1BBCDCBFA53E0B % 2**64)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; of a key that was not built in, any number or -1."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            cell = self._cell(keys[todo], level, size) + base
            word, bit = self.words[cell >> 6], (cell & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.ranks[cell >> 6] + below)[hit]
            todo, base = todo[~hit], base + size
        return out


def _key(ids: np.ndarray) -> np.ndarray:
    return mix(np.ascontiguousarray(ids, np.int64).view(np.uint64))


def _mark(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs (doc_id of an integer type, text) as token shards below path, and returns the manifest.

    Rows are range-partitioned and sorted by doc_id (null first), then by the text's hash. Each partition with rows is
    shard-N.bin, the raw ids of its rows end to end, each with end_id after it, as little-endian u16 (u32 if the vocabulary
    needs it; the manifest tells), and shard-N.idx, the PARTS: rows' ids (doc_id, null) and offsets, a minimal perfect
    hash of the distinct doc_ids, and by its number a 32-bit fingerprint and the first row. A task writes under a name of its own and
    renames when done, so a task that runs again leaves the same files. path is any URI that pyarrow opens on all executors.
    The manifest (shard, n_rows, n_ids, id_bytes, least, most; also at path/manifest) has one row a shard. Null or empty texts
    are the end id alone; repeated doc_ids are all written, one after another. An empty table writes no shard.
    """
    schema = "shard int, n_rows long, n_ids long, id_bytes int, least long, most long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(tokenizer), TaskContext.get()
        shard = context.partitionId()
        files, base = _open(path)
        files.create_dir(base, recursive=True)
        name, own = f"{base}/shard-{shard:05d}", f"{base}/_{shard:05d}-{context.taskAttemptId()}"
        sizes: list[np.ndarray] = []
        keys: list[pa.Array] = []
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or files.open_output_stream(f"{own}.bin")
            keys.append(batch.column("doc_id").cast(pa.int64()))
            for piece in chunks(batch):
                ids, at = encode(piece.column("text"))
                sizes.append(np.diff(at) + 1)
                out.write(np.insert(ids, at[1:], end_id).tobytes())
        if out is None:
            return
        out.close()
        column, size = pa.chunked_array(keys), np.concatenate(sizes)
        none = np.asarray(column.is_null())
        key = np.asarray(column.fill_null(0), np.int64)
        distinct, first = np.unique(key[~none], return_index=True)
        hashed = _key(distinct)
        table = PerfectHash.build(hashed)
        slot = table(hashed)
        marks, rows = np.zeros(len(slot), np.uint32), np.zeros(len(slot), np.int64)
        marks[slot], rows[slot] = _mark(hashed), first + int(none.sum())
        arrays = {"key": key, "none": none, "offsets": np.concatenate([[0], np.cumsum(size)]), "sizes": table.sizes, "words": table.words, "ranks": table.ranks, "marks": marks, "rows": rows}
        with files.open_output_stream(f"{own}.idx") as f:
            f.write(np.array([len(arrays[p]) for p in PARTS], "<i8").tobytes())
            for p, kind in PARTS.items():
                f.write(np.ascontiguousarray(arrays[p], kind).tobytes())
        for kind in ("bin", "idx"):
            files.move(f"{own}.{kind}", f"{name}.{kind}")
        seen = key[~none]
        yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "n_rows": pa.array([len(key)], pa.int64()), "n_ids": pa.array([int(size.sum())], pa.int64()), "id_bytes": pa.array([encode.dtype.itemsize], pa.int32()), "least": pa.array([int(seen[0]) if len(seen) else None], pa.int64()), "most": pa.array([int(seen[-1]) if len(seen) else None], pa.int64())})

    rows = docs.select("doc_id", text_key().alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("t")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, schema).write.parquet(f"{path}/manifest")
    return read_manifest(docs.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shards, with the ids before each."""
    rows = spark.read.parquet(f"{path}/manifest")
    return rows.withColumn("start", F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids"))


class Shard:
    """One shard's files. The index is read where it lies, or at once with whole=True (for a task that reads all rows)."""

    def __init__(self, path: str, number: int, id_bytes: int, whole: bool = False):
        files, base = _open(path)
        index = files.open_input_file(f"{base}/shard-{number:05d}.idx")
        self.bin, self.dtype = files.open_input_file(f"{base}/shard-{number:05d}.bin"), np.dtype(f"<u{id_bytes}")
        at, parts = 8 * len(PARTS), {}
        for (p, kind), n in zip(PARTS.items(), np.frombuffer(index.read_at(at, 0), "<i8").tolist()):
            part = Stored(index, at, n, np.dtype(kind))
            parts[p] = part[:] if whole or p == "sizes" else part
            at += n * part.dtype.itemsize
        self.key, self.none, self.offsets, self.marks, self.rows = (parts[p] for p in ("key", "none", "offsets", "marks", "rows"))
        self.table = PerfectHash(parts["sizes"], parts["words"], parts["ranks"])

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids of rows first..last-1."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return np.frombuffer(self.bin.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)

    def find(self, doc_ids: np.ndarray) -> np.ndarray:
        """The first row of each doc_id, or -1: a probe of the hash, its fingerprint and its key."""
        key = _key(doc_ids)
        slot = self.table(key)
        out, held = np.full(len(key), -1, np.int64), np.flatnonzero(slot >= 0)
        held = held[self.marks[slot[held]] == _mark(key[held])]
        row = self.rows[slot[held]]
        same = self.key[row] == doc_ids[held]
        out[held[same]] = row[same]
        return out


class TokenStore:
    """Keyed access to shards that write_token_shards wrote. The manifest (a row a shard) is held; no index is."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.open = path, {}
        self.manifest = [r for r in read_manifest(spark, path).orderBy("shard").collect() if r.least is not None]

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document, with its end id (the first one's if doc_id repeats); None if there is none."""
        for r in self.manifest[bisect_left(self.manifest, doc_id, key=lambda r: r.most) :]:  # the first shard that can hold it, or the next of a repeated id
            if r.least > doc_id:
                return None
            if r.shard not in self.open:
                self.open[r.shard] = Shard(self.path, r.shard, r.id_bytes)
            row = int(self.open[r.shard].find(np.array([doc_id], np.int64))[0])
            if row >= 0:
                return self.open[r.shard].read(row, row + 1)
        return None


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the files.

    Each doc_id is looked up through its shard's hash and fingerprint; rows with the same doc_id follow the one found, those
    without doc_id come first. An index that doesn't lead to a row is an error. start counts the ids of all rows before
    it, n_tokens takes in the end id, ids_crc32 is of the ids as little-endian u32.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, start, id_bytes in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "id_bytes"))):
                shard = Shard(path, number, id_bytes, whole=True)
                key, none, offsets = shard.key, shard.none, shard.offsets
                at, n = np.arange(len(key)), int(none.sum())
                first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
                first[n : n + 1] = True
                at[n:] = shard.find(key[n:]) + (at - np.maximum.accumulate(np.where(first, at, 0)))[n:]
                if (at != np.arange(len(key))).any():
                    raise ValueError(f"the index of shard {number} doesn't lead to its rows")
                for a in range(0, len(key), 256):
                    b = min(a + 256, len(key))
                    own = at[a:b]
                    ids = shard.read(own[0], own[-1] + 1).astype("<u4")
                    begin, end = offsets[own] - offsets[own[0]], offsets[own + 1] - offsets[own[0]]
                    crc = [zlib.crc32(ids[i:j]) for i, j in zip(begin.tolist(), end.tolist())]
                    yield pa.record_batch({"doc_id": pa.array(key[own], mask=none[own]), "start": pa.array(offsets[own] + start), "n_tokens": pa.array(end - begin), "ids_crc32": pa.array(crc, pa.int64())})

    manifest = read_manifest(spark, path).select("shard", "start", "id_bytes")
    return manifest.repartition(max(1, manifest.count()), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs as token shards in the shared folder and reads them back."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_shards(docs, path, tokenizer, end_id)
    return read_token_shards(docs.sparkSession, path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_shards of all documents: a row for each row, in the files by doc_id (null first), then by the text's hash."""
    return token_shards(documents(spark, sf_dir), default_tokenizer())
