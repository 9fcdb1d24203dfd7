"""Pieces that the corpus operators share: scratch tables, Arrow text chunks, hashing of spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; a single longer text is hashed in blocks of this size.
CHUNK_BYTES = 1_000_000
#: Rows of an Arrow batch.
ARROW_ROWS = 1000
#: A key with at least this share of a join's rows is heavy; there are at most HEAVY of them, which bounds their broadcast.
HEAVY = 1000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); of this machine only where all of Spark runs on it."""
    base, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    base = base or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df through a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores in front until no column of the frames is called so (whatever its case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner, left or left_semi) with table, whose keys are distinct; weight tells how many rows hold each key.

    Keys that hold 1 / HEAVY of the rows or more are broadcast, at most HEAVY of them; the others are shuffled, so no task
    gets a hot key's rows. rows and table are read twice: both are written tables or cheap to make. weight goes.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy, light = (table.where(c).drop(weight) for c in (F.col(weight) * HEAVY >= total, F.col(weight) * HEAVY < total))
    hot = F.broadcast(heavy)
    return rows.join(hot, on, "inner" if how == "left" else how).unionByName(rows.join(hot, on, "left_anti").join(light, on, how))


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What make() gives, kept by a worker until another thing is asked for: operators that follow each other don't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def small_batches(spark: SparkSession) -> None:
    """Batches of ARROW_ROWS rows between Spark and Python, where the session leaves Spark's own 10,000: texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key():
    """Rows with one doc_id and different texts stay apart by this hash of the text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and the offset of each row (one more at the end). Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES):
    """Slices of batch of about `most` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(text))
    cuts = np.unique(np.searchsorted(offsets, np.arange(0, offsets[-1] + most, most)))
    cuts = [0, *[int(c) for c in cuts if 0 < c < batch.num_rows], batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse mod 2^64, for i in 0..n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        n = -(-(n + 1) // (1 << 18)) << 18
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(n + 1, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        have = (out[0], out[1])
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have


class Spans:
    """Polynomial hashes, in constant time each, of any span of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], dtype=np.uint64, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of all spans of one width, by their start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


_draws = np.random.default_rng(2024)
#: A random number for each byte value at each of 256 places in a span.
PLACED = _draws.integers(0, 2**64, 1 << 16, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending, disjoint spans of bytes, in blocks of CHUNK_BYTES, so memory is a small multiple of a block.

    A span's hash is the sum of random numbers, one for each pair of byte and place in the span, so no pattern of bytes cancels out
    (a polynomial modulo 2^64 has such patterns). From place 256 on the number is mixed with the place.
    """
    out = np.zeros(len(starts), np.uint64)
    for a in range(0, len(data), CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, len(data))
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))
        if i == j:
            continue
        lo, hi = np.maximum(starts[i:j], a) - a, np.minimum(ends[i:j], b) - a
        place = np.arange(lo[0] + a, b) - np.repeat(starts[i:j], np.diff(lo, append=b - a))
        values = PLACED[(place & 255) << 8 | data[a + lo[0] : b]]
        far = np.flatnonzero(place > 255)
        if len(far):
            values[far] = mix(values[far] + (place[far] >> 8).astype(np.uint64) * STEP)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, dtype=np.uint64, out=sums[1:])
        out[i:j] += sums[hi - lo[0]] - sums[lo - lo[0]]
    return mix(out + (ends - starts).astype(np.uint64) * STEP)


BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, other: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs of bytes not in `other`, within a row), and each row's first word."""
    n, inside = len(data), ~other[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[offsets < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[offsets > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
