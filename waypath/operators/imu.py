"""Inertial bytes to frames, and frames to samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.operators.asof import SPAN_US, last_seen, running_sum
from waypath.operators.automaton import finite_scan

ACCELERATION, TURN, UNIT = 16 * 9.80665 / 32768, 2000 * math.pi / 180 / 32768, 1 / 32768
#: Frame kinds of the device; a frame's length and first byte.
IS_ACC, IS_GYRO, IS_QUAT = 0x51, 0x52, 0x59
FRAME, HEADER = 11, 0x55
#: Bytes of a run that one task parses; reads whose lengths are summed at once.
BLOCK_BYTES, SPAN_READS = 1_000_000, 100_000


def decode_imu(frames: DataFrame, order: tuple[str, ...] = ("recv_us", "seq"), span: int = SPAN_US) -> DataFrame:
    """frames (vehicle_id, seq, recv_us, frame of 11 bytes) to samples.

    Frames with a wrong header or sum are ignored. A turn-rate frame gives a sample if an acceleration came since the
    one before; it carries the latest acceleration and orientation (x, y, z, w; 0, 0, 0, 1 before the first).
    order ranks the frames of a run; its first column is a number, cut in ranges of `span`, so no task orders a run.
    """
    names = [*dict.fromkeys(("vehicle_id", "seq", "recv_us", *order))]
    kinds = dict(frames.dtypes)
    kind = frames.select(*names, "frame").mapInArrow(frame_numbers, ", ".join(f"{c} {kinds[c]}" for c in names) + ", kind int, v array<int>")
    at = F.struct(*order)
    rows = last_seen(kind, {"acc": F.when(F.col("kind") == IS_ACC, F.struct(at.alias("at"), "v")), "quat": F.when(F.col("kind") == IS_QUAT, F.col("v")), "turned": F.when(F.col("kind") == IS_GYRO, at)}, order, before=True, span_us=span)
    rows = rows.where((F.col("kind") == IS_GYRO) & F.col("acc").isNotNull() & (F.col("turned").isNull() | (F.col("acc.at") > F.col("turned"))))
    acc = [(F.col("acc.v")[i] * ACCELERATION).alias(f"a{c}") for i, c in enumerate("xyz")]
    gyro = [(F.col("v")[i] * TURN).alias(f"g{c}") for i, c in enumerate("xyz")]
    quat = [F.coalesce(F.col("quat")[i] * UNIT, F.lit(d)).alias(f"q{c}") for i, c, d in ((1, "x", 0.0), (2, "y", 0.0), (3, "z", 0.0), (0, "w", 1.0))]
    return rows.select("vehicle_id", *dict.fromkeys(("seq", "recv_us", *order)), *acc, *gyro, *quat)


def frame_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a right `frame`, which gives way to its kind and four signed numbers v: the bytes of a batch are one array."""
    for batch in batches:
        frames = batch.column("frame").cast(pa.large_binary())
        row = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.binary_length(frames), FRAME), False)))
        data = np.frombuffer(b"".join(frames.take(pa.array(row)).to_pylist()), np.uint8).reshape(len(row), FRAME).astype(np.int32)
        right = (data[:, 0] == HEADER) & (data[:, : FRAME - 1].sum(axis=1) % 256 == data[:, FRAME - 1])
        row, data = row[right], data[right]
        v = data[:, 2:10:2] + 256 * data[:, 3:10:2]
        v = np.where(v > 32767, v - 65536, v).astype(np.int32)
        at = pa.array(row)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 4, dtype=np.int32)), pa.array(v.ravel()))
        own = [n for n in batch.schema.names if n != "frame"]
        yield pa.record_batch([*(batch.column(n).take(at) for n in own), pa.array(data[:, 1]), lists], names=[*own, "kind", "v"])


def frame_starts(data: np.ndarray) -> np.ndarray:
    """Places at which the bytes look like a frame: the header, and the sum of ten bytes in the eleventh."""
    n = len(data) - FRAME + 1
    if n <= 0:
        return np.empty(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    return np.flatnonzero((data[:n] == HEADER) & ((sums[FRAME - 1 : n + FRAME - 1] - sums[:n]) % 256 == data[FRAME - 1 :]))


def walked(starts: np.ndarray, entry: int, size: int, met: dict[int, int] | None = None) -> tuple[list[int], int]:
    """The frames that a parser takes from place `entry` up to `size`, and where it goes on. met: where walks from frames already seen went on."""
    after, path, i, n = starts.tolist(), [], int(np.searchsorted(starts, entry)), len(starts)
    at = entry
    while i < n and after[i] < size:
        if met is not None and after[i] in met:
            at = met[after[i]]
            break
        path.append(after[i])
        at = after[i] + FRAME
        i += 1
        while i < n and after[i] < at:
            i += 1
    return path, max(at, size)


def block_moves(data: np.ndarray, size: int) -> list[int]:
    """For each place 0 to 10 at which a parser enters a block of `size` bytes, the place at which it enters the next one."""
    starts, met, out = frame_starts(data), {}, []
    for entry in range(FRAME):
        path, end = walked(starts, entry, size, met)
        met.update(dict.fromkeys(path, end))
        out.append(end - size)
    return out


def imu_frames(reads: DataFrame, block: int = BLOCK_BYTES, span: int = SPAN_READS) -> DataFrame:
    """reads (vehicle_id, seq, recv_us, data) of a serial line to frames (vehicle_id, seq, recv_us, at, frame).

    A frame is found as by a parser that takes the bytes of a run's reads end to end, in the order of seq, and skips one byte wherever the
    header or the sum is wrong; at is its place in the run, and seq and recv_us are those of the read that completes it. The bytes of
    a run are cut in blocks, with the ten after each. Where a parser leaves a block depends only on which of eleven places it
    enters it at: blocks are parsed alone for all of them, a scan over eleven states tells the real ones, and blocks are parsed
    again from there. Null or empty reads add nothing; bytes at the end that make no whole frame give none; no reads, no frames.
    """
    if block < FRAME:
        raise ValueError("a block holds a frame at least")
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")
    rows = reads.select("vehicle_id", "seq", "recv_us", "data", size.alias("size")).where("size > 0")
    begin = running_sum(rows.drop("data", "recv_us"), "end", F.col("size"), ("seq",), span_us=span).select("vehicle_id", "seq", (F.col("end") - F.col("size")).alias("begin"))
    rows = rows.join(begin, ["vehicle_id", "seq"])
    first = F.floor(F.greatest(F.lit(0).cast("long"), F.col("begin") - FRAME + 1) / block)
    rows = rows.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("begin") + F.col("size") - 1) / block))))
    # Of a read, a block gets only its own bytes and the ten behind them.
    a = F.greatest(F.col("begin"), F.col("block") * block)
    b = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block + FRAME - 1)
    rows = rows.select("vehicle_id", "block", "seq", "recv_us", (a - F.col("block") * block).cast("int").alias("place"), F.substring("data", (a - F.col("begin") + 1).cast("int"), (b - a).cast("int")).alias("data"))
    kinds = dict(rows.dtypes)

    def whole(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        group = group.sort_values("place")
        return group, np.frombuffer(b"".join(group["data"]), np.uint8)

    def moves(group: pd.DataFrame) -> pd.DataFrame:
        group, data = whole(group)
        return pd.DataFrame({"vehicle_id": group["vehicle_id"].iloc[:1], "block": group["block"].iloc[:1], "moves": [block_moves(data, block)]})

    def parse(group: pd.DataFrame) -> pd.DataFrame:
        group, data = whole(group)
        at = np.array(walked(frame_starts(data), int(group["entry"].iloc[0]), block)[0], np.int64)
        last = group.iloc[np.searchsorted(group["place"].to_numpy(), at + FRAME - 1, "right") - 1]
        return pd.DataFrame({"vehicle_id": last["vehicle_id"].to_numpy(), "seq": last["seq"].to_numpy(), "recv_us": last["recv_us"].to_numpy(), "at": at + int(group["block"].iloc[0]) * block, "frame": [data[i : i + FRAME].tobytes() for i in at.tolist()]})

    own = rows.groupBy("vehicle_id", "block").applyInPandas(moves, f"vehicle_id {kinds['vehicle_id']}, block long, moves array<int>")
    states = finite_scan(own, F.col("moves"), "block", "vehicle_id", 0).select("vehicle_id", (F.col("block") + 1).alias("block"), F.col("state").alias("entry"))
    entered = rows.join(states, ["vehicle_id", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    return entered.groupBy("vehicle_id", "block").applyInPandas(parse, f"vehicle_id {kinds['vehicle_id']}, seq {kinds['seq']}, recv_us {kinds['recv_us']}, at long, frame binary")


def decode_imu_stream(reads: DataFrame, block: int = BLOCK_BYTES, span: int = SPAN_READS) -> DataFrame:
    """decode_imu of the frames in the raw reads of a serial line (see imu_frames), with `at`, the place of the frame that gives the sample."""
    return decode_imu(imu_frames(reads, block, span), ("at",), 100 * block)
