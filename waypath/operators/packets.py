"""Scanner packets to firings: the bytes of a batch of packets are one array, from which all numbers come at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.operators.asof import last_seen

#: Fixed packet layout: blocks of 100 bytes, each a header, an azimuth and firings of three bytes.
BLOCKS, BLOCK_BYTES, FIRINGS = 12, 100, 32
#: Numbers of seq that make a range: about a minute of packets.
SPAN = 100_000
#: Packets that one step takes apart.
STEP = 512


def packet_valid(data: Column) -> Column:
    """All block headers are right."""
    return F.forall(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.hex(F.substr(data, b * BLOCK_BYTES + 1, F.lit(2))) == "FFEE")


class Blocks:
    """The valid packets of a batch: where they stand in it, and their bytes [packet, block, byte]."""

    def __init__(self, column: pa.Array):
        need = BLOCKS * BLOCK_BYTES
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        long = np.flatnonzero((np.diff(at) >= need) & ~np.asarray(column.is_null()))
        rows = raw[at[long][:, None] + np.arange(need)].reshape(len(long), BLOCKS, BLOCK_BYTES)
        right = ((rows[:, :, 0] == 0xFF) & (rows[:, :, 1] == 0xEE)).all(axis=1)
        self.row, self.bytes = long[right], rows[right]
        self.azimuth = self.bytes[:, :, 2].astype(np.int64) + 256 * self.bytes[:, :, 3].astype(np.int64)
        fired = self.bytes[:, :, 4:].reshape(len(self.row), BLOCKS * FIRINGS, 3).astype(np.int64)
        self.units, self.intensity = fired[:, :, 0] + 256 * fired[:, :, 1], fired[:, :, 2]

    def azimuths(self, dual: np.ndarray | None = None) -> np.ndarray:
        """Of all firings, in hundredths of degrees, interpolated to the next block (the second one where dual holds)."""

        def stride(n: int) -> np.ndarray:
            ahead = self.azimuth[:, n:] - self.azimuth[:, :-n]
            return np.concatenate([ahead, ahead[:, -n:]], axis=1)

        step = stride(1) if dual is None else np.where(dual[:, None], stride(2), stride(1))
        step = np.where(step < 0, step + 36000, step)
        out = self.azimuth[:, :, None] + np.arange(FIRINGS) * step[:, :, None] // FIRINGS
        return (out % 36000).reshape(len(self.row), BLOCKS * FIRINGS)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Blocks]]:
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            piece = batch.slice(i, STEP)
            yield piece, Blocks(piece.column("data"))


def with_gap(packets: DataFrame, span: int = SPAN) -> DataFrame:
    """packets with gap, the time since the device's packet before (0 for its first). Only (device, seq, stamp_us) is ordered, in ranges of seq."""
    before = last_seen(packets.select("device", "seq", "stamp_us"), {"_before": F.col("stamp_us")}, ("seq",), "device", before=True, span_us=span)
    gaps = before.select("device", "seq", F.coalesce(F.col("stamp_us") - F.col("_before"), F.lit(0)).alias("gap"))
    return packets.join(gaps, ["device", "seq"])


def firings(packets: DataFrame, unit: float = 0.4, span: int = SPAN) -> DataFrame:
    """packets (device, seq, stamp_us, data, and dual where return_mode has told it) to a row for each firing of each valid packet.

    Where dual holds, pairs of blocks share a direction, so azimuths run from a block to the second after it. Columns: device, seq, block, laser, azimuth (0.01 degrees, interpolated to the next block), distance (metres), intensity,
    t_us (interpolated to the packet before; a device's first packet has its own stamp throughout). Short and null data are invalid.
    """
    dual = "dual" in packets.columns
    i = np.arange(BLOCKS * FIRINGS)

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, b in batches_of(batches):
            n = len(b.row)
            at = pa.array(np.repeat(b.row, len(i)))
            stamp, gap = (piece.column(c).to_numpy(zero_copy_only=False)[b.row].astype(np.float64) for c in ("stamp_us", "gap"))
            azimuth = b.azimuths(np.asarray(piece.column("dual").fill_null(False))[b.row] if dual else None)
            t = stamp[:, None] - (len(i) - 1 - i) * (gap / len(i))[:, None]
            values = [np.tile(i // FIRINGS, n).astype(np.int32), np.tile(i % FIRINGS, n).astype(np.int32), azimuth.ravel().astype(np.int32), (b.units * (0.01 * unit)).ravel(), b.intensity.ravel().astype(np.int32), t.ravel()]
            yield pa.record_batch([piece.column("device").take(at), piece.column("seq").take(at), *map(pa.array, values)], names=["device", "seq", "block", "laser", "azimuth", "distance", "intensity", "t_us"])

    kinds = dict(packets.dtypes)
    rows = with_gap(packets.select("device", "seq", "stamp_us", "data", *["dual"] * dual), span)
    return rows.mapInArrow(fire, f"device {kinds['device']}, seq {kinds['seq']}, block int, laser int, azimuth int, distance double, intensity int, t_us double")
