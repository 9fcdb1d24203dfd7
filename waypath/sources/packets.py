"""Files of scanner packets as a Spark data source: dumps of fixed records, and network captures.

A file of any size is read by many tasks, each a range of bytes. Records of a dump have one length, so ranges begin at records. Those of a
capture differ. A task looks for the first place, BACK longest records before its range, from which a chain of CHAIN record headers (or all up to the
end) makes sense, and goes on from there: should it have begun inside of a record that holds records itself, it is back at the real ones where that one ends.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of one read within it.
SPLIT, READ = 128 << 20, 8 << 20
#: Tasks that small ranges are dealt to, at least.
TASKS = 64
#: Fixed sizes: a capture's own header, that of each record, and those of Ethernet, IPv4 and UDP; the longest record.
CAPTURE, RECORD, NETWORK, LONGEST = 24, 16, 42, 262_144
#: Fixed marks of captures: their first four bytes (little-endian), and parts of a second in their times.
MARKS = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
#: Record headers that follow each other before a place is taken for a record; seconds that a record may be from the first one.
CHAIN, APART = 4, 10 * 365 * 86_400
#: Longest records by which a task begins before its range.
BACK = 8


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"\w+:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's files, or of those that a pattern in the last part of the path names."""
    system, own = opened(path)
    head = path[: len(path) - len(own)] if path.endswith(own) else ""
    info = system.get_file_info(own)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    folder, _, pattern = (own.rstrip("/"), "", "*") if info.type == fs.FileType.Directory else own.rpartition("/")
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    out = sorted((head + i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._" and fnmatch.fnmatch(i.base_name, pattern))
    if not out:
        raise FileNotFoundError(path)
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """A row of bytes each."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[Range]


@dataclass
class Range(InputPartition):
    """Records first..last-1 of a dump, or bytes first..last-1 of a capture."""

    path: str
    first: int
    last: int


def shared(ranges: list[Range], size: int) -> list[Range] | list[Ranges]:
    """Ranges of size bytes together, of which small ones share a task: there are TASKS of these, or more where each would hold over READ bytes."""
    each = len(ranges) // max(TASKS, size // READ)
    return ranges if each <= 1 else [Ranges(ranges[i : i + each]) for i in range(0, len(ranges), each)]


class DumpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size, self.header, self.skip = (int(options.get(k, d)) for k, d in (("size", 1206), ("header", 0), ("skip", 0)))
        self.split = int(options.get("split", SPLIT))
        self.stride = self.size + self.header

    def partitions(self) -> list[Range]:
        step, out = max(1, self.split // self.stride), []
        for path, size in files_of(self.path):
            n = max(0, size - self.skip) // self.stride
            out += [Range(path, i, min(n, i + step)) for i in range(0, n, step)]
        return shared(out, sum(r.last - r.first for r in out) * self.stride) or [Range("", 0, 0)]

    def read(self, part: Range | Ranges) -> Iterator[pa.RecordBatch]:
        for one in part.ranges if isinstance(part, Ranges) else [part]:
            yield from self.records(one)

    def records(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        system, own = opened(part.path)
        step = max(1, READ // self.stride)
        with system.open_input_file(own) as f:
            for i in range(part.first, part.last, step):
                n = min(step, part.last - i)
                rows = np.frombuffer(f.read_at(n * self.stride, self.skip + i * self.stride), np.uint8).reshape(n, self.stride)
                yield pa.record_batch([pa.array([part.path] * n), pa.array(np.arange(i, i + n)), binary(rows[:, self.header :])], names=["device", "seq", "data"])


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        return [Range(path, a, min(size, a + self.split)) for path, size in files_of(self.path) for a in range(0, max(1, size), self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, own = opened(part.path)
        with system.open_input_file(own) as f:
            records = Records(f)
            rows: list[tuple] = []
            held = 0
            for row in records.between(part.first, part.last):
                rows.append(row)
                held += len(row[-1])
                if held > READ:
                    yield self.batch(part.path, rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(part.path, rows)

    @staticmethod
    def batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
        seq, stamp, source, port, data = zip(*rows)
        return pa.record_batch([pa.array([path] * len(rows)), pa.array(seq, pa.int64()), pa.array(stamp, pa.int64()), pa.array(source), pa.array(port, pa.int32()), pa.array(data, pa.binary())], names=["device", "seq", "stamp_us", "source", "port", "data"])


class Records:
    """The records of an open capture."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.block = file, file.size(), 0, b""
        head = self.bytes(0, CAPTURE)
        self.order = next((o for o in ("little", "big") if int.from_bytes(head[:4], o) in MARKS), None)
        if self.order is None:
            raise ValueError("not a capture")
        self.parts = MARKS[int.from_bytes(head[:4], self.order)]
        self.longest = min(LONGEST, int.from_bytes(head[16:20], self.order) or LONGEST)
        first = self.bytes(CAPTURE, RECORD)
        self.start = int.from_bytes(first[:4], self.order) if len(first) == RECORD else 0

    def bytes(self, at: int, n: int) -> bytes:
        """n bytes (fewer at the end), read in blocks."""
        if not self.at <= at or at + n > self.at + len(self.block):
            self.at, self.block = at, self.file.read_at(min(max(n, READ // 8), max(0, self.size - at)), at)
        return self.block[at - self.at : at - self.at + n]

    def header(self, at: int) -> tuple[int, int, int, int] | None:
        """Seconds, part of the second, bytes held and bytes sent, if these make sense and the record is whole."""
        raw = self.bytes(at, RECORD)
        if len(raw) < RECORD:
            return None
        s, part, held, sent = (int.from_bytes(raw[i : i + 4], self.order) for i in (0, 4, 8, 12))
        return (s, part, held, sent) if self.sensible(s, part, held, sent) and at + RECORD + held <= self.size else None

    def sensible(self, s: int, part: int, held: int, sent: int) -> bool:
        return abs(s - self.start) < APART and part < self.parts and 0 < held <= self.longest and held <= sent

    def cut(self, at: int) -> bool:
        """The file ends within the record that begins here."""
        raw = self.bytes(at, RECORD)
        return len(raw) < RECORD or self.sensible(*(int.from_bytes(raw[k : k + 4], self.order) for k in (0, 4, 8, 12)))

    def chained(self, at: int) -> bool:
        """CHAIN records follow each other from here, or all up to the end, the last of which may be cut."""
        for i in range(CHAIN):
            one = self.header(at)
            if one is None:
                return i > 0 and self.cut(at)
            at += RECORD + one[2]
        return True

    def first_from(self, at: int) -> int:
        """The first record at or behind a place; the file's size if there is none."""
        if at <= CAPTURE:
            return CAPTURE
        data = np.frombuffer(self.bytes(at, min(self.longest + 2 * RECORD, self.size - at)), np.uint8).astype(np.int64)
        n = len(data) - RECORD + 1
        if n <= 0:
            return self.size
        weights = [1, 1 << 8, 1 << 16, 1 << 24] if self.order == "little" else [1 << 24, 1 << 16, 1 << 8, 1]
        s, part, held, sent = (sum(w * data[i + k : i + k + n] for k, w in enumerate(weights)) for i in (0, 4, 8, 12))
        can = (np.abs(s - self.start) < APART) & (part < self.parts) & (held > 0) & (held <= self.longest) & (held <= sent)
        return next((at + i for i in np.flatnonzero(can).tolist() if self.chained(at + i)), self.size)

    def between(self, first: int, last: int) -> Iterator[tuple[int, int, str, int, bytes]]:
        """(place, microseconds, sender, port, payload) of the UDP packets of records that begin in first..last-1."""
        at = self.first_from(max(CAPTURE, first - BACK * (self.longest + RECORD)))
        while at < last:
            one = self.header(at)
            if one is None:
                if self.cut(at):
                    return
                at = self.first_from(at + 1)  # damage, or the end of records within a record
                continue
            if at < first:
                at += RECORD + one[2]
                continue
            s, part, held, _ = one
            raw = self.bytes(at + RECORD, held)
            if held >= NETWORK and raw[12:14] == b"\x08\x00" and raw[14] == 0x45 and raw[23] == 17:
                yield at, s * 1_000_000 + part * 1_000_000 // self.parts, ".".join(map(str, raw[26:30])), int.from_bytes(raw[36:38], "big"), raw[NETWORK:]
            at += RECORD + held


class PacketDumps(DataSource):
    """Format waypath_dump; options size, header and skip (bytes of a packet, before each, before all) and split."""

    @classmethod
    def name(cls) -> str:
        return "waypath_dump"

    def schema(self) -> str:
        return "device string, seq long, data binary"

    def reader(self, schema: object) -> DumpReader:
        return DumpReader(self.options)


class Captures(DataSource):
    """Format waypath_capture; option split."""

    @classmethod
    def name(cls) -> str:
        return "waypath_capture"

    def schema(self) -> str:
        return "device string, seq long, stamp_us long, source string, port int, data binary"

    def reader(self, schema: object) -> CaptureReader:
        return CaptureReader(self.options)


def read_packets(spark: SparkSession, path: str, size: int = 1206, header: int = 0, skip: int = 0, split: int = SPLIT) -> DataFrame:
    """(device, seq, data) of files of packets end to end, each with `header` bytes before it; a cut last one is left out. device is the file.

    skip bytes come before a file's first packet. path is a file, a folder or a pattern, on any file system that pyarrow opens on all
    executors. Each task reads a range of about `split` bytes in pieces of READ, so neither a file's size nor a packet's place matters.
    """
    spark.dataSource.register(PacketDumps)
    return spark.read.format(PacketDumps.name()).options(size=size, header=header, skip=skip, split=split).load(path)


def read_capture(spark: SparkSession, path: str, port: int | None = None, source: str | None = None, split: int = SPLIT) -> DataFrame:
    """(device, seq, stamp_us, source, port, data) of the UDP packets of network captures, by destination port and sender if given.

    seq is the record's place in the file, so it orders a file's packets; stamp_us is the capture's own time. Both byte orders, times in micro- and
    nanoseconds, and records of any lengths and protocols are read; a cut last record is left out.
    """
    spark.dataSource.register(Captures)
    rows = spark.read.format(Captures.name()).options(split=split).load(path)
    rows = rows if port is None else rows.where(F.col("port") == port)
    return rows if source is None else rows.where(F.col("source") == source)


def write_packets(packets: DataFrame, path: str, per_file: int = 100_000) -> None:
    """packets (device, seq, data) as dumps path/device-N.bin, N the number of the file among the device's: seq // per_file, in order of seq.

    A task writes under a name of its own and renames when done, so a task that runs again leaves the same files. Null data are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(path)
        system.create_dir(base, recursive=True)
        name, out, own = None, None, f"{base}/_{uuid.uuid4().hex}"
        done: list[str] = []

        def close() -> None:
            if out is not None:
                out.close()
                system.move(own, f"{base}/{name}")
                done.append(name)

        for batch in batches:
            for device, part, data in zip(*(batch.column(c).to_pylist() for c in ("device", "_part", "data"))):
                if name != (new := f"{device}-{part:06d}.bin"):
                    close()
                    name, out = new, system.open_output_stream(own)
                out.write(data)
        close()
        yield pa.record_batch({"file": pa.array(done, pa.string())})

    rows = packets.where("data is not null").select(F.col("device").cast("string").alias("device"), F.floor(F.col("seq") / per_file).alias("_part"), "seq", "data")
    rows.repartition("device", "_part").sortWithinPartitions("device", "_part", "seq").mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()
