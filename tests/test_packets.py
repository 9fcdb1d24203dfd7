"""Packet files: read in ranges by many tasks, against a plain walk from the start."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypath.sources import packets


def record(order, at, data, unit=1_000_000):
    s, part = divmod(at, unit)
    return b"".join(v.to_bytes(4, order) for v in (s, part, len(data), len(data))) + data


def capture(order="little", mark=0xA1B2C3D4, longest=65_535):
    return b"".join(v.to_bytes(n, order) for v, n in ((mark, 4), (2, 2), (4, 2), (0, 4), (0, 4), (longest, 4), (1, 4)))


def udp(port, data, last=7, kind=17, ether=b"\x08\x00"):
    ip = bytes([0x45, 0, 0, 0, 0, 0, 0, 0, 64, kind, 0, 0, 192, 168, 1, last, 192, 168, 1, 102])
    return bytes(12) + ether + ip + (9000).to_bytes(2, "big") + port.to_bytes(2, "big") + (8 + len(data)).to_bytes(2, "big") + bytes(2) + data


@pytest.mark.parametrize("split", [1, 40, 1000, 10**8])
def test_dumps(spark, tmp_path, split):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.bin").write_bytes(b"HEAD" + b"".join(bytes([7] * 4) + bytes([i] * 10) for i in range(50)) + b"cut")
    (tmp_path / "d/b.bin").write_bytes(b"HEAD")
    (tmp_path / "d/_x.bin").write_bytes(b"HEAD" + b"z" * 90)
    for path in (f"{tmp_path}/d", f"{tmp_path}/d/*.bin", f"file://{tmp_path}/d/a.bin")[: 1 if split == 1 else 3]:
        got = packets.read_packets(spark, path, 10, 4, 4, split)
        assert got.schema.simpleString() == "struct<device:string,seq:bigint,data:binary>"
        assert sorted((r.seq, bytes(r.data)) for r in got.collect()) == [(i, bytes([i] * 10)) for i in range(50)]
        assert got.rdd.getNumPartitions() == {1: 50, 40: 25, 1000: 1, 10**8: 1}[split]
        assert {r.device.rsplit("/", 1)[-1] for r in got.collect()} == {"a.bin"}


def test_large_dump_is_read_in_pieces(spark, tmp_path):
    n = 40_000
    data = np.random.default_rng(1).integers(0, 256, (n, 1248), dtype=np.uint8)
    (tmp_path / "big.bin").write_bytes(data.tobytes())
    rows = packets.read_packets(spark, f"{tmp_path}/big.bin", 1206, 42, split=6 << 20)
    assert rows.rdd.getNumPartitions() == 8
    got = rows.agg(F.count("*"), F.countDistinct("seq"), F.sum(F.crc32("data"))).first()
    import zlib

    assert tuple(got) == (n, n, sum(zlib.crc32(x.tobytes()) for x in data[:, 42:]))
    with pytest.raises(Exception, match="nothing"):
        packets.read_packets(spark, f"{tmp_path}/nothing").count()


@pytest.mark.parametrize("order, mark, unit", [("little", 0xA1B2C3D4, 10**6), ("big", 0xA1B2C3D4, 10**6), ("little", 0xA1B23C4D, 10**9)])
def test_captures(spark, tmp_path, order, mark, unit):
    rng = np.random.default_rng(3)
    out, want, t = capture(order, mark, 3000), [], 1_700_000_000 * 10**6
    inner = b"".join(record(order, t * unit // 10**6, udp(2368, bytes([i] * 9)), unit) for i in range(12))  # a payload that looks like records, up to its end
    for i in range(700):
        t += int(rng.integers(1, 900_000))
        kind = rng.integers(0, 12)
        if kind == 0:
            data = udp(2368, b"tcp", kind=6)
        elif kind == 1:
            data = bytes(rng.integers(0, 256, rng.integers(1, 41)).astype(np.uint8))
        else:
            port, last, body = int(rng.choice([2368, 2369])), int(rng.choice([7, 8])), inner if kind == 2 else bytes(rng.integers(0, 256, int(rng.choice([1206, 1212, 30]))).astype(np.uint8))
            data = udp(port, body, last)
            want.append((len(out), t, f"192.168.1.{last}", port, body))
        out += record(order, t * unit // 10**6, data, unit)
    out += record(order, t * unit // 10**6, udp(2368, b"the end is cut"), unit)[:-3]
    (tmp_path / "c.pcap").write_bytes(out)
    for split in (9_999, 10**8):
        got = packets.read_capture(spark, f"{tmp_path}/c.pcap", split=split).collect()
        assert sorted((r.seq, r.stamp_us, r.source, r.port, bytes(r.data)) for r in got) == want
    got = packets.read_capture(spark, f"{tmp_path}/c.pcap", 2369, "192.168.1.8", split=10_000).collect()
    assert sorted(r.seq for r in got) == [w[0] for w in want if w[2:4] == ("192.168.1.8", 2369)]


def test_damage_and_empty_captures(spark, tmp_path):
    head = capture(longest=2000)
    good = [record("little", (1_700_000_000 + i) * 10**6, udp(2368, bytes([i % 251]) * 100)) for i in range(300)]
    (tmp_path / "c.pcap").write_bytes(head + b"".join(good[:150]) + b"\xff" * 37 + b"".join(good[150:]))
    for split in (2_500, 10**8):
        assert packets.read_capture(spark, f"{tmp_path}/c.pcap", split=split).count() == 300
    (tmp_path / "e.pcap").write_bytes(head)
    assert packets.read_capture(spark, f"{tmp_path}/e.pcap").count() == 0
    (tmp_path / "x.pcap").write_bytes(b"no capture at all, but long enough")
    with pytest.raises(Exception, match="not a capture"):
        packets.read_capture(spark, f"{tmp_path}/x.pcap").count()


def test_round_trip(spark, tmp_path):
    rows = [(d, i, bytes([d, i]) * 5) for d in (1, 2) for i in range(23)] + [(1, 23, None)]
    packets.write_packets(spark.createDataFrame(rows, "device int, seq long, data binary").repartition(4), f"{tmp_path}/out", 10)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{d}-{k:06d}.bin" for d in (1, 2) for k in range(3)]
    back = packets.read_packets(spark, f"{tmp_path}/out", 10).withColumn("file", F.element_at(F.split("device", "/"), -1))
    assert sorted((int(r.file[0]), int(r.file[2:8]) * 10 + r.seq, bytes(r.data)) for r in back.collect()) == sorted(r for r in rows if r[2])
