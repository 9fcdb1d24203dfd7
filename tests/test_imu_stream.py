"""Raw inertial bytes against a parser that goes byte by byte."""

import numpy as np
import pytest

from waypath.operators import imu

SCHEMA = "vehicle_id long, seq long, recv_us long, data binary"


def frame(kind, rng):
    body = bytes([0x55, kind, *rng.integers(0, 256, 8).astype(np.uint8)])
    return body + bytes([sum(body) % 256])


def stream(rng, n):
    """Frames with garbage, false headers, wrong sums, and headers inside of frames."""
    out = b""
    for _ in range(n):
        out += rng.choice([b"", b"", b"\x55", b"\x55\x51", b"\x00\x01\x02", b"\x55" * 12, bytes(rng.integers(0, 256, 7).astype(np.uint8))]).item() if rng.random() < 0.4 else b""
        one = frame(int(rng.choice([0x51, 0x52, 0x59, 0x53])), rng)
        if rng.random() < 0.1:
            one = one[:5] + b"\x55" + one[6:]
        if rng.random() < 0.1:
            one = one[: rng.integers(1, 11)]
        out += one
    return out


def cut(rng, data, most):
    reads = []
    while data:
        n = int(rng.integers(0, most + 1))
        reads.append(data[:n])
        data = data[n:]
    return reads


def sequential(reads):
    """(seq, recv_us, place, frame) as a buffer that is filled read by read gives them."""
    buffer, at, out = b"", 0, []
    for seq, recv, data in reads:
        buffer += data or b""
        while len(buffer) >= 11:
            if buffer[0] != 0x55 or sum(buffer[:10]) % 256 != buffer[10]:
                buffer, at = buffer[1:], at + 1
                continue
            out.append((seq, recv, at, buffer[:11]))
            buffer, at = buffer[11:], at + 11
    return out


def samples(frames):
    """(place, acceleration, turn, quaternion) as raw numbers, one for each turn with an acceleration since the last."""
    acc, quat, fresh, out = None, None, False, []
    for _, _, at, f in frames:
        v = np.frombuffer(f[2:10], "<i2").tolist()
        if f[1] == 0x51:
            acc, fresh = v, True
        elif f[1] == 0x59:
            quat = v
        elif f[1] == 0x52 and fresh:
            out.append((at, acc[:3], v[:3], quat))
            fresh = False
    return out


@pytest.mark.parametrize("block", [11, 64, 1000, 10**6])
def test_against_a_byte_loop(spark, block):
    rng = np.random.default_rng(block)
    runs = {v: [(10 * i + 3, 1000 + 50 * i, d) for i, d in enumerate(cut(rng, stream(rng, n), most))] for v, n, most in ((1, 150, 40), (2, 60, 3), (3, 40, 500), (4, 1, 9))}
    runs[5] = [(0, 1, b"\x55" * 40), (1, 2, None), (2, 3, b"")]
    runs[6] = [(0, 1, frame(0x51, rng)[:10])]
    rows = [(v, *r) for v, run in runs.items() for r in run]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = imu.imu_frames(df, block, span=50).collect()
    want = {v: sequential(run) for v, run in runs.items()}
    for v in runs:
        assert sorted((r.seq, r.recv_us, r.at, bytes(r.frame)) for r in got if r.vehicle_id == v) == want[v]
    assert sum(map(len, want.values())) > 150
    out = imu.decode_imu_stream(df, block, span=50).collect()
    for v in runs:
        mine = sorted((r.at, round(r.ax / imu.ACCELERATION), round(r.gz / imu.TURN), round(r.qw * 32768)) for r in out if r.vehicle_id == v)
        assert mine == [(at, a[0], g[2], q[0] if q else 32768) for at, a, g, q in samples(want[v])]


def test_moves_of_all_entries():
    rng = np.random.default_rng(9)
    data = stream(rng, 30)
    size = len(data) - 10
    for entry, move in enumerate(imu.block_moves(np.frombuffer(data, np.uint8), size)):
        at = entry
        while at < size:
            at += 11 if data[at] == 0x55 and len(data) >= at + 11 and sum(data[at : at + 10]) % 256 == data[at + 10] else 1
        assert move == at - size
    assert imu.imu_frames.__doc__ and imu.frame_starts(np.empty(0, np.uint8)).tolist() == []


def test_no_reads(spark):
    assert imu.decode_imu_stream(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        imu.imu_frames(spark.createDataFrame([], SCHEMA), 10)
