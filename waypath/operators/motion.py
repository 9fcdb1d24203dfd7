"""Motion of a scanner: propagation of inertial samples, points moved between frames, scans freed of their own motion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.functions.pose import quat, quat_rotate, vec
from waypath.functions.rotation import Matrix, mat_mul, mat_t_vec, mat_vec, transposed
from waypath.operators.scans import GRAVITY, bracketed, followed

Extrinsic = tuple[tuple[float, ...], tuple[float, float, float]]
#: Scanner to inertial sensor: rotation (row-major) and translation.
NONE: Extrinsic = ((1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 0))
KNOT = "vehicle_id long, scan_id long, seq long, t double, acc array<double>, gyr array<double>, vel array<double>, pos array<double>, rot array<double>"


def lit_matrix(extrinsic: Extrinsic) -> tuple[Matrix, tuple[Column, ...]]:
    return tuple(F.lit(float(v)) for v in extrinsic[0]), tuple(F.lit(float(v)) for v in extrinsic[1])


def transform_cloud(points: DataFrame, poses: DataFrame, extrinsic: Extrinsic = NONE, key: str = "scan_id") -> DataFrame:
    """points moved from the scanner to the world: by the extrinsic, then by the pose (key, px, py, pz, qx, qy, qz, qw) of their scan. Others are left out."""
    r, t = lit_matrix(extrinsic)
    body = tuple(a + b for a, b in zip(mat_vec(r, vec()), t))
    world = [a + F.col(f"p{c}") for a, c in zip(quat_rotate(quat(), body), "xyz")]
    moved = points.join(poses, key).withColumns(dict(zip(("_x", "_y", "_z"), world)))
    return moved.withColumns({c: F.col(f"_{c}") for c in "xyz"}).drop("_x", "_y", "_z", *(f"p{c}" for c in "xyz"), *(f"q{c}" for c in "xyzw"))


def undistort(points: DataFrame, knots: DataFrame, extrinsic: Extrinsic = NONE) -> DataFrame:
    """points (scan_id, seq, t in seconds, x, y, z) as if all were taken at their scan's end.

    knots: scan_id, seq, t, and arrays acc, gyr, vel, pos and rot (row-major); a scan's last knot is its end. A point is moved by the knot
    before it (rotation, velocity, position) and the one after it (acceleration, turn rate). Points at or before the first knot, and
    scans without two knots, stay as they are. Each point is moved once.
    """
    rows = bracketed(points, motions(knots, extrinsic), "_m")
    r, t = lit_matrix(extrinsic)
    rows = rows.withColumns({"_dt": F.col("t") - F.col("_m.t"), **{f"_b{i}": a + b for i, (a, b) in enumerate(zip(mat_vec(r, vec()), t))}})
    rows = rows.withColumns({"_sin": F.sin(F.col("_m.rate") * F.col("_dt")), "_cos": F.cos(F.col("_m.rate") * F.col("_dt")), "_along": sum((F.col(f"_m.axis{i}") * F.col(f"_b{i}") for i in (1, 2)), F.col("_m.axis0") * F.col("_b0"))})
    axis, b = [F.col(f"_m.axis{i}") for i in range(3)], [F.col(f"_b{i}") for i in range(3)]
    cross = [axis[1] * b[2] - axis[2] * b[1], axis[2] * b[0] - axis[0] * b[2], axis[0] * b[1] - axis[1] * b[0]]
    rows = rows.withColumns({f"_e{i}": b[i] * F.col("_cos") + cross[i] * F.col("_sin") + axis[i] * F.col("_along") * (1 - F.col("_cos")) for i in range(3)})
    moved = mat_vec(tuple(F.col(f"_m.m{i}") for i in range(9)), tuple(F.col(f"_e{i}") for i in range(3)))
    out = [v + F.col(f"_m.place{i}") + (F.col(f"_m.speed{i}") + F.col(f"_m.pull{i}") * F.col("_dt")) * F.col("_dt") for i, v in enumerate(moved)]
    rows = rows.withColumns({f"_{c}": F.coalesce(v, F.col(c)) for c, v in zip("xyz", out)})
    return rows.withColumns({c: F.col(f"_{c}") for c in "xyz"}).select(*points.columns)


def motions(knots: DataFrame, extrinsic: Extrinsic = NONE) -> DataFrame:
    """(scan_id, seq, t, _m): for each knot but a scan's last what moves a point after it to the scan's end.

    That is a turn about an axis at a rate, then a matrix and a place with speed and pull, all in the scanner's frame at the end: what is the same for all
    points of a knot is worked out once a knot, so that little is left to do a point.
    """
    state = F.struct("acc", "gyr", "vel", "pos", "rot")
    rows = followed(knots.select("scan_id", "seq", "t", state.alias("v"))).select("scan_id", "seq", "t", "head", F.col("tail.v").alias("tail"), F.col("end.v").alias("e"))

    def part(name: str, n: int) -> tuple[Column, ...]:
        return tuple(F.get(name, F.lit(i)) for i in range(n))

    r, t = lit_matrix(extrinsic)
    rate = F.sqrt(sum((F.get("tail.gyr", F.lit(i)) * F.get("tail.gyr", F.lit(i)) for i in (1, 2)), F.get("tail.gyr", F.lit(0)) * F.get("tail.gyr", F.lit(0))))
    rows = rows.withColumn("_rate", F.when(rate > 1e-7, rate).otherwise(rate * 0))  # the identity for rates of 1e-7 or less, however long they are held
    end = part("e.rot", 9)
    back = mat_mul(transposed(r), transposed(end))
    rows = rows.withColumns({f"_k{i}": v for i, v in enumerate(back)})
    back = tuple(F.col(f"_k{i}") for i in range(9))
    matrix = mat_mul(back, part("head.v.rot", 9))
    place = [a - b for a, b in zip(mat_vec(back, tuple(p - q for p, q in zip(part("head.v.pos", 3), part("e.pos", 3)))), mat_t_vec(r, t))]
    speed, pull = mat_vec(back, part("head.v.vel", 3)), [v / 2 for v in mat_vec(back, part("tail.acc", 3))]
    axis = [F.when(F.col("_rate") > 0, v / F.col("_rate")).otherwise(v * 0) for v in part("tail.gyr", 3)]
    names = {"t": F.col("head.t"), "rate": F.col("_rate"), **{f"{n}{i}": v for n, values in (("axis", axis), ("m", matrix), ("place", place), ("speed", speed), ("pull", pull)) for i, v in enumerate(values)}}
    return rows.select("scan_id", "seq", "t", F.struct(*(v.alias(n) for n, v in names.items())).alias("_m"))


def rotation_of(w: np.ndarray) -> np.ndarray:
    angle = float(np.linalg.norm(w))
    if angle <= 1e-7:
        return np.eye(3)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / angle
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def imu_propagate(imu: DataFrame, scans: DataFrame, init: DataFrame, previous_end: bool = False) -> DataFrame:
    """Knots of every scan, from dead reckoning of a run's inertial samples: KNOT, of which the last of a scan is its end.

    imu: vehicle_id, t (seconds), ax..az, gx..gz. scans: vehicle_id, scan_id, beg, end. init: vehicle_id, gravity_x..z, bias_x..z, norm (mean length
    of the acceleration at rest). Between two samples their means hold, acceleration scaled to GRAVITY. A scan uses the samples up to its
    end and the last one before; the time from the last sample to the end is bridged forward, also where the sample is past the end. previous_end: scans
    reach from the last one's end to their own begin, as simulators have them. A run starts at rest at the origin. The recursion makes a run one
    task; runs are independent. Vehicles without init or samples have no knots.
    """
    numbers = ("t", "ax", "ay", "az", "gx", "gy", "gz")
    samples = imu.select("vehicle_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("scan_id"), *(F.col(c).cast("double").alias(c) for c in numbers))
    marks = scans.select("vehicle_id", F.lit(1).alias("kind"), "scan_id", F.col("end").cast("double").alias("t"), F.col("beg").cast("double").alias("ax"), *(F.lit(0.0).alias(c) for c in ("ay", "az", "gx", "gy", "gz")))
    names = [f"{k}_{c}" for k in ("gravity", "bias") for c in "xyz"] + ["norm"]
    rows = samples.unionByName(marks).join(init.select("vehicle_id", *names), "vehicle_id")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["t", "kind", "scan_id"], kind="stable")
        gravity, bias, norm = df[names[:3]].iloc[0].to_numpy(), df[names[3:6]].iloc[0].to_numpy(), float(df["norm"].iloc[0])
        imu_rows, scan_rows = df[df.kind == 0], df[df.kind == 1]
        t, acc, gyr = imu_rows.t.to_numpy(), imu_rows[["ax", "ay", "az"]].to_numpy(), imu_rows[["gx", "gy", "gz"]].to_numpy()
        pos, vel, rot, out = np.zeros(3), np.zeros(3), np.eye(3), []
        last_end, last_acc, last_gyr, used = None, np.zeros(3), np.zeros(3), 0

        def step(dt: float, a: np.ndarray, w: np.ndarray) -> None:
            nonlocal pos, vel, rot
            pos, vel, rot = pos + vel * dt, vel + (rot @ a + gravity) * dt, rot @ rotation_of((w - bias) * dt)

        for scan, end, beg in zip(scan_rows.scan_id.to_numpy(), scan_rows.t.to_numpy(), scan_rows.ax.to_numpy()):
            last_end = beg if last_end is None else last_end
            begin, stop = (last_end, beg) if previous_end else (beg, end)
            upto = int(np.searchsorted(t, end, "right"))
            own = range(max(0, used - 1), upto)
            used = upto
            if len(own) < 1:
                continue
            knots = [(0.0, last_acc, last_gyr, vel, pos, rot)]
            mean_a, mean_w = acc[own[0]] * GRAVITY / norm, gyr[own[0]]
            for i, j in zip(own, own[1:]):
                if t[j] < last_end:
                    continue
                mean_a, mean_w = (acc[i] + acc[j]) / 2 * GRAVITY / norm, (gyr[i] + gyr[j]) / 2
                step(t[j] - max(t[i], last_end), mean_a, mean_w)
                last_acc, last_gyr = rot @ mean_a + gravity, mean_w - bias
                knots.append((t[j] - begin, last_acc, last_gyr, vel, pos, rot))
            step(abs(stop - t[own[-1]]), mean_a, mean_w)
            knots.append((stop - begin, last_acc, last_gyr, vel, pos, rot))
            last_end = stop
            out += [(scan, k, a, *(np.asarray(v).ravel().tolist() for v in rest)) for k, (a, *rest) in enumerate(knots)]
        got = pd.DataFrame(out, columns=["scan_id", "seq", "t", "acc", "gyr", "vel", "pos", "rot"])
        got.insert(0, "vehicle_id", df["vehicle_id"].iloc[0])
        return got

    return rows.groupBy("vehicle_id").applyInPandas(run, KNOT)
