"""Rotation vectors and matrices as column expressions. A matrix is a row-major tuple of nine columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.functions.pose import Vec


Matrix = tuple[Column, ...]


def mat_vec(m: Matrix, v: Vec) -> Vec:
    return tuple(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3))


def mat_t_vec(m: Matrix, v: Vec) -> Vec:
    """The transposed matrix times v."""
    return tuple(m[i] * v[0] + m[3 + i] * v[1] + m[6 + i] * v[2] for i in range(3))


def mat_mul(a: Matrix, b: Matrix) -> Matrix:
    return tuple(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3))


def transposed(m: Matrix) -> Matrix:
    return tuple(m[3 * j + i] for i in range(3) for j in range(3))


def quat_to_matrix(q: tuple[Column, ...]) -> Matrix:
    """Of a quaternion x, y, z, w of any length; null for a zero one."""
    x, y, z, w = q
    n = F.nullif(x * x + y * y + z * z + w * w, F.lit(0.0))
    return (
        1 - 2 * (y * y + z * z) / n, 2 * (x * y - z * w) / n, 2 * (x * z + y * w) / n, 2 * (x * y + z * w) / n, 1 - 2 * (x * x + z * z) / n,
        2 * (y * z - x * w) / n, 2 * (x * z - y * w) / n, 2 * (y * z + x * w) / n, 1 - 2 * (x * x + y * y) / n,
    )


def four_rows(m: Matrix) -> tuple[tuple[Column, ...], ...]:
    """x, y, z, w of a rotation matrix, up to a factor, in four ways; the factor of row i is four times its i-th number, squared."""
    four = (1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8], 1 + m[0] + m[4] + m[8])
    return (
        (four[0], m[1] + m[3], m[2] + m[6], m[7] - m[5]), (m[1] + m[3], four[1], m[5] + m[7], m[2] - m[6]),
        (m[2] + m[6], m[5] + m[7], four[2], m[3] - m[1]), (m[7] - m[5], m[2] - m[6], m[3] - m[1], four[3]),
    )


def with_quat(df: DataFrame, m: Matrix, names: tuple[str, ...]) -> DataFrame:
    """df with x, y, z, w of a rotation matrix under these names: w >= 0, from the largest of the four squares, so that no division is by a small number.

    It takes steps of columns, as one expression of all would be too long for the compiler of generated code.
    """
    rows = four_rows(m)
    own = {f"_four{i}": rows[i][i] for i in range(4)}
    df = df.withColumns(own).withColumn("_most", F.greatest(*own))
    largest = [F.col(f"_four{i}") == F.col("_most") for i in range(4)]
    chosen = {f"_chosen{k}": F.when(largest[3], rows[3][k]).when(largest[2], rows[2][k]).when(largest[1], rows[1][k]).when(largest[0], rows[0][k]) for k in range(4)}
    scale = F.when(F.col("_chosen3") < 0, -1.0).otherwise(1.0)
    df = df.withColumns(chosen).withColumns({n: F.col(c) / (2 * F.sqrt("_most")) * scale for n, c in zip(names, chosen)})
    return df.drop(*own, "_most", *chosen)


def state_boxplus(pos: Vec, rot: Matrix, others: tuple[Column, ...], delta: tuple[Column, ...]) -> tuple[Vec, Matrix, tuple[Column, ...]]:
    """A state moved by delta: position (3), rotation (3, applied on the right), then as many as there are other numbers."""
    return tuple(a + b for a, b in zip(pos, delta[:3])), mat_mul(rot, so3_exp(delta[3:6])), tuple(a + b for a, b in zip(others, delta[6:]))


def state_boxminus(a: tuple[Vec, Matrix, tuple[Column, ...]], b: tuple[Vec, Matrix, tuple[Column, ...]]) -> tuple[Column, ...]:
    """The delta that takes b to a."""
    return (*(x - y for x, y in zip(a[0], b[0])), *so3_log(mat_mul(transposed(b[1]), a[1])), *(x - y for x, y in zip(a[2], b[2])))


def quat_to_euler_deg(q: tuple[Column, ...]) -> Vec:
    """Roll, pitch and yaw of a quaternion of any length, times 57.3 as the filter's own degrees are; close to a pole yaw is 0."""
    x, y, z, w = q
    unit, test = x * x + y * y + z * z + w * w, w * y - z * x
    pole = F.when(test > 0.49999 * unit, 1.0).when(test < -0.49999 * unit, -1.0)
    roll = F.coalesce(pole * 2 * F.atan2(x, w), F.atan2(2 * (x * w + y * z), w * w + z * z - x * x - y * y))
    pitch = F.coalesce(pole * (math.pi / 2), F.asin(2 * test / unit))
    yaw = F.when(pole.isNull(), F.atan2(2 * (z * w + x * y), w * w + x * x - y * y - z * z)).otherwise(0.0)
    return roll * 57.3, pitch * 57.3, yaw * 57.3


def so3_exp(w: Vec) -> tuple[Column, ...]:
    """Rotation by |w| about w; the identity for |w| of 1e-7 or less."""
    x, y, z = w
    angle = F.sqrt(x * x + y * y + z * z)
    small = angle <= 1e-7
    a = F.when(small, 0.0).otherwise(F.sin(angle) / angle)
    b = F.when(small, 0.0).otherwise((1 - F.cos(angle)) / (angle * angle))
    return (1 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y, b * x * y + a * z, 1 - b * (x * x + z * z), b * y * z - a * x, b * x * z - a * y, b * y * z + a * x, 1 - b * (x * x + y * y))


def so3_log(r: tuple[Column, ...]) -> Vec:
    """The rotation vector of a matrix, for angles below pi."""
    trace = r[0] + r[4] + r[8]
    angle = F.when(trace > 3 - 1e-6, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    k = F.when(F.abs(angle) < 0.001, 0.5).otherwise(0.5 * angle / F.sin(angle))
    return k * (r[7] - r[5]), k * (r[2] - r[6]), k * (r[3] - r[1])


def rotm_to_euler(r: tuple[Column, ...]) -> Vec:
    """Roll, pitch and yaw in radians; yaw is 0 where pitch is at a pole."""
    c = F.sqrt(r[0] * r[0] + r[3] * r[3])
    pole = c < 1e-6
    return F.when(pole, F.atan2(-r[5], r[4])).otherwise(F.atan2(r[7], r[8])), F.atan2(-r[6], c), F.when(pole, 0.0).otherwise(F.atan2(r[3], r[0]))
