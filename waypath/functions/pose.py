"""Rotations and rigid motions as column expressions. Quaternions are x, y, z, w."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]
Vec = tuple[Column, Column, Column]


def quat_conj(q: Quat) -> Quat:
    return -q[0], -q[1], -q[2], q[3]


def quat_mul(a: Quat, b: Quat) -> Quat:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def quat_rotate(q: Quat, v: Vec) -> Vec:
    """v turned by q, which need not be of unit length; null for a zero quaternion."""
    x, y, z, w = q
    n = F.nullif(x * x + y * y + z * z + w * w, F.lit(0.0))
    tx, ty, tz = (2 * (y * v[2] - z * v[1]) / n, 2 * (z * v[0] - x * v[2]) / n, 2 * (x * v[1] - y * v[0]) / n)
    return (v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx)


def relative_translation(anchor_p: Vec, anchor_q: Quat, p: Vec) -> Vec:
    """Translation part of anchor^-1 * pose."""
    return quat_rotate(quat_conj(anchor_q), tuple(b - a for a, b in zip(anchor_p, p)))


def quat_to_yaw(q: Quat) -> Column:
    """First angle of the extrinsic z-y-x sequence, in radians."""
    x, y, z, w = q
    n = x * x + y * y + z * z + w * w
    return F.atan2(2 * (w * z - x * y) / n, 1 - 2 * (y * y + z * z) / n)


def yaw_to_quat(yaw: Column) -> Quat:
    """Of a turn about z, in radians."""
    return F.lit(0.0), F.lit(0.0), F.sin(yaw / 2), F.cos(yaw / 2)


def rigid_compose(p: Vec, q: Quat, p2: Vec, q2: Quat) -> tuple[Vec, Quat]:
    """The motion (p2, q2) followed by (p, q)."""
    return tuple(a + b for a, b in zip(p, quat_rotate(q, p2))), quat_mul(q, q2)


def rigid_inverse(p: Vec, q: Quat) -> tuple[Vec, Quat]:
    """Of a motion with a unit quaternion."""
    return tuple(-a for a in quat_rotate(quat_conj(q), p)), quat_conj(q)


def relative_pose(p: Vec, q: Quat, p2: Vec, q2: Quat) -> tuple[Vec, Quat]:
    """(p, q)^-1 (p2, q2)."""
    return relative_translation(p, q, p2), quat_mul(quat_conj(q), q2)


#: Pi as the filter's own degrees have it.
SHORT_PI = 3.14159265358


def deg2rad(a: Column) -> Column:
    return a * SHORT_PI / 180


def rad2deg(a: Column) -> Column:
    return a * 180 / SHORT_PI


def clamp(a: Column, least: float, most: float) -> Column:
    return F.least(F.greatest(a, F.lit(float(least))), F.lit(float(most)))


def wrap_pi(a: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def vec(prefix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")


def quat(prefix: str = "") -> Quat:
    return tuple(F.col(f"{prefix}q{c}") for c in "xyzw")
