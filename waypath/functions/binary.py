"""Numbers out of BINARY columns. Offsets count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, offset: Column | int) -> Column:
    at = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    return F.conv(F.hex(F.substr(data, at, F.lit(1))), 16, 10).cast("int")


def u16le(data: Column, offset: Column | int) -> Column:
    return byte_at(data, offset) + 256 * byte_at(data, offset + 1)


def u16be(data: Column, offset: Column | int) -> Column:
    return 256 * byte_at(data, offset) + byte_at(data, offset + 1)


def u32le(data: Column, offset: Column | int) -> Column:
    return u16le(data, offset).cast("long") + 65536 * u16le(data, offset + 2).cast("long")


def i16be(data: Column, offset: Column | int, compat: bool = False) -> Column:
    """Two's complement; with compat negative numbers are one higher, as a driver that takes off 65535 has them."""
    v = u16be(data, offset)
    return F.when(v > 32767, v - (65535 if compat else 65536)).otherwise(v)


def i16le(data: Column, offset: Column | int) -> Column:
    v = u16le(data, offset)
    return F.when(v > 32767, v - 65536).otherwise(v)


def byte_sum(data: Column, n: int) -> Column:
    """Sum of the first n bytes, modulo 256."""
    return sum((byte_at(data, i) for i in range(1, n)), byte_at(data, 0)) % 256
