"""Pulse identity and its hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pulse_key(gps_time: str = "GpsTime", source: str = "PointSourceId", channel: Column | None = None) -> Column:
    """A struct that names a pulse: time in units of 1e-8 s, and source with scanner channel."""
    return F.struct(F.round(F.col(gps_time) * 1e8).cast("bigint").alias("time"), (F.col(source) * 64 + (F.lit(0) if channel is None else channel)).alias("device"))


def pulse_hash(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1), evenly spread over pulses and the same wherever a pulse is met, from 53 bits of its key's hash."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) * F.lit(2.0**-53)
