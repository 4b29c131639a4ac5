"""Deterministic hash buckets, equal on every engine that has SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_32 = 4294967295.0


def _digest(key: Column) -> Column:
    return F.sha2(key.cast("string"), 256)


def unit_bucket(key: Column) -> Column:
    """First 32 digest bits scaled to [0, 1]."""
    return F.conv(F.substring(_digest(key), 1, 8), 16, 10).cast("double") / F.lit(MAX_32)


def audit_flag(sample_id: Column, rate: Column | float, seed: Column | int = 0) -> Column:
    """Stable audit draw: the same id and seed always give the same answer."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    rate = F.lit(rate) if isinstance(rate, float) else rate
    return unit_bucket(F.concat(sample_id.cast("string"), F.lit(":audit:"), seed.cast("string"))) < rate


def parity_bit(sample_id: Column) -> Column:
    """Digest modulo 2: the last hex digit decides."""
    return (F.conv(F.right(_digest(sample_id), F.lit(1)), 16, 10).cast("int") % 2).cast("int")


def sample_order(sample_id: Column, seed: int | str) -> Column:
    """Sort key of a seeded, repeatable shuffle (64 hex digits)."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), sample_id.cast("string")), 256)


def hash_cell(order_key: Column, hex_digits: int = 5) -> Column:
    """Leading digits of a sort key as an integer cell number."""
    return F.conv(F.substring(order_key, 1, hex_digits), 16, 10).cast("int")
