"""Reproducible order and draws from md5, equal in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_order(key: Column | str, seed: int | str) -> Column:
    """Hex string by which rows are put in a seeded random order."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def md5_draw(key: Column, n: Column | int) -> Column:
    """Integer 0..n-1 from the first 32 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n


def md5_unit(key: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
