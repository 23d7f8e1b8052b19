"""Reproducible randomness: a draw depends on its key only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits, which a double holds exactly.
_HEX_DIGITS = 13
_SPAN = float(16**_HEX_DIGITS)


def digest(seed: int, purpose: str, *key) -> Column:
    parts = [F.lit(str(seed)), F.lit(purpose)]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.md5(F.concat_ws("|", *parts))


def digest_prefix(column: Column, digits: int) -> Column:
    return F.conv(F.substring(column, 1, digits), 16, 10).cast("bigint")


def uniform(seed: int, purpose: str, *key) -> Column:
    """A double in [0, 1)."""
    return digest_prefix(digest(seed, purpose, *key), _HEX_DIGITS) / F.lit(_SPAN)


def pick(seed: int, purpose: str, size: Column, *key) -> Column:
    """An integer in [0, size)."""
    return F.floor(uniform(seed, purpose, *key) * size).cast("bigint")
