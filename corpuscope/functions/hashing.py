"""Seeded pseudo-random numbers that depend on the row's id alone.

``rand()`` depends on how rows are spread over partitions; a digest of
``(id, seed)`` gives the same draw on any cluster and after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DIGITS = 13  # hex digits = 52 bits, exact in a double


def hash_hex(*ids: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in ids], F.lit(str(seed))))


def hash_uniform(*ids: Column, seed: int = 42) -> Column:
    """Uniform draw in (0, 1)."""
    digits = F.substring(hash_hex(*ids, seed=seed), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** _DIGITS)
