"""Repeatable pseudo-random numbers from identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*ids: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1), the same for the same identifiers and seed on any executor and in any order of rows."""
    h = F.xxhash64(*ids, F.lit(seed))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def salt(buckets: int, *ids: Column | str, seed: int = 77) -> Column:
    return F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(buckets)).cast("int")
