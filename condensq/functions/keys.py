"""Repeatable pseudo-random order from a key, the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(key: Column, seed) -> Column:
    """md5 text of key and seed; sorting by it shuffles the keys."""
    return F.md5(F.concat(key.cast("string"), F.lit("|"), F.lit(str(seed))))


def seeded_number(key: Column, seed) -> Column:
    """The first 32 bits of the digest as a number."""
    return F.conv(F.substring(seeded_digest(key, seed), 1, 8), 16, 10).cast("long")
