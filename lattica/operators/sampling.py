"""Repeatable sampling: by row, by block, and a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MULTIPLIER, _RANGE = 2654435761, 1 << 32


def ticket(key: Column, seed: int) -> Column:
    """A number from 0 to 2^32 - 1 that integer key and seed decide."""
    mixed = F.pmod(F.pmod(key.cast("long"), F.lit(_RANGE)) * 1 + seed, F.lit(_RANGE))
    return F.pmod(F.pmod(mixed, F.lit(65536)) * _MULTIPLIER + F.floor(mixed / 65536).cast("long") * 40503, F.lit(_RANGE))


def bernoulli(df: DataFrame, key: Column, percent: float, seed: int = 0) -> DataFrame:
    """Each row by itself, with the chance of percent."""
    return df.where(ticket(key, seed) < int(percent / 100 * _RANGE))


def system(df: DataFrame, position: Column, percent: float, block_rows: int = 128, seed: int = 0) -> DataFrame:
    """Whole blocks of neighbouring positions."""
    return df.where(ticket(F.floor(position / block_rows), seed) < int(percent / 100 * _RANGE))


def system_rows(df: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer)."""
    return df.orderBy(ticket(key, seed), key).limit(n)
