"""Ranges of a key: numbered pieces of the key's order, so that windows over that order never run in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAN = 64


def bounds(rows: DataFrame, key: str, rows_each: int = 65_536, most: int = _FAN * _FAN) -> list[int]:
    """Rising bounds of ranges of about ``rows_each`` rows, at most ``most`` ranges: approximate quantiles, one scan for the number of rows and one for these."""
    wanted = min(most, -(-rows.count() // rows_each))
    if wanted < 2:
        return []
    return sorted(set(rows.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 10_000)).first()[0] or []))


def number(key: Column, limits: list[int]) -> Column:
    """How many limits are below a key, by two short searches."""
    if not limits:
        return F.lit(0)
    tops = limits[_FAN - 1 :: _FAN]
    rows = F.array(*[F.array(*map(F.lit, limits[i * _FAN : i * _FAN + _FAN - 1])).cast("array<bigint>") for i in range(len(tops) + 1)])
    top = F.size(F.filter(F.array(*map(F.lit, tops)), lambda b: b < key)) if tops else F.lit(0)
    return top * _FAN + F.size(F.filter(F.element_at(rows, top + 1), lambda b: b < key))
