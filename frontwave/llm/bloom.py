"""A Bloom filter of fixed size over long keys, built by Spark's bitmap aggregates: one hash, ``2**bits`` bits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WIDTH = 4096


def build(keys: DataFrame, column: str, bits: int = 25) -> np.ndarray:
    """The filter's bytes: at most ``2**bits / 8`` of them reach the driver, whatever the number of keys."""
    place = F.pmod(F.col(column), F.lit(1 << bits))
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8 + 2 * _WIDTH, np.uint8)
    for p in parts:
        out[p.k * _WIDTH : p.k * _WIDTH + len(p.bits)] = np.frombuffer(bytes(p.bits), np.uint8)
    return out


def may_hold(bloom: np.ndarray, keys: np.ndarray, bits: int = 25) -> np.ndarray:
    """Whether each key may be among those the filter was built of. Spark's bitmap buckets hold 32,768 numbers from 1 on; 0 is in bucket 0."""
    place = keys.astype(np.int64) & ((1 << bits) - 1)
    bucket = np.where(place == 0, 0, 1 + (place - 1) // 32_768)
    bit = np.where(place == 0, 0, (place - 1) % 32_768)
    return (bloom[bucket * _WIDTH + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 > 0
