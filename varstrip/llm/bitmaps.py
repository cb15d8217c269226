"""Which keys of a table are asked for, as a bitmap of fixed size that tasks filter by.

A bit that several keys share only lets a needless row through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Which of ``bits`` places the column ``key`` takes."""
    place = keys.select((F.pmod("key", F.lit(bits)) + 1).alias("at")).select((F.bitmap_bucket_number("at") - 1).alias("bucket"), F.bitmap_bit_position("at").alias("at"))
    out = np.zeros((-(-bits // 32768), 4096), np.uint8)
    for r in place.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        out[r.bucket] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def holds(taken: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``keys`` have their bit set."""
    at = keys % bits
    return taken[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
