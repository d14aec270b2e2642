"""Counter-based random numbers: a row's draws depend on a seed, its key and the number of the draw alone.

They are the same however rows are partitioned and when a task runs again, which ``rand`` does not promise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str, draw: int = 0) -> Column:
    """A number from 0 to below 1 for each key; null keys are keys too."""
    h = F.xxhash64(F.lit(seed).cast("long"), F.lit(draw), *keys)
    # a second round spreads keys that differ in few bits
    h = F.xxhash64(h, F.lit(seed ^ 0x5DEECE66D).cast("long"))
    return F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)


def normal(seed: int, *keys: Column | str, draw: int = 0) -> Column:
    """A standard normal number for each key, of two uniform ones."""
    u, v = uniform(seed, *keys, draw=2 * draw), uniform(~seed, *keys, draw=2 * draw + 1)
    return F.sqrt(-2 * F.log1p(-u)) * F.cos(2 * math.pi * v)


def below(n: Column | int, seed: int, *keys: Column | str, draw: int = 0) -> Column:
    """A whole number from 0 to below ``n``."""
    return F.floor(uniform(seed, *keys, draw=draw) * n).cast("long")
