"""Random draws without a generator's state: each is a function of a seed and its own number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .values import GridError

#: Tries of one draw; more than one is needed with a chance below n / 2^63.
TRIES = 4


class Seeds:
    """A sequence of seeds, as a session's generator would give after it was seeded: each use takes the next."""

    def __init__(self, seed: int = 0) -> None:
        self._seed, self._used = seed, 0

    def set(self, seed: int) -> None:
        """Start again from that seed."""
        self._seed, self._used = seed, 0

    def next(self) -> int:
        self._used += 1
        return hash_seed(self._seed, self._used)


def hash_seed(seed: int, number: int) -> int:
    """A seed of 63 bits for the number-th use: two rounds of multiplying and shifting."""
    mask = (1 << 64) - 1
    x = (seed * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) & mask
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
    return (x ^ (x >> 32)) >> 1


def draw(number: Column, n: int, seed: int) -> Column:
    """A whole number in 0..n-1 for each `number`, all equally likely: hashes from the range that n divides, by rejection."""
    if n <= 0:
        raise GridError("E106", "nothing to draw from")
    most = (1 << 63) - (1 << 63) % n
    tries = [F.xxhash64(number, F.lit(seed), F.lit(t)).bitwiseAND((1 << 63) - 1) for t in range(TRIES)]
    fits = [F.when(x < most, x) for x in tries] if most < 1 << 63 else tries[:1]
    return F.coalesce(*fits, tries[-1]) % n


def draws(spark: SparkSession, size: int, n: int, seed: int) -> DataFrame:
    """(new, at): `size` numbered draws of 0..n-1, with replacement, made where they are used."""
    return spark.range(size).select(F.col("id").alias("__new"), draw(F.col("id"), n, seed).alias("__at"))
