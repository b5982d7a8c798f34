"""Integer helpers as column expressions, with plan-time forms in ``math``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leftmost_set_bit(x: Column) -> Column:
    """Position of the highest set bit counted from 1; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def next_power_of_2(x: Column) -> Column:
    """The least power of two that is at least x; 1 for 0 and 1."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, 1)") * F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1)) - 1))


def gcd(a: Column, b: Column, steps: int = 92) -> Column:
    """Greatest common divisor by Euclid's steps; 92 suffice for 64-bit integers."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        start,
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(s["a"] % s["b"]).cast("long").alias("b"))),
    )
    return done["a"]


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise((F.abs(a) / gcd(a, b)).cast("long") * F.abs(b))
