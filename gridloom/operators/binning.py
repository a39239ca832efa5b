"""Helpers: cell numbers by floor, polar bins and the bucketed range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: str | Column, size: int, origin: int = 0) -> Column:
    """floor((c - origin) / size) of integers, also for negative ones."""
    v = (F.col(c) if isinstance(c, str) else c) - origin
    return ((v - F.pmod(v, F.lit(size))) / size).cast("bigint")


def around(key: str, reach: int = 1) -> Column:
    """One row for each number of key - reach .. key + reach."""
    return F.explode(F.sequence(F.col(key) - reach, F.col(key) + reach))


def near_join(left: DataFrame, right: DataFrame, radius: int, axes: tuple[str, ...] = ("x_mm", "y_mm", "z_mm"), how: str = "inner") -> DataFrame:
    """Pairs of a frame's rows within radius, as an equi-join on cells of that size with the exact distance as a condition.

    The right side is copied to the cells around it, so give the smaller one there. Columns keep their names on the left
    and get the prefix r_ on the right; d2 is the squared distance.
    """
    l = left
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    keys = []
    for a in axes:
        k = f"_k_{a}"
        l = l.withColumn(k, cell(a, radius))
        r = r.withColumn(f"_c_{a}", cell(f"r_{a}", radius)).withColumn(f"r{k}", around(f"_c_{a}")).drop(f"_c_{a}")
        keys.append(k)
    d2 = sum(((F.col(a) - F.col(f"r_{a}")) * (F.col(a) - F.col(f"r_{a}")) for a in axes), F.lit(0))
    on = F.col("frame_id") == F.col("r_frame_id")
    for k in keys:
        on = on & (F.col(k) == F.col(f"r{k}"))
    joined = l.join(r, on & (d2 <= radius * radius), how)
    return joined.drop(*keys, *[f"r{k}" for k in keys]) if how in ("left_semi", "left_anti") else joined.withColumn("d2", d2).drop(*keys, *[f"r{k}" for k in keys])
