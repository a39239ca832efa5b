"""Greedy choices in order, by rounds: a row is kept if no earlier kept row is in conflict with it.

What is the earliest among its conflicts is kept for certain, and what is in conflict with it goes for certain; without
those, others are the earliest. Rounds repeat until no conflict is left, and give what going through all rows one by one
gives. They are as many as the longest chain of conflicts is, and each works on all groups at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.tables import Tables


def losers(conflicts: DataFrame, by: list[str]) -> DataFrame:
    """by, worse: rows that are not kept, of conflicts (by, better, worse), each pair once, where better comes earlier."""
    tables = Tables(conflicts, "greedy")
    left, gone = tables.save(conflicts, "conflicts"), []
    while not left.isEmpty():
        first = left.select(*by, F.col("better").alias("row")).distinct().join(left.select(*by, F.col("worse").alias("row")).distinct(), [*by, "row"], "left_anti")
        out = tables.save(left.join(first.withColumnRenamed("row", "better"), [*by, "better"], "left_semi").select(*by, "worse").distinct(), "gone")
        gone.append(out)
        dead = out.withColumnRenamed("worse", "row")
        rest = left.join(dead.withColumnRenamed("row", "worse"), [*by, "worse"], "left_anti").join(dead.withColumnRenamed("row", "better"), [*by, "better"], "left_anti")
        rest = tables.save(rest, "conflicts")
        tables.drop(left)
        left = rest
    every = conflicts.select(*by, "worse").limit(0)
    for out in gone:
        every = every.unionByName(out)
    return every
