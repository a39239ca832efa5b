"""Connected components by alternating large-star and small-star steps, with a written table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least neighbour (or itself) to its larger neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least smaller neighbour to the other smaller ones; a > b in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.filter("a <> b").distinct()


def components(tmp: Scratch, links: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): the least id that each linked id can reach, for every id but the least ones.

    Rounds grow with the logarithm of a component's length; a star takes one. Ids are not null.
    """
    edges = tmp.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        new = tmp.save(_small_star(_large_star(edges)), "edges")
        tmp.drop(edges)
        edges = new
        # done when every node either hangs on one other or has others hang on it
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
