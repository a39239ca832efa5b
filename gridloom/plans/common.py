"""Pieces that the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import sweeps

#: The box in SQL.
IN_BOX = "x_mm BETWEEN -40000 AND 60000 AND y_mm BETWEEN -35000 AND 35000 AND z_mm BETWEEN -2500 AND 3000"
P = f"p AS ({sweeps.sql()})"
WIDE = f"p AS ({sweeps.sql(7)})"
SMALL = f"p AS ({sweeps.sql(1, 2000)})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense frames near the sensor."""
    return sweeps.from_lineitem(spark, sf_dir)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same seven times as far apart, over all zones."""
    return sweeps.from_lineitem(spark, sf_dir, 7)


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many frames of a few points."""
    return sweeps.from_lineitem(spark, sf_dir, 1, 2000)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two moving boxes for each frame of points()."""
    frames = points(spark, sf_dir).select("frame_id").distinct()
    b = frames.select("frame_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("b"))
    return b.select(
        "frame_id", F.col("b").alias("track_id"),
        *[F.expr(e).cast("bigint").alias(c) for c, e in (
            ("x_lo", "-6000 + b * 7000 + frame_id * 100"), ("x_hi", "-4000 + b * 7000 + frame_id * 100"),
            ("y_lo", "-2000 + b * 1500"), ("y_hi", "-500 + b * 1500"), ("z_lo", "-1700 + b * 200"), ("z_hi", "200 + b * 100"))],
    )


BOXES = """b AS (SELECT frame_id, b AS track_id, -6000 + b * 7000 + frame_id * 100 AS x_lo, -4000 + b * 7000 + frame_id * 100 AS x_hi, -2000 + b * 1500 AS y_lo,
  -500 + b * 1500 AS y_hi, -1700 + b * 200 AS z_lo, 200 + b * 100 AS z_hi FROM (SELECT DISTINCT frame_id FROM p), (VALUES (0), (1)) v(b))"""


def tracks(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """Three tracks a frame of points(), or of what was written of them, one of them nearly still; metres and metres a second."""
    frames = (points(spark, sf_dir) if own is None else own).select("frame_id").distinct()
    t = frames.select("frame_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("track_id"))
    f, k = F.col("frame_id").cast("double"), F.col("track_id").cast("double")
    t = t.select("frame_id", "track_id", (f * 0.5 - k * 3.0 + 1.25).alias("x"), (k * 1.5 - 2.0).alias("y"), (k * 2.0 - f * 0.125).alias("vx"), (0.5 - k * 0.25).alias("vy"), (k + 0.25).alias("length"), (k * 0.5 + 0.25).alias("width"))
    return t.withColumn("is_dynamic", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) >= 0.25)


TRACKS = """t0 AS (SELECT frame_id, k::INTEGER AS track_id, frame_id::DOUBLE * 0.5::DOUBLE - k * 3.0::DOUBLE + 1.25::DOUBLE AS x, k * 1.5::DOUBLE - 2.0::DOUBLE AS y, k * 2.0::DOUBLE - frame_id::DOUBLE * 0.125::DOUBLE AS vx,
  0.5::DOUBLE - k * 0.25::DOUBLE AS vy, k + 0.25::DOUBLE AS length, k * 0.5::DOUBLE + 0.25::DOUBLE AS width FROM (SELECT DISTINCT frame_id FROM p), (VALUES (0.0::DOUBLE), (1), (2)) v(k)),
t AS (SELECT *, sqrt(vx * vx + vy * vy) >= 0.25 AS is_dynamic FROM t0)"""


def greedy_sql(edges: str, by: str) -> str:
    """CTEs that go through rows one by one in order, for edges (by, better, worse): gone (by, worse), what an earlier row that is
    kept is in conflict with."""
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in by.split(", "))
    return f"""ww AS (SELECT {by}, worse, list(better) AS betters, row_number() OVER (PARTITION BY {by} ORDER BY worse) AS i FROM {edges} GROUP BY {by}, worse),
walk AS (SELECT DISTINCT {by}, 0::BIGINT AS i, []::BIGINT[] AS dead FROM ww UNION ALL
  SELECT {", ".join(f"ww.{c}" for c in by.split(", "))}, ww.i, CASE WHEN len(list_filter(ww.betters, lambda b: NOT list_contains(walk.dead, b::BIGINT))) > 0 THEN list_append(walk.dead, ww.worse::BIGINT) ELSE walk.dead END
  FROM walk JOIN ww ON {on("walk", "ww")} AND ww.i = walk.i + 1),
gone AS (SELECT {by}, unnest(dead) AS worse FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY i DESC) AS last FROM walk) WHERE last = 1)"""
