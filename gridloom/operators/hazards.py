"""Drop-offs along rays and forecasts of moving tracks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.points import per_frame

SECTORS = 64
HORIZONS = (1.0, 2.0, 3.0)
VERTICES = 16


def dropoffs(ground: DataFrame, gap: int = 400, drop: int = 150, least: int = 50) -> DataFrame:
    """Ground points behind which their ray has a gap and lower ground: frame_id, point_idx, x, y, z, drop."""
    x, y = F.col("x_mm").cast("double"), F.col("y_mm").cast("double")
    sector = F.least(F.greatest(F.floor((F.atan2(y, x) + math.pi) / (2 * math.pi / SECTORS)), F.lit(0)), F.lit(SECTORS - 1))
    p = ground.withColumn("_n", F.count(F.lit(1)).over(per_frame())).where(F.col("_n") >= least).withColumn("_s", sector).withColumn("_r", F.sqrt(x * x + y * y))
    ray = Window.partitionBy("frame_id", "_s").orderBy("_r", "point_idx")
    p = p.withColumn("_dr", F.lead("_r").over(ray) - F.col("_r")).withColumn("drop_mm", F.col("z_mm") - F.lead("z_mm").over(ray))
    return p.where((F.col("_dr") >= gap) & (F.col("drop_mm") >= drop)).select("frame_id", "point_idx", "x_mm", "y_mm", "z_mm", "drop_mm")


def _ahead(tracks: DataFrame) -> DataFrame:
    t = tracks.where("is_dynamic").withColumn("t", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    return t.withColumn("cx", F.col("x") + F.col("vx") * F.col("t")).withColumn("cy", F.col("y") + F.col("vy") * F.col("t"))


def cones(tracks: DataFrame, least: float = 0.5) -> DataFrame:
    """Ellipses that moving tracks may reach in 1, 2 and 3 seconds, with a polygon of 16 vertices; metres."""
    h = _ahead(tracks)
    speed, heading = F.hypot("vx", "vy"), F.atan2("vy", "vx")
    a = F.greatest(F.col("length"), F.lit(least)) / 2 + 0.12 * speed * F.col("t") + 0.15 * F.col("t")
    b = F.greatest(F.col("width"), F.lit(least)) / 2 + 0.08 * F.col("t") + 0.10
    h = h.withColumn("semi_major", a).withColumn("semi_minor", b).withColumn("heading", heading)

    def vertex(i):
        angle = i * (2 * math.pi / VERTICES)
        ex, ey = F.col("semi_major") * F.cos(angle), F.col("semi_minor") * F.sin(angle)
        c, s = F.cos("heading"), F.sin("heading")
        return F.struct((F.col("cx") + ex * c - ey * s).alias("x"), (F.col("cy") + ex * s + ey * c).alias("y"))

    return h.withColumn("polygon", F.transform(F.sequence(F.lit(0), F.lit(VERTICES - 1)), vertex)).select("frame_id", "track_id", "t", "cx", "cy", "semi_major", "semi_minor", "heading", "polygon")


def nearest_hazards(tracks: DataFrame, most: int = 5, least: float = 0.5) -> DataFrame:
    """The circles nearest to the sensor that moving tracks may reach: x, y, radius, cost by horizon."""
    h = _ahead(tracks).withColumn("d2", F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))
    h = h.withColumn("rank", F.row_number().over(per_frame().orderBy("d2", "track_id", "t"))).where(F.col("rank") <= most)
    radius = F.greatest(F.col("width"), F.lit(least)) / 2 + 0.08 * F.col("t") + 0.05
    return h.select("frame_id", "rank", "track_id", "t", F.col("cx").alias("x"), F.col("cy").alias("y"), radius.alias("radius"), F.when(F.col("t") <= 1, 255).when(F.col("t") <= 2, 180).otherwise(120).alias("cost"))
