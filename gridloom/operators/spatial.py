"""Joins of leaves with hazards, obstacle points, semantic cells and neighbours.

Leaves have centres x_mm, y_mm and size_mm. Range joins are equi-joins on cells that one side is copied to, with the
exact condition kept, so that no frame is compared with itself row by row. What grows with the leaves is merged and never
broadcast: copies of cells compress far below the limit for it and fill the driver when they are unpacked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.config import BOUNDS, COSTS, GRID
from gridloom.operators.binning import cell
from gridloom.operators.cells import drivable


def centres(leaves: DataFrame) -> DataFrame:
    """leaves with x_mm, y_mm of their centre, in halves of a millimetre where sizes are odd."""
    at = lambda g, lo: (F.lit(lo) + (F.col(g) + 0.5) * F.col("size_mm")).cast("double")
    return leaves.withColumn("x_mm", at("gx", BOUNDS.x_min)).withColumn("y_mm", at("gy", BOUNDS.y_min))


def _covered(lo: Column, hi: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def in_circles(leaves: DataFrame, circles: DataFrame, size: int = 500) -> DataFrame:
    """frame_id, gx, gy, size_mm and the greatest cost of the circles (x, y, radius in millimetres, cost) around a leaf's centre."""
    c = circles.select(F.col("frame_id").alias("_f"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("radius").alias("_r"), F.col("cost").alias("_cost"))
    c = c.withColumn("_kx", _covered(F.col("_x") - F.col("_r"), F.col("_x") + F.col("_r"), size)).withColumn("_ky", _covered(F.col("_y") - F.col("_r"), F.col("_y") + F.col("_r"), size))
    l = leaves.withColumn("kx", F.floor(F.col("x_mm") / size)).withColumn("ky", F.floor(F.col("y_mm") / size))
    dx, dy = F.col("x_mm") - F.col("_x"), F.col("y_mm") - F.col("_y")
    hit = l.join(c.hint("merge"), (F.col("frame_id") == F.col("_f")) & (F.col("kx") == F.col("_kx")) & (F.col("ky") == F.col("_ky")) & (dx * dx + dy * dy <= F.col("_r") * F.col("_r")))
    return hit.groupBy("frame_id", "gx", "gy", "size_mm").agg(F.max("_cost").alias("hazard_cost"))


def stamp(leaves: DataFrame, circles: DataFrame) -> DataFrame:
    """leaves whose cost is raised to that of the hazards over them; hazard_cost says where it came from."""
    hit = in_circles(leaves, circles)
    joined = leaves.join(hit.hint("merge"), ["frame_id", "gx", "gy", "size_mm"], "left")
    return joined.withColumn("cost", F.greatest("cost", F.coalesce("hazard_cost", F.lit(0))))


def stamp_dropoffs(leaves: DataFrame, drops: DataFrame, radius: int = 600) -> DataFrame:
    """leaves near a drop-off are lethal whatever they were."""
    circles = drops.select("frame_id", F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), F.lit(radius).alias("radius"), F.lit(COSTS.lethal).alias("cost"))
    hit = in_circles(leaves, circles)
    return leaves.join(hit.hint("merge"), ["frame_id", "gx", "gy", "size_mm"], "left").withColumn("cost", F.coalesce("hazard_cost", "cost")).drop("hazard_cost")


def occupancy(leaves: DataFrame, obstacles: DataFrame, size: int = 250, least: int = 3) -> DataFrame:
    """leaves over enough obstacle points (above -1.30 m, counted in cells of size) are lethal, unless they are the road.

    z_max and dz rise with the points. A flat leaf without cost takes 5 points. leaves need z_min, z_max, dz, mean_z, cost.
    """
    bins = obstacles.where(F.col("z_mm") > -1300).groupBy("frame_id", cell("x_mm", size, BOUNDS.x_min).alias("bx"), cell("y_mm", size, BOUNDS.y_min).alias("by")).agg(F.count(F.lit(1)).alias("_n"), F.max("z_mm").alias("_z"))
    l = centres(leaves).drop("x_mm", "y_mm")
    first = lambda g: F.floor((F.col(g) * F.col("size_mm") + 0.1) / size)
    last = lambda g: F.floor(((F.col(g) + 1) * F.col("size_mm") - 0.1) / size)
    own = l.select("frame_id", "gx", "gy", "size_mm", F.explode(F.sequence(first("gx"), last("gx"))).alias("bx"), first("gy").alias("_a"), last("gy").alias("_b"))
    own = own.select("frame_id", "gx", "gy", "size_mm", "bx", F.explode(F.sequence("_a", "_b")).alias("by"))
    hit = own.join(bins.hint("merge"), ["frame_id", "bx", "by"]).groupBy("frame_id", "gx", "gy", "size_mm").agg(F.sum("_n").alias("_n"), F.max("_z").alias("_z")).where(F.col("_n") >= least)
    j = leaves.join(hit.hint("merge"), ["frame_id", "gx", "gy", "size_mm"], "left")
    j = j.withColumn("z_max", F.greatest("z_max", F.coalesce("_z", "z_max"))).withColumn("dz", F.greatest("dz", F.when(F.col("_z").isNotNull(), F.col("z_max") - F.col("z_min")).otherwise(F.col("dz"))))
    flat = (F.col("cost") == 0) & F.col("mean_z").between(-2150, -1350) & (F.col("dz") <= 150)
    lethal = F.col("_n").isNotNull() & (~flat | (F.col("_n") >= 5))
    cost = F.when(drivable(F.col("mean_z"), F.col("dz"), F.col("z_max")), 0).when(lethal, COSTS.lethal).otherwise(F.col("cost"))
    return j.withColumn("cost", cost).drop("_n", "_z")


def vegetation(leaves: DataFrame, points: DataFrame, most: int = 20) -> DataFrame:
    """leaves in a 0.5 m cell with rigid points (label 2) are lethal; with vegetation (label 1) they cost at most `most`,
    unless they stand high. leaves need mean_z, dz, z_max, cost."""
    key = lambda c, lo: cell(c, GRID.coarse, lo)
    marks = points.where("label IN (1, 2)").groupBy("frame_id", key("x_mm", BOUNDS.x_min).alias("_kx"), key("y_mm", BOUNDS.y_min).alias("_ky")).agg(F.max("label").alias("_label"))
    at = lambda g: F.floor((F.col(g) + 0.5) * F.col("size_mm") / GRID.coarse)
    j = leaves.withColumn("_kx", at("gx")).withColumn("_ky", at("gy")).join(marks.hint("merge"), ["frame_id", "_kx", "_ky"], "left")
    high = (F.col("dz") > 120) & ((F.col("mean_z") > -1200) | (F.col("z_max") > -1200))
    cost = F.when(F.col("_label") == 2, COSTS.lethal).when((F.col("_label") == 1) & ~high, F.least("cost", F.lit(most))).otherwise(F.col("cost"))
    return j.withColumn("cost", cost.cast("int")).drop("_kx", "_ky", "_label")


def local_drops(cells: DataFrame, least: int = 3) -> DataFrame:
    """Of each cell (gx, gy, z_um): baseline, the median height of its 3 x 3 neighbourhood with itself, and drop below it.

    Cells with fewer than `least` neighbours, themselves included, are left out.
    """
    offsets = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    sent = cells.select("frame_id", "gx", "gy", "z_um", F.explode(offsets).alias("o")).select("frame_id", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"), F.col("z_um").alias("_z"))
    base = sent.groupBy("frame_id", "gx", "gy").agg(F.count(F.lit(1)).alias("_n"), F.median("_z").alias("baseline")).where(F.col("_n") >= least)
    return cells.join(base, ["frame_id", "gx", "gy"]).withColumn("drop", F.col("baseline") - F.col("z_um")).drop("_n")


def costs_of_points(leaves: DataFrame, points: DataFrame, cost: int = 255, size: int = 500) -> DataFrame:
    """leaves that hold a point, borders included, cost at least `cost`.

    A leaf is copied to the cells of size that it touches, four at most; a point is in one, and points are not copied.
    """
    half = F.col("size_mm") / 2
    l = centres(leaves).select("frame_id", "gx", "gy", "size_mm", (F.col("x_mm") - half).alias("_x0"), (F.col("x_mm") + half).alias("_x1"), (F.col("y_mm") - half).alias("_y0"), (F.col("y_mm") + half).alias("_y1"))
    l = l.withColumn("_kx", _covered(F.col("_x0"), F.col("_x1"), size)).withColumn("_ky", _covered(F.col("_y0"), F.col("_y1"), size))
    p = points.select(F.col("frame_id").alias("_f"), F.col("x_mm").alias("_x"), F.col("y_mm").alias("_y"), F.floor(F.col("x_mm") / size).alias("_px"), F.floor(F.col("y_mm") / size).alias("_py"))
    on = (F.col("frame_id") == F.col("_f")) & (F.col("_kx") == F.col("_px")) & (F.col("_ky") == F.col("_py")) & F.col("_x").between(F.col("_x0"), F.col("_x1")) & F.col("_y").between(F.col("_y0"), F.col("_y1"))
    hit = l.join(p, on, "left_semi").select("frame_id", "gx", "gy", "size_mm", F.lit(cost).alias("_c")).distinct()
    return leaves.join(hit.hint("merge"), ["frame_id", "gx", "gy", "size_mm"], "left").withColumn("cost", F.greatest("cost", F.coalesce("_c", F.lit(0)))).drop("_c")
