"""Raster operators on sparse cells (frame_id, gx, gy): morphology, gap filling, coarsening and occupancy pixels.

Dilation of sparse cells copies them to their neighbours and erosion counts them, one axis at a time. Where several closings
of one frame are wanted at once, its grid, which the bounds limit, is an array in a task. Outside the grid there is nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.config import BOUNDS, GRID
from gridloom.operators.binning import around

KEY = ["frame_id", "gx", "gy"]
NX, NY = (BOUNDS.x_max - BOUNDS.x_min) // GRID.coarse, (BOUNDS.y_max - BOUNDS.y_min) // GRID.coarse


def _shift(cells: DataFrame, axis: str, reach: int) -> DataFrame:
    return cells.select(*[around(c, reach).alias(c) if c == axis else c for c in KEY])


def _inside(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    return cells.where(F.col("gx").between(0, nx - 1) & F.col("gy").between(0, ny - 1))


def dilated(cells: DataFrame, rx: int, ry: int, nx: int = NX, ny: int = NY) -> DataFrame:
    """Cells within a box of (2 rx + 1) by (2 ry + 1) of a cell."""
    return _inside(_shift(_shift(cells, "gx", rx).distinct(), "gy", ry).distinct(), nx, ny)


def eroded(cells: DataFrame, rx: int, ry: int) -> DataFrame:
    """Cells whose whole box is in the set."""
    for axis, r in (("gx", rx), ("gy", ry)):
        cells = _shift(cells, axis, r).groupBy(*KEY).count().where(F.col("count") == 2 * r + 1).select(*KEY)
    return cells


def closed(cells: DataFrame, rx: int, ry: int, nx: int = NX, ny: int = NY) -> DataFrame:
    """Dilation, then erosion."""
    return eroded(dilated(cells, rx, ry, nx, ny), rx, ry)


def cell_table(leaves: DataFrame) -> DataFrame:
    """Coarse cells of leaves: whether ground, and the height of the last ground leaf in micrometres."""
    quarter = F.col("size_mm") < GRID.coarse
    at = lambda g: F.when(quarter, F.expr(f"{g} div {GRID.coarse // GRID.fine}")).otherwise(F.col(g))
    ground = (F.col("cost") <= 50) & F.col("mean_z").between(-2100, -1350) & (F.col("dz") <= 180)
    z = F.round(F.col("mean_z") * 1000).cast("bigint")
    rows = leaves.select("frame_id", at("gx").alias("cx"), at("gy").alias("cy"), ground.alias("g"), F.when(ground, F.struct(F.col("size_mm") * -1, "gy", "gx", z.alias("z"))).alias("last"))
    return rows.groupBy("frame_id", F.col("cx").alias("gx"), F.col("cy").alias("gy")).agg(F.max("g").alias("ground"), F.max("last").alias("last")).select(*KEY, "ground", F.col("last.z").alias("z_um"))


def box_counts(grid: np.ndarray, rx: int, ry: int) -> np.ndarray:
    """Of each cell of a grid (rows along y), how many are set in its box of (2 rx + 1) by (2 ry + 1), by four look-ups in sums over
    all that is before; outside the grid there is nothing."""
    ny, nx = grid.shape
    total = np.zeros((ny + 1, nx + 1), np.int64)
    total[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)
    y, x = np.arange(ny), np.arange(nx)
    y0, y1, x0, x1 = np.maximum(y - ry, 0), np.minimum(y + ry + 1, ny), np.maximum(x - rx, 0), np.minimum(x + rx + 1, nx)
    return total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]


def closed_grid(grid: np.ndarray, rx: int, ry: int) -> np.ndarray:
    """Dilation, then erosion, of a dense grid."""
    return box_counts(box_counts(grid, rx, ry) > 0, rx, ry) == (2 * rx + 1) * (2 * ry + 1)


def bridged(cells: DataFrame, nx: int = NX, ny: int = NY) -> DataFrame:
    """Cells without leaves that one of four closings of the ground fills. A frame's grid of nx by ny is one array in a task."""

    def run(frame: pa.Table) -> pa.Table:
        gx, gy, ground = (frame.column(c).to_numpy() for c in ("gx", "gy", "ground"))
        there, grid = np.zeros((ny, nx), bool), np.zeros((ny, nx), bool)
        inside = (gx >= 0) & (gx < nx) & (gy >= 0) & (gy < ny)
        there[gy[inside], gx[inside]] = True
        grid[gy[inside & ground], gx[inside & ground]] = True
        filled = closed_grid(grid, 1, 1) | closed_grid(grid, 6, 3) | closed_grid(grid, 3, 4) | ((box_counts(grid, 1, 1) > 0) & closed_grid(grid, 2, 2))
        y, x = np.nonzero(filled & ~there)
        return pa.table({"frame_id": pa.array(np.full(len(x), frame.column("frame_id")[0].as_py()), pa.int64()), "gx": pa.array(x, pa.int64()), "gy": pa.array(y, pa.int64())})

    return cells.select(*KEY, F.coalesce("ground", F.lit(False)).alias("ground")).groupBy("frame_id").applyInArrow(run, "frame_id bigint, gx bigint, gy bigint")


def gaps(cells: DataFrame, holes: DataFrame) -> DataFrame:
    """Of each hole, along x and y: width of the gap between ground cells and their heights, null if a side is open."""
    ground = cells.where("ground").select(*KEY, "z_um", F.lit(False).alias("hole"))
    every = ground.unionByName(holes.select(*KEY, F.lit(None).cast("bigint").alias("z_um"), F.lit(True).alias("hole")))
    for axis, other in (("gx", "gy"), ("gy", "gx")):
        w = Window.partitionBy("frame_id", other).orderBy(axis)
        here = F.when(~F.col("hole"), F.struct(F.col(axis).alias("at"), "z_um"))
        before = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first(here, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        every = every.withColumn(f"_b{axis}", before).withColumn(f"_a{axis}", after)
    out = every.where("hole")
    for axis in ("gx", "gy"):
        a, b = F.col(f"_b{axis}"), F.col(f"_a{axis}")
        both = a.isNotNull() & b.isNotNull()
        out = out.withColumn(f"w_{axis}", F.when(both, b["at"] - a["at"] - 1)).withColumn(f"lo_{axis}", F.when(both, a["z_um"])).withColumn(f"hi_{axis}", F.when(both, b["z_um"]))
    return out.select(*KEY, *[f"{p}_{a}" for a in ("gx", "gy") for p in ("w", "lo", "hi")])


def smoothed(cells: DataFrame, holes: DataFrame, rx: int = 4, ry: int = 2, nx: int = NX, ny: int = NY) -> DataFrame:
    """Of each hole: sum and number of ground heights in its box, the grid mirrored at its borders."""
    ground = cells.where("ground").select(*KEY, "z_um")

    def mirrored(df: DataFrame, axis: str, n: int, r: int) -> DataFrame:
        c = F.col(axis)
        images = F.array(c, F.when(c < r, -1 - c), F.when(c >= n - r, 2 * n - 1 - c))
        return df.withColumn(axis, F.explode(F.filter(images, lambda v: v.isNotNull())))

    def sent(df: DataFrame, axis: str, r: int) -> DataFrame:
        return df.withColumn(axis, around(axis, r))

    spread = sent(sent(mirrored(mirrored(ground, "gx", nx, rx), "gy", ny, ry), "gx", rx), "gy", ry)
    # summed up before the join: the copies compress so well that they would be broadcast, at many times their size
    sums = spread.groupBy(*KEY).agg(F.sum("z_um").alias("sum_z"), F.count("z_um").alias("n_z")).hint("merge")
    return holes.select(*KEY).join(sums, KEY, "left").select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sum_z", "n_z")])


def inpainted(cells: DataFrame, nx: int = NX, ny: int = NY) -> DataFrame:
    """Cost and height (micrometres) of the holes that are filled; wide ones without two ground neighbours stay open."""
    holes = bridged(cells, nx, ny)
    g = gaps(cells, holes).join(smoothed(cells, holes, nx=nx, ny=ny).hint("merge"), KEY)
    ground = cells.where("ground").select(*KEY, "z_um")
    near = ground.withColumn("gx", around("gx", 1)).withColumn("gy", around("gy", 1)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("near"), F.min("z_um").alias("near_lo"), F.max("z_um").alias("near_hi"))
    g = g.join(near.hint("merge"), KEY, "left")
    wx, wy = F.coalesce("w_gx", F.lit(999)), F.coalesce("w_gy", F.lit(999))
    by_x, by_y = (wx <= wy) & (wx < 999), wy < 999
    pick = lambda p: F.when(by_x, F.col(f"{p}_gx")).when(by_y, F.col(f"{p}_gy")).otherwise(-1_600_000)
    g = g.withColumn("w", F.least(wx, wy)).withColumn("za", pick("lo")).withColumn("zb", pick("hi")).withColumn("dz1", F.abs(F.col("za") - F.col("zb")))
    raw = F.when(F.col("n_z") > 0, F.col("sum_z") / F.col("n_z")).otherwise(0.0)
    g = g.withColumn("raw", raw).withColumn("z", F.when(raw.between(-2_100_000, -1_350_000), raw).otherwise(-1_600_000.0))
    two = F.coalesce("near", F.lit(0)) >= 2
    g = g.withColumn("eff", F.when(two, F.col("near_hi") - F.col("near_lo")).otherwise(F.col("dz1"))).withColumn("low", F.when(two, F.col("near_lo")).otherwise(F.least("za", "zb")))
    eff, w = F.col("eff"), F.col("w")
    negative = (eff >= 200_000) | ((F.col("dz1") > 150_000) & (w <= 2)) | (F.col("low") < -2_000_000) | (F.col("raw") < -2_000_000)
    cost = F.when(negative, 255).when((w > 4) & ~two, None).when(w > 2, 100).when(eff <= 60_000, 0).otherwise(100)
    return g.withColumn("cost", cost).where("cost IS NOT NULL").select(*KEY, "cost", "w", F.round("z").cast("bigint").alias("z_um"))


def beam_gaps(leaves: DataFrame, most: int | None = None) -> DataFrame:
    """Empty cells between two flat ones of nearly the same height, along y before x: height in micrometres.

    At most `most` a frame, by row and column, if it is given: the pool that a bounded map would take them from.
    """
    own = leaves.where(f"size_mm = {GRID.coarse} AND cost <= 50").select(*KEY, (F.col("dz") < 50).alias("flat"), F.round(F.col("mean_z") * 1000).cast("bigint").alias("z"))
    out = None
    for rank, axis, other in ((0, "gy", "gx"), (1, "gx", "gy")):
        w = Window.partitionBy("frame_id", other).orderBy(axis)
        step = own.withColumn("_a", F.lead(axis).over(w)).withColumn("_f", F.lead("flat").over(w)).withColumn("_z", F.lead("z").over(w))
        hit = step.where((F.col("_a") == F.col(axis) + 2) & F.col("flat") & F.col("_f") & (F.abs(F.col("z") - F.col("_z")) < 100_000))
        hit = hit.select("frame_id", (F.col(axis) + 1).alias(axis), other, ((F.col("z") + F.col("_z")) / 2).alias("z_um"), F.lit(rank).alias("rank"))
        out = hit.select(*KEY, "z_um", "rank") if out is None else out.unionByName(hit.select(*KEY, "z_um", "rank"))
    found = out.join(own.select(*KEY), KEY, "left_anti").groupBy(*KEY).agg(F.min_by("z_um", "rank").alias("z_um"))
    if most is None:
        return found
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("frame_id").orderBy("gy", "gx"))).where(F.col("_r") <= most).drop("_r")


def coarsened(leaves: DataFrame) -> DataFrame:
    """Leaves after open ground is merged: size_mm 1000 for merged blocks (gx, gy count blocks), 750 at pinches, cost.

    A ground cell is wide if all its neighbours in the grid are ground, and a pinch if only its diagonal ones fail. Four
    wide cells of an even block merge, or three without a pinch or an obstacle. In a frame without any other cell all are wide.
    """
    mean, dz, cost = F.col("mean_z"), F.col("dz"), F.col("cost")
    flat = mean.between(-2000, -1350) & (dz <= 150)
    obstacle = ~flat & ((cost > 180) | (mean > -1200) | (dz > 250))
    whole = F.col("size_mm") == GRID.coarse
    ground = whole & (flat | (~obstacle & ((cost <= 50) | (mean.between(-2100, -1350) & (dz <= 150)))))
    l = leaves.withColumn("ground", ground).withColumn("cost", F.when(flat, 0).when(obstacle & whole, 255).otherwise(cost))
    g = l.where("ground")
    sent = g.select("frame_id", F.col("gx").alias("_x"), F.col("gy").alias("_y")).withColumn("gx", around("_x", 1)).withColumn("gy", around("_y", 1))
    straight = (F.col("gx") == F.col("_x")) | (F.col("gy") == F.col("_y"))
    seen = sent.groupBy(*KEY).agg((F.count(F.lit(1)) - 1).alias("_all"), (F.count_if(straight) - 1).alias("_straight"))
    cols = lambda c, n: F.when((F.col(c) == 0) | (F.col(c) == n - 1), 2).otherwise(3)
    want_all = cols("gx", NX) * cols("gy", NY) - 1
    want_straight = cols("gx", NX) + cols("gy", NY) - 2
    g = g.join(seen, KEY).withColumn("wide", F.col("_all") == want_all).withColumn("pinch", (F.col("_straight") == want_straight) & (F.col("_all") < want_all))
    block = [F.expr("gx div 2").alias("bx"), F.expr("gy div 2").alias("by_")]
    quarter = lambda c: F.expr(f"{c} div IF(size_mm < {GRID.coarse}, {GRID.coarse // GRID.fine * 2}, 2)")
    lethal = l.where("cost > 180").select("frame_id", quarter("gx").alias("bx"), quarter("gy").alias("by_")).distinct().withColumn("lethal", F.lit(True))
    stats = g.groupBy("frame_id", *block).agg(
        F.count_if("wide").alias("n_wide"), F.max("pinch").alias("pinched"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"), F.sum("n").alias("n"), F.avg("mean_z").alias("mean_z"),
    ).join(lethal, ["frame_id", "bx", "by_"], "left")
    merged = stats.where((F.col("n_wide") == 4) | ((F.col("n_wide") == 3) & ~F.col("pinched") & F.col("lethal").isNull()))
    tiles = merged.select("frame_id", F.lit(1000).alias("size_mm"), F.col("bx").alias("gx"), F.col("by_").alias("gy"), "z_min", "z_max", F.greatest(F.col("z_max") - F.col("z_min"), F.lit(20)).alias("dz"), "n", "mean_z", F.lit(0).alias("cost"))
    left = g.withColumn("bx", F.expr("gx div 2")).withColumn("by_", F.expr("gy div 2")).join(merged.select("frame_id", "bx", "by_"), ["frame_id", "bx", "by_"], "left_anti")
    left = left.withColumn("size_mm", F.when(F.col("pinch"), 750).otherwise(GRID.coarse)).withColumn("cost", F.when(F.col("pinch"), 100).when(F.col("wide"), 0).otherwise(F.col("cost")))
    columns = tiles.columns
    return l.where("NOT ground").select(*columns).unionByName(tiles).unionByName(left.select(*columns))


def occupancy_grid(leaves: DataFrame, hazards: DataFrame | None = None, pixels: int = 400, size: int = 100, x0: int = -20_000, y0: int = -20_000) -> DataFrame:
    """Pixels (row, col) of the occupancy raster with their value, 0, 50 or 100; unknown ones are absent.

    The leaf that comes last in order (coarse before fine, then by row and column) wins a pixel, and hazards
    (x, y, radius in millimetres, cost, rank) win over leaves. Both end pixels of a range are painted.
    """
    value = lambda c: F.when(c <= 50, 0).when(c <= 180, 50).otherwise(100)
    cut = lambda v: (v / size).cast("int")  # towards zero
    lo_x, lo_y = F.lit(BOUNDS.x_min) + F.col("gx") * F.col("size_mm"), F.lit(BOUNDS.y_min) + F.col("gy") * F.col("size_mm")
    seq = F.struct(F.lit(0).alias("layer"), (-F.col("size_mm")).cast("bigint").alias("o1"), F.col("gy").cast("bigint").alias("o2"), F.col("gx").cast("bigint").alias("o3"))
    rows = leaves.select("frame_id", cut(lo_x - x0).alias("c0"), cut(lo_x + F.col("size_mm") - x0).alias("c1"), cut(lo_y - y0).alias("r0"), cut(lo_y + F.col("size_mm") - y0).alias("r1"), value(F.col("cost")).alias("v"), seq.alias("seq"))
    if hazards is not None:
        x, y, r = F.col("x"), F.col("y"), F.col("radius")
        seq = F.struct(F.lit(1).alias("layer"), F.col("rank").cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2"), F.lit(0).cast("bigint").alias("o3"))
        rows = rows.unionByName(hazards.select("frame_id", cut(x - r - x0).alias("c0"), cut(x + r - x0).alias("c1"), cut(y - r - y0).alias("r0"), cut(y + r - y0).alias("r1"), F.when(F.col("cost") > 180, 100).otherwise(50).alias("v"), seq.alias("seq")))
    top = F.lit(pixels - 1)
    rows = rows.select("frame_id", "v", "seq", F.greatest("c0", F.lit(0)).alias("c0"), F.least("c1", top).alias("c1"), F.greatest("r0", F.lit(0)).alias("r0"), F.least("r1", top).alias("r1")).where("c0 <= c1 AND r0 <= r1")
    px = rows.withColumn("col", F.explode(F.sequence("c0", "c1"))).withColumn("row", F.explode(F.sequence("r0", "r1")))
    return px.groupBy("frame_id", "row", "col").agg(F.max(F.struct("seq", "v")).alias("m")).select("frame_id", "row", "col", F.col("m.v").alias("value"))


def grid_message(pixels_: DataFrame, pixels: int = 400, size: int = 100, x0: int = -20_000, y0: int = -20_000, time: DataFrame | None = None, name: str = "base_link") -> DataFrame:
    """A frame's raster as a message: header (stamp, frame name), info (resolution and origin in metres, width, height), and
    data, one row-major array of bytes, -1 where unknown, which a task fills from the pixels of a frame that are there.
    time: frame_id, t (epoch seconds); 0 without it."""
    from gridloom.operators.telemetry import stamp

    def run(frame: pa.Table) -> pa.Table:
        row, col, value = (frame.column(c).to_numpy() for c in ("row", "col", "value"))
        data = np.full(pixels * pixels, -1, np.int8)
        there = (row >= 0) & (row < pixels) & (col >= 0) & (col < pixels)
        data[row[there].astype(np.int64) * pixels + col[there]] = value[there]
        return pa.table({"frame_id": frame.column("frame_id").slice(0, 1), "data": pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data))})

    cells = pixels_.select("frame_id", *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("row", "col", "value")])
    whole = cells.groupBy("frame_id").applyInArrow(run, f"frame_id {dict(pixels_.dtypes)['frame_id']}, data array<tinyint>")
    whole = whole.withColumn("t", F.lit(0.0)) if time is None else whole.join(time, "frame_id", "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    header = F.struct(stamp(F.col("t")).alias("stamp"), F.lit(name).alias("frame"))
    info = F.struct(F.lit(size / 1000).alias("resolution"), F.lit(pixels).alias("width"), F.lit(pixels).alias("height"), F.lit(x0 / 1000).alias("origin_x"), F.lit(y0 / 1000).alias("origin_y"))
    return whole.select("frame_id", header.alias("header"), info.alias("info"), F.lit(pixels).alias("width"), F.lit(pixels).alias("height"), "data")
