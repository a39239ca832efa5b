"""Filters, samples and noise removal over points. Frames are independent: everything is keyed by frame_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.config import BOUNDS, Bounds
from gridloom.operators.binning import cell
from gridloom.operators.frames import fields, near_blocks, nearest_distances, places, whole_frames
from gridloom.schema import POINT
from gridloom.tables import Tables


def per_frame():
    """The window of a frame; made when it is asked for, as modules load before there is a session."""
    return Window.partitionBy("frame_id")



def within_bounds(points: DataFrame, b: Bounds = BOUNDS) -> DataFrame:
    """Points in a closed box; null coordinates drop out."""
    return points.where(F.col("x_mm").between(b.x_min, b.x_max) & F.col("y_mm").between(b.y_min, b.y_max) & F.col("z_mm").between(b.z_min, b.z_max))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose float columns are neither null, NaN nor infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.where(ok)


def to_millimetres(df: DataFrame) -> DataFrame:
    """x, y, z in metres and intensity in 0..1 to the integer columns; rows that are not finite go."""
    mm = lambda c: F.rint(F.col(c).cast("double") * 1000).cast("bigint").alias(f"{c}_mm")
    return finite(df, "x", "y", "z").select("frame_id", "point_idx", mm("x"), mm("y"), mm("z"), F.rint(F.coalesce("intensity", F.lit(0.5)).cast("double") * 100).cast("bigint").alias("i_pct"))


def decimate(points: DataFrame, above: int, stride: int) -> DataFrame:
    """Every stride-th point, in order, of frames with more than above points; other frames whole."""
    n, rank = F.count(F.lit(1)).over(per_frame()), F.row_number().over(per_frame().orderBy("point_idx"))
    return points.withColumn("_n", n).withColumn("_r", rank).where((F.col("_n") <= above) | ((F.col("_r") - 1) % stride == 0)).drop("_n", "_r")


def _voxel(size: int) -> list[Column]:
    return [cell(c, size).alias(f"_v{c}") for c in ("x_mm", "y_mm", "z_mm")]


def first_per_voxel(points: DataFrame, size: int = 150) -> DataFrame:
    """The first point of each voxel."""
    row = F.min(F.struct("point_idx", "x_mm", "y_mm", "z_mm", "i_pct")).alias("p")
    return points.groupBy("frame_id", *_voxel(size)).agg(row).select("frame_id", "p.*")


def dense_voxels(points: DataFrame, size: int, least: int) -> DataFrame:
    """Points whose voxel holds at least so many."""
    own = Window.partitionBy("frame_id", *_voxel(size))
    return points.withColumn("_n", F.count(F.lit(1)).over(own)).where(F.col("_n") >= least).drop("_n")


def dense_balls(points: DataFrame, radius: int, least: int) -> DataFrame:
    """Points with at least so many points, themselves included, within radius.

    A frame's points are in one task, compared within 27 cells of radius each, and are neither copied nor joined.
    """

    def dense(table: pa.Table, frames: np.ndarray) -> pa.Table:
        xyz = places(table, "x_mm", "y_mm", "z_mm")
        many = np.isfinite(xyz).all(1).astype(np.int64)
        known = many > 0
        for i, j in near_blocks(xyz, frames, radius):
            many += np.bincount(i, minlength=len(xyz)) + np.bincount(j, minlength=len(xyz))
        return table.filter(pa.array(known & (many >= least)))

    return whole_frames(points.where("frame_id IS NOT NULL"), dense, fields(points))


def strip_speckle(points: DataFrame, radius: int = 800, least: int = 4, small: int = 300) -> DataFrame:
    """Isolated points go: by balls in frames of up to small points, by voxels in larger ones."""
    sized = points.withColumn("_n", F.count(F.lit(1)).over(per_frame()))
    few, many = sized.where(F.col("_n") <= small).drop("_n"), sized.where(F.col("_n") > small).drop("_n")
    return dense_balls(few, radius, least).unionByName(dense_voxels(many, radius, least))


def dust_large(points: DataFrame, k: int = 15, reach: int = 55_000, least: int = 4) -> DataFrame:
    """Airborne dust goes from large frames.

    Within reach: sparse voxels of 0.8 m go; what is left is ground if at most 0.22 m above its 2 m cell's lowest point,
    and the rest stays only in 0.5 m voxels of at least 4 such points, and not at all if there are fewer than 4. Points
    beyond reach stay. Frames with k points or fewer within reach, before or after the first step, stay whole.
    """
    near = F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm") <= reach * reach
    p = points.withColumn("_near", near)
    count = lambda c: F.sum(c.cast("int")).over(per_frame())
    voxel = Window.partitionBy("frame_id", "_near", *_voxel(800))
    p = p.withColumn("_dense", F.col("_near") & (F.count(F.lit(1)).over(voxel) >= least))
    column = F.least(F.greatest(cell("x_mm", 2000, -25_000), F.lit(0)), F.lit(39))
    row = F.least(F.greatest(cell("y_mm", 2000, -20_000), F.lit(0)), F.lit(19))
    low = F.min("z_mm").over(Window.partitionBy("frame_id", "_dense", column, row))
    p = p.withColumn("_air", F.col("_dense") & (F.col("z_mm") - low > 220))
    airborne = F.count(F.lit(1)).over(Window.partitionBy("frame_id", "_air", *_voxel(500)))
    p = p.withColumn("_solid", F.col("_air") & (airborne >= 4))
    p = p.withColumn("_whole", (count(F.col("_near")) <= k) | (count(F.col("_dense")) <= k)).withColumn("_some", count(F.col("_air")) >= 4)
    keep = F.col("_whole") | ~F.col("_near") | (F.col("_dense") & ~F.col("_air")) | (F.col("_solid") & F.col("_some"))
    return p.where(keep).select(*points.columns)


def k_nearest(points: DataFrame, k: int) -> DataFrame:
    """frame_id, point_idx, other, d2: each point's k nearest other ones of its frame, all of them in frames of k or fewer others.

    Exact for frames of any size. Distances tie by the other's number. A point looks at the ring of cells around its own: if
    k points are there within one cell's size, no point outside can be nearer, and the point is done. The others look again in
    cells four times as large, until a cell holds the frame. The first size follows the frame's extent and number of points, so
    that most are done at once, with about as many candidates as 27 cells of k points hold.
    """
    axes = ("x_mm", "y_mm", "z_mm")
    tables = Tables(points, "nearest")
    span = [(F.max(c) - F.min(c)).alias(f"_s{c[0]}") for c in axes]
    frames = points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_n"), *span)
    wide = F.greatest("_sx", "_sy", "_sz") + 1
    start = F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt((F.col("_sx") + 1.0) * (F.col("_sy") + 1.0) * k / F.col("_n"))))).cast("bigint")
    own = points.select("frame_id", "point_idx", *axes).join(frames.select("frame_id", "_n", wide.alias("_wide"), F.greatest(start, F.lit(64)).alias("_size")), "frame_id")
    all_points = tables.save(own.where(F.col("_n") > 1), "points")
    left, done = all_points, []
    while not left.isEmpty():
        key = lambda c: F.floor(F.col(c) / F.col("_size"))
        seek = left
        for c in axes:
            seek = seek.withColumn(f"_k{c[0]}", F.explode(F.sequence(key(c) - 1, key(c) + 1)))
        seek = seek.select("frame_id", "point_idx", *[F.col(c).alias(f"_a{c[0]}") for c in axes], "_kx", "_ky", "_kz", "_n", "_wide", "_size")
        sizes = left.select("frame_id", "_size").distinct()
        held = all_points.drop("_size").join(sizes, "frame_id").select("frame_id", F.col("point_idx").alias("other"), *axes, *[key(c).alias(f"_k{c[0]}") for c in axes])
        d2 = sum(((F.col(c) - F.col(f"_a{c[0]}")) * (F.col(c) - F.col(f"_a{c[0]}")) for c in axes), F.lit(0))
        pairs = seek.join(held, ["frame_id", "_kx", "_ky", "_kz"]).where("other <> point_idx").withColumn("d2", d2)
        order = Window.partitionBy("frame_id", "point_idx").orderBy("d2", "other")
        near = pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        found = near.groupBy("frame_id", "point_idx").agg(F.max("d2").alias("_far"), F.count(F.lit(1)).alias("_m"), F.collect_list(F.struct("other", "d2")).alias("_near"))  # k of them at most
        both = left.join(found, ["frame_id", "point_idx"], "left")
        sure = (F.col("_size") >= F.col("_wide")) | (F.coalesce("_m", F.lit(0)) == k) & (F.col("_far") <= F.col("_size") * F.col("_size"))
        both = tables.save(both.withColumn("_sure", F.coalesce(sure, F.lit(False))), "round")
        done.append(both.where("_sure").select("frame_id", "point_idx", F.explode("_near").alias("p")).select("frame_id", "point_idx", "p.*"))
        left = both.where("NOT _sure").drop("_far", "_m", "_near", "_sure").withColumn("_size", F.col("_size") * 4)
    out = all_points.select("frame_id", "point_idx", F.col("point_idx").alias("other"), F.col("x_mm").alias("d2")).limit(0) if not done else done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


#: Points of a frame up to which all of its pairs are compared in one task; larger frames are exchanged by cells, in k_nearest().
DIRECT = 2048


def _lone(um: np.ndarray, frames: np.ndarray, k: int, ratio: float) -> np.ndarray:
    """Whether a point's distances exceed what its frame allows; frames are numbers of points that stand together."""
    start = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1))
    n = np.diff(start, append=len(um))
    s, q = np.add.reduceat(um, start), np.add.reduceat(um.astype(float) * um, start)
    mean = s / n
    var = q / n - mean * mean
    cut = np.where((n > k) & (var > (k * 1e-3) ** 2), mean + ratio * np.sqrt(np.maximum(var, 0.0)), np.inf)
    return um > np.repeat(cut, n)


def _dust_direct(points: DataFrame, k: int, ratio: float) -> DataFrame:
    """points (with _near) that stay, by all pairs of each frame in one task."""
    kept = points.drop("_near")
    columns = kept.columns

    def stay(table: pa.Table, frames: np.ndarray) -> pa.Table:
        near = np.flatnonzero(table["_near"].to_numpy())
        gone = np.zeros(len(frames), bool)
        if len(near):
            xyz = np.column_stack([table[c].fill_null(0).to_numpy().astype(np.int64) for c in ("x_mm", "y_mm", "z_mm")])[near]
            d2 = nearest_distances(xyz, frames[near], k)
            um = np.where(d2 < 0, 0, np.floor(np.sqrt(np.maximum(d2, 0)) * 1000 + 0.5)).astype(np.int64).sum(1)
            some = d2[:, 0] >= 0  # a point without any other one has no distance
            gone[near[some]] = _lone(um[some], frames[near][some], k, ratio) if some.any() else False
        return table.select(columns).filter(pa.array(~gone))

    return whole_frames(points, stay, fields(kept))


def _dust_by_cells(points: DataFrame, k: int, ratio: float) -> DataFrame:
    """The same by k_nearest(), for frames of any size."""
    nearest = k_nearest(points.where("_near"), k)
    # sums of whole micrometres do not depend on the order of rows
    total = nearest.groupBy("frame_id", "point_idx").agg(F.sum(F.round(F.sqrt("d2") * 1000).cast("bigint")).alias("um"))
    stats = total.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("um").alias("s"), F.sum(F.col("um").cast("double") * F.col("um")).alias("q"))
    mean, var = F.col("s") / F.col("n"), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    cut = stats.where(F.col("n") > k).select("frame_id", (mean + ratio * F.sqrt(F.greatest(var, F.lit(0.0)))).alias("cut"), (var <= (k * 1e-3) ** 2).alias("same"))
    gone = total.join(cut, "frame_id").where("NOT same AND um > cut").select("frame_id", "point_idx")
    return points.drop("_near").join(gone, ["frame_id", "point_idx"], "left_anti")


def dust_small(points: DataFrame, k: int = 15, ratio: float = 2.0, reach: int = 55_000, direct: int = DIRECT) -> DataFrame:
    """Points of small frames whose mean distance to their k nearest is at most mean + ratio standard deviations.

    Exact: by all pairs in frames of up to `direct` points within reach, whose points are neither copied nor joined, and by
    k_nearest() in larger ones. Frames with k points or fewer, or without spread, stay whole; points beyond reach stay.
    """
    near = (F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm") <= reach * reach) & F.col("z_mm").isNotNull() & F.col("frame_id").isNotNull()
    p = points.withColumn("_near", F.coalesce(near, F.lit(False)))
    if p.where("_near").groupBy("frame_id").count().where(F.col("count") > direct).isEmpty():
        return _dust_direct(p, k, ratio)
    sized = p.withColumn("_n", F.count_if("_near").over(per_frame()))
    few, many = sized.where(F.col("_n") <= direct).drop("_n"), sized.where(F.col("_n") > direct).drop("_n")
    return _dust_direct(few, k, ratio).unionByName(_dust_by_cells(many, k, ratio))


def dust(points: DataFrame, small: int = 1500) -> DataFrame:
    """Dust goes from each frame by the rule for its size: dust_small() for frames of up to `small` points, else dust_large()."""
    sized = points.withColumn("_n", F.count(F.lit(1)).over(per_frame()))
    few, many = sized.where(F.col("_n") <= small).drop("_n"), sized.where(F.col("_n") > small).drop("_n")
    return dust_small(few).unionByName(dust_large(many))


def outside_boxes(points: DataFrame, boxes: DataFrame, margin: int = 200) -> DataFrame:
    """Points in none of their frame's boxes (x_lo, x_hi, y_lo, y_hi, z_lo, z_hi) grown by margin; boxes come a few a frame."""
    b = boxes.select(F.col("frame_id").alias("_f"), *[F.col(f"{a}_{e}").alias(f"_{a}_{e}") for a in "xyz" for e in ("lo", "hi")])
    inside = F.col("frame_id") == F.col("_f")
    for a in "xyz":
        inside = inside & F.col(f"{a}_mm").between(F.col(f"_{a}_lo") - margin, F.col(f"_{a}_hi") + margin)
    return points.join(b, inside, "left_anti")


def radial(points: DataFrame, reach: int = 100_000) -> DataFrame:
    """Points within reach of the sensor, seen from above."""
    return points.where(F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm") <= reach * reach)


def moving(tracks: DataFrame, least: float = 0.15) -> DataFrame:
    """Tracks at least so fast."""
    return tracks.where(F.hypot("vx", "vy") >= least)


def detector_range(boxes: DataFrame) -> DataFrame:
    """Counts of a frame's detections inside and outside the detector's box of 51.2 m by 51.2 m and -5 to 3 m."""
    inside = F.col("x_mm").between(-51_200, 51_200) & F.col("y_mm").between(-51_200, 51_200) & F.col("z_mm").between(-5000, 3000)
    return boxes.groupBy("frame_id").agg(F.count_if(inside).alias("valid"), F.count_if(~inside).alias("discarded"))


def columns(points: DataFrame) -> DataFrame:
    """The point columns, in order."""
    return points.select(*POINT)
