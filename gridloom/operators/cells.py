"""Elevation cells: statistics, adaptive and foveated grids, and traversability cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.config import BOUNDS, COSTS, GRID, Bounds
from gridloom.operators.binning import cell
from gridloom.operators.frames import whole_frames
from gridloom.operators.greedy import losers
from gridloom.operators.points import within_bounds

#: Zones: outer radius and cell size.
ZONES = ((10_000, 50), (25_000, 100), (50_000, 250), (100_000, 500))


def slope(dz: Column, size: Column | int, above: int = 10) -> Column:
    """Degrees of a rise of dz over size; 0 for a rise of up to above."""
    return F.when(dz > above, F.degrees(F.atan2(dz.cast("double"), (F.lit(size) if isinstance(size, int) else size).cast("double")))).otherwise(0.0)


def statistics(points: DataFrame, size: int, extra: list[Column] | None = None) -> DataFrame:
    """Of each cell: z_min, z_max, dz, n, sum_z, the population variance in square metres and the slope."""
    z = F.col("z_mm")
    own = points.groupBy("frame_id", cell("x_mm", size).alias("gx"), cell("y_mm", size).alias("gy"))
    s = own.agg(F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.count(F.lit(1)).alias("n"), F.sum(z).alias("sum_z"), F.sum(z * z).alias("_q"), *(extra or []))
    # exact in integers up to the last step
    var = (F.col("n") * F.col("_q") - F.col("sum_z") * F.col("sum_z")).cast("double") / (F.col("n") * F.col("n")).cast("double") / 1e6
    s = s.withColumn("dz", F.col("z_max") - F.col("z_min")).withColumn("variance", var)
    return s.withColumn("slope", slope(F.col("dz"), size, 9)).drop("_q")


def coarse(points: DataFrame, b: Bounds = BOUNDS, size: int = GRID.coarse) -> DataFrame:
    """Aggregates of the coarse grid; points need a cost column (0 where nothing is known)."""
    top = (b.x_max - b.x_min) // size - 1, (b.y_max - b.y_min) // size - 1
    gx, gy = F.least(cell("x_mm", size, b.x_min), F.lit(top[0])), F.least(cell("y_mm", size, b.y_min), F.lit(top[1]))
    z = F.col("z_mm")
    return points.groupBy("frame_id", gx.alias("gx"), gy.alias("gy")).agg(
        F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.count(F.lit(1)).alias("n"), F.sum(z).alias("sum_z"),
        F.count_if((z > -1200) | (F.col("cost") > COSTS.caution)).alias("n_obstacle"),
        F.count_if(z.between(-2100, -1350)).alias("n_ground"), F.max("cost").alias("point_cost"),
    )


def classify(cells: DataFrame) -> DataFrame:
    """kind of each coarse cell: sparse, solid, fine (to be refined) or coarse."""
    n, dz = F.col("n"), F.col("z_max") - F.col("z_min")
    active = n >= GRID.least_points
    flat = (F.col("sum_z") >= -2150 * n) & (F.col("sum_z") <= -1350 * n) & (dz <= 200)
    refine = ~flat & ((dz > GRID.step) | (F.col("z_max") > -1200) | (F.col("point_cost") > COSTS.safe))
    solid = ~flat & ((F.col("n_obstacle") >= 2) | (F.col("point_cost") > COSTS.caution))
    return cells.withColumn("kind", F.when(~active, "sparse").when(solid, "solid").when(refine, "fine").otherwise("coarse"))


def drivable(mean: Column, dz: Column, z_max: Column) -> Column:
    """The road's envelope; the mean in millimetres."""
    return mean.between(-2200, -1250) & (dz <= 180) & (z_max <= -1150)


def first_cost(mean: Column, dz: Column, z_max: Column, n: Column, slope_: Column, point_cost: Column) -> Column:
    """Cost that a leaf starts with."""
    rigid = ((dz > 250) | (z_max > -1150)) & (n >= 3) | (point_cost > COSTS.caution)
    return F.when(drivable(mean, dz, z_max), 0).when(rigid, COSTS.lethal).when(point_cost > 0, point_cost).when((dz > 150) | (mean > -1350) | (slope_ > 20), 100).otherwise(0).cast("int")


def evaluated_cost(cost: Column, mean: Column, dz: Column, z_max: Column, n: Column, slope_: Column) -> Column:
    """Cost after evaluation; 100 stays, the road is free, then lethal, caution by the worst of three ratios, and slope."""
    step = F.when(dz > 150, (dz - 150) / 100.0).otherwise(0.0)
    height = F.when(mean > -1350, (mean + 1350) / 150.0).otherwise(0.0)
    lean = F.when(slope_ > 20, (slope_ - 20) / 18.0).otherwise(0.0)
    ratio = F.least(F.greatest(step, height, lean, F.lit(0.0)), F.lit(1.0))
    lethal = ((mean > -1200) & (n >= 3)) | (dz > 250) | (mean < -2150) | (slope_ >= 38)
    caution = (dz > 150) | (mean > -1350) | (slope_ > 20)
    return (
        F.when(cost == 100, 100).when(drivable(mean, dz, z_max), 0).when(cost >= COSTS.lethal, cost).when(lethal, COSTS.lethal)
        .when(caution, F.floor(F.lit(COSTS.safe + 1) + ratio * (COSTS.caution - COSTS.safe - 1))).otherwise(F.floor(slope_ * 2.5)).cast("int")
    )


def band(cost: Column) -> Column:
    """safe, caution or lethal."""
    return F.when(cost <= COSTS.safe, "safe").when(cost <= COSTS.caution, "caution").otherwise("lethal")


def colour(cost: Column, height: Column) -> Column:
    """What a cell is drawn in: grey if unknown, red for what is safe but above -1.15 m (height in millimetres), else by band."""
    high = F.coalesce(height > -1150, F.lit(False)) & (cost <= COSTS.safe)
    return F.when(cost == -1, "grey").when(high | (cost > COSTS.caution), "red").when(cost <= COSTS.safe, "green").otherwise("yellow")


def leaves(points: DataFrame, b: Bounds = BOUNDS) -> DataFrame:
    """Leaves of the adaptive grid: coarse cells, and quarters of a side where ground meets obstacle.

    gx and gy count cells of the leaf's own size from the bounds' corner. mean_z is the mean of a coarse cell's points and
    the middle of a fine cell's range. Points beyond the bounds do not count; cells of fewer than 3 points have no leaf.
    Points are read and shuffled once: fine cells are added up to coarse ones, which keep them, at most 16, as an array.
    """
    if "cost" not in points.columns:
        points = points.withColumn("cost", F.lit(0))
    ratio = GRID.coarse // GRID.fine
    fine = coarse(within_bounds(points, b), b, GRID.fine)
    part = F.struct("gx", "gy", "z_min", "z_max", "n", "sum_z", "point_cost")
    own = fine.groupBy("frame_id", F.floor(F.col("gx") / ratio).alias("cx"), F.floor(F.col("gy") / ratio).alias("cy"))
    cells = own.agg(
        F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"), F.sum("n").alias("n"), F.sum("sum_z").alias("sum_z"), F.sum("n_obstacle").alias("n_obstacle"),
        F.max("point_cost").alias("point_cost"), F.collect_list(part).alias("parts"),
    ).withColumnsRenamed({"cx": "gx", "cy": "gy"})
    kinds = classify(cells).where("kind <> 'sparse'")
    split = F.col("kind") == "fine"
    size = F.when(split, GRID.fine).otherwise(GRID.coarse).alias("size_mm")
    found = kinds.select("frame_id", size, F.explode(F.when(split, F.col("parts")).otherwise(F.array(part))).alias("cell")).select("frame_id", "size_mm", "cell.*")
    mean = F.when(F.col("size_mm") == GRID.coarse, F.col("sum_z") / F.col("n")).otherwise((F.col("z_min") + F.col("z_max")) / 2)
    found = found.withColumn("dz", F.col("z_max") - F.col("z_min")).withColumn("mean_z", mean)
    found = found.withColumn("slope", slope(F.col("dz"), F.col("size_mm")))
    args = [F.col(c) for c in ("mean_z", "dz", "z_max", "n", "slope", "point_cost")]
    return found.select("frame_id", "size_mm", "gx", "gy", "z_min", "z_max", "dz", "n", "mean_z", "slope", first_cost(*args).alias("cost"))


def evaluate(leaves_: DataFrame) -> DataFrame:
    """Leaves with their evaluated cost."""
    args = [F.col(c) for c in ("cost", "mean_z", "dz", "z_max", "n", "slope")]
    return leaves_.withColumn("cost", evaluated_cost(*args))


def band_counts(leaves_: DataFrame) -> DataFrame:
    """Of each frame: leaves, safe, caution, lethal, coarse and fine ones."""
    b = band(F.col("cost"))
    return leaves_.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("leaves"), F.count_if(b == "safe").alias("safe"), F.count_if(b == "caution").alias("caution"), F.count_if(b == "lethal").alias("lethal"),
        F.count_if(F.col("size_mm") == GRID.coarse).alias("coarse"), F.count_if(F.col("size_mm") < GRID.coarse).alias("fine"),
    )


def zone(d2: Column) -> Column:
    """1 to 4 by squared distance, 5 beyond."""
    out = F.lit(5)
    for k in range(4, 0, -1):
        r = ZONES[k - 1][0]
        out = F.when(d2 <= r * r if k == 4 else d2 < r * r, k).otherwise(out)
    return out


def resolution(zone_: Column) -> Column:
    """Cell size of a zone."""
    out = F.lit(None).cast("int")
    for k, (_, size) in enumerate(ZONES, 1):
        out = F.when(zone_ == k, size).otherwise(out)
    return out


def foveated(points: DataFrame) -> DataFrame:
    """Cells whose size follows the zone of the point, with their cost; before cells are moved off zone borders."""
    if "cost" not in points.columns:
        points = points.withColumn("cost", F.lit(0))
    inside = F.col("x_mm").between(-100_000, 100_000) & F.col("y_mm").between(-50_000, 50_000)
    p = points.where(inside).withColumn("zone", zone(F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm"))).where("zone <= 4").withColumn("size_mm", resolution(F.col("zone")))
    at = lambda c: F.floor(F.col(c) / F.col("size_mm")).alias(f"i{c[0]}")
    z = F.col("z_mm")
    s = p.groupBy("frame_id", "zone", "size_mm", at("x_mm"), at("y_mm")).agg(F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.count(F.lit(1)).alias("n"), F.sum(z).alias("sum_z"), F.sum(z * z).alias("_q"), F.max("cost").alias("point_cost"))
    var = (F.col("n") * F.col("_q") - F.col("sum_z") * F.col("sum_z")).cast("double") / (F.col("n") * F.col("n")).cast("double") / 1e6
    dz = F.col("z_max") - F.col("z_min")
    cost = F.when(F.col("point_cost") > 0, F.col("point_cost")).when((dz > 250) | (F.col("z_max") > -1150), COSTS.lethal).when(dz > 150, 100).otherwise(0)
    return s.withColumn("dz", dz).withColumn("variance", var).withColumn("cost", cost.cast("int")).drop("_q", "point_cost")


def snapped(cells: DataFrame) -> DataFrame:
    """Foveated cells with their centre (metres) moved along its radius where the footprint crosses a zone border, and cell_id."""
    half = F.col("size_mm") / 2000.0
    x, y = (F.col("ix") + 0.5) * F.col("size_mm") / 1000.0, (F.col("iy") + 0.5) * F.col("size_mm") / 1000.0
    c = cells.withColumn("x", x).withColumn("y", y).withColumn("_d", F.hypot("x", "y"))
    lo = lambda v: F.greatest(F.abs(v) - half, F.lit(0.0))
    c = c.withColumn("_near", F.hypot(lo(F.col("x")), lo(F.col("y")))).withColumn("_far", F.hypot(F.abs(F.col("x")) + half, F.abs(F.col("y")) + half))
    crosses = F.lit(False)
    for r in (10.0, 25.0, 50.0):
        crosses = crosses | ((F.col("_near") < r) & (F.col("_far") > r))
    shift = F.lit(0.0)
    for k, (inner, outer) in enumerate(((None, 10.0), (10.0, 25.0), (25.0, 50.0), (50.0, None)), 1):
        own = F.lit(0.0)
        if outer is not None:
            own = F.when(F.col("_far") >= outer, -(F.col("_far") - outer + 1e-4)).otherwise(own)
        if inner is not None:
            own = F.when(F.col("_near") < inner, inner - F.col("_near") + 1e-4).otherwise(own)
        shift = F.when(F.col("zone") == k, own).otherwise(shift)
    shift = F.when(crosses & (F.col("_d") > 1e-6), shift).otherwise(0.0)
    moved = c.withColumn("_s", shift / F.greatest(F.col("_d"), F.lit(1e-6)))
    moved = moved.withColumn("x", F.col("x") * (1 + F.col("_s"))).withColumn("y", F.col("y") * (1 + F.col("_s")))
    return moved.drop("_d", "_near", "_far", "_s").withColumn("cell_id", cell_id(F.col("zone"), F.col("size_mm"), F.col("x"), F.col("y")))


def cell_of_point(points: DataFrame) -> DataFrame:
    """points with zone, size_mm, cx, cy (metres) and cell_id of the foveated cell each one is in by itself.

    Where the cell's footprint crosses a border between zones, its centre is scaled so that the footprint ends at the border,
    on the side of the point's zone. Points beyond the last zone have size 500 mm and are not moved.
    """
    p = points.withColumn("zone", zone(F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")))
    p = p.withColumn("size_mm", F.coalesce(resolution(F.col("zone")), F.lit(ZONES[-1][1])))
    middle = lambda c: (F.floor(F.col(c) / F.col("size_mm")) + 0.5) * F.col("size_mm") / 1000.0
    p = p.withColumn("_x", middle("x_mm")).withColumn("_y", middle("y_mm"))
    half = F.col("size_mm") / 2000.0
    lo = lambda v: F.greatest(F.abs(v) - half, F.lit(0.0))
    p = p.withColumn("_near", F.hypot(lo(F.col("_x")), lo(F.col("_y")))).withColumn("_far", F.hypot(F.abs("_x") + half, F.abs("_y") + half))
    scale = F.lit(1.0)
    for k in (3, 2, 1):  # of two borders that are crossed, the inner one counts
        border = ZONES[k - 1][0] / 1000.0
        inward, outward = (border - 1e-4) / F.greatest(F.col("_far"), F.lit(1e-6)), (border + 1e-4) / F.greatest(F.col("_near"), F.lit(1e-6))
        scale = F.when((F.col("_near") < border) & (F.col("_far") > border), F.when(F.col("zone") == k, inward).otherwise(outward)).otherwise(scale)
    p = p.withColumn("_s", scale).withColumn("cx", F.col("_x") * F.col("_s")).withColumn("cy", F.col("_y") * F.col("_s"))
    return p.withColumn("cell_id", cell_id(F.col("zone"), F.col("size_mm"), F.col("cx"), F.col("cy"))).drop("_x", "_y", "_near", "_far", "_s")


def cell_id(zone_: Column, size: Column, x: Column, y: Column) -> Column:
    """Text id of a cell from its zone, size and centre in metres."""
    return F.format_string("z%d_%sm_%+09.4f_%+09.4f", zone_, F.format_string("%.2f", size / 1000.0), x, y)


def resolve_overlaps(cells: DataFrame, bin_mm: int = 50) -> DataFrame:
    """Snapped cells without those that overlap one kept before; finer zones, then smaller cells, then cell_id come first.

    Cells overlap if they cover a bin in common. Pairs come from tiles of 16 bins, each from the one that holds the first bin
    that the two share, and choices are made in rounds over all frames.
    """
    half = F.col("size_mm") / 2
    lo = lambda c: F.floor((F.col(c) * 1000 - half + 1) / bin_mm)
    hi = lambda c: F.floor((F.col(c) * 1000 + half - 1) / bin_mm)
    order = Window.partitionBy("frame_id").orderBy("zone", "size_mm", "cell_id", "x", "y")
    own = cells.withColumn("_nth", F.row_number().over(order))
    b = own.select("frame_id", F.col("_nth").alias("n"), lo("x").alias("x0"), hi("x").alias("x1"), lo("y").alias("y0"), hi("y").alias("y1"))
    b = b.withColumn("kx", F.explode(F.sequence(F.floor(F.col("x0") / 16), F.floor(F.col("x1") / 16)))).withColumn("ky", F.explode(F.sequence(F.floor(F.col("y0") / 16), F.floor(F.col("y1") / 16))))
    one, two = (b.select("frame_id", "kx", "ky", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "x0", "x1", "y0", "y1")]) for s in "ab")
    meet = F.lit(True)
    for a in "xy":
        meet = meet & (F.col(f"{a}0_a") <= F.col(f"{a}1_b")) & (F.col(f"{a}0_b") <= F.col(f"{a}1_a")) & (F.col(f"k{a}") == F.floor(F.greatest(f"{a}0_a", f"{a}0_b") / 16))
    pairs = one.join(two, ["frame_id", "kx", "ky"]).where((F.col("n_a") < F.col("n_b")) & meet)
    gone = losers(pairs.select("frame_id", F.col("n_a").alias("better"), F.col("n_b").alias("worse")), ["frame_id"]).withColumnRenamed("worse", "_nth")
    return own.join(gone, ["frame_id", "_nth"], "left_anti").select(*cells.columns)


def _levels(table: pa.Table, tops: np.ndarray, depth: int) -> pa.Table:
    """The leaves of whole cells of the first level, whose points stand together in order of _key; tops: each point's cell."""
    z, key, high = table["z_mm"].to_numpy(), table["_key"].to_numpy(), table["z_mm"].to_numpy() > -1200
    x, y = table["_x"].to_numpy(), table["_y"].to_numpy()
    open_, above, found = np.ones(1, bool), np.zeros(1, np.int64), []
    for k in range(depth + 1):
        prefix = key >> 2 * (depth - k)
        start = np.flatnonzero((np.diff(tops, prepend=-1) != 0) | (np.diff(prefix, prepend=-1) != 0))
        lo, hi, n = np.minimum.reduceat(z, start), np.maximum.reduceat(z, start), np.diff(start, append=len(z))
        reached = open_[np.searchsorted(above, start, "right") - 1]
        split = (n >= GRID.least_points) & (hi - lo > GRID.step)
        block = split & (np.add.reduceat(high.astype(np.int64), start) >= 3) if k == 0 else np.zeros(len(start), bool)
        open_, above = reached & split & ~block & (k < depth), start
        leaf = reached & ~open_
        at = start[leaf]
        side = lambda top, odd, at=at, own=prefix, k=k: (top[at] << k) + sum(((own[at] >> 2 * i + odd & 1) << i for i in range(k)), np.zeros(len(at), np.int64))
        found.append((at, np.full(len(at), k), side(x, 0), side(y, 1), lo[leaf], hi[leaf], n[leaf], np.where(block[leaf], 255, -1)))
    at, level, *rest, cost = (np.concatenate(v) for v in zip(*found, strict=True))
    names = ["frame_id", "depth", "gx", "gy", "z_min", "z_max", "n", "cost"]
    return pa.table([table["frame_id"].take(pa.array(at)), pa.array(level, pa.int32()), *(pa.array(v, pa.int64()) for v in rest), pa.array(cost, pa.int32())], names)


def split_levels(points: DataFrame, depth: int = 3, b: Bounds = BOUNDS) -> DataFrame:
    """Leaves of the recursive split as a linear quadtree: a cell with a step over 0.18 m and 3 points or more is quartered.

    A cell of the first level with 3 points above -1.2 m stays whole and is lethal. Sizes are 500, 250, 125 and 62.5 mm; gx
    and gy count cells of the level's size. Points are exchanged and sorted once, by their first-level cell and the Morton key of
    their last-level cell within it; a prefix of the key is the cell of a higher level, so a level is a run of points. A task
    holds its sort, which can spill, an Arrow batch, and the cell that goes on in the next one.
    """
    size2 = GRID.coarse * 2 >> depth  # the smallest size is not whole, so lengths are doubled
    if size2 << depth != GRID.coarse * 2:
        raise ValueError(f"cells of {GRID.coarse} mm cannot be quartered {depth} times in whole halves of a millimetre")
    fine = lambda c, lo: F.floor((F.col(c) - lo) * 2 / size2).cast("bigint")
    bit = lambda f, k: F.shiftright(F.col(f), k).bitwiseAND(1)
    key = sum((bit("fx", k) * (1 << 2 * k) + bit("fy", k) * (2 << 2 * k) for k in range(depth)), F.lit(0)).cast("bigint")
    p = within_bounds(points, b).select("frame_id", fine("x_mm", b.x_min).alias("fx"), fine("y_mm", b.y_min).alias("fy"), F.col("z_mm").cast("bigint").alias("z_mm"))
    p = p.select("frame_id", F.shiftright("fx", depth).alias("_x"), F.shiftright("fy", depth).alias("_y"), key.alias("_key"), "z_mm")
    schema = f"frame_id {dict(p.dtypes)['frame_id']}, depth int, gx bigint, gy bigint, z_min bigint, z_max bigint, n bigint, cost int"
    return whole_frames(p, lambda table, tops: _levels(table, tops, depth), schema, by=("frame_id", "_x", "_y"), order="_key")


def uniform(points: DataFrame, size: int = 50) -> DataFrame:
    """A uniform grid: z_min, z_max, n, sum_z."""
    return points.groupBy("frame_id", cell("x_mm", size).alias("gx"), cell("y_mm", size).alias("gy")).agg(F.min("z_mm").alias("z_min"), F.max("z_mm").alias("z_max"), F.count(F.lit(1)).alias("n"), F.sum("z_mm").alias("sum_z"))


def multifactor_cost(dz: Column, slope_: Column, variance: Column, by_class: Column, by_drop: Column) -> Column:
    """80 by step over 0.2 m, 60 by slope over 25 degrees, 40 by variance over 0.05, and two costs given; 0 to 255, cut to whole."""
    raw = dz / 1000.0 / 0.2 * 80.0 + slope_ / 25.0 * 60.0 + variance / 0.05 * 40.0 + by_class + by_drop
    return F.floor(F.least(F.greatest(raw, F.lit(0.0)), F.lit(255.0))).cast("int")


def unobserved(cells: DataFrame, b: Bounds, size: int) -> DataFrame:
    """The cells of the bounds that a frame has not seen, with cost -1 and nothing else known."""
    nx, ny = (b.x_max - b.x_min) // size, (b.y_max - b.y_min) // size
    grid = cells.select("frame_id").distinct().select("frame_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nx - 1).cast("bigint"))).alias("gx"))
    grid = grid.select("frame_id", "gx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ny - 1).cast("bigint"))).alias("gy"))
    return grid.join(cells.select("frame_id", "gx", "gy"), ["frame_id", "gx", "gy"], "left_anti").withColumn("cost", F.lit(-1))


def memory_model(counts: DataFrame, b: Bounds = BOUNDS) -> DataFrame:
    """Modelled bytes of a frame's leaves (192 each, 64 for an index entry, 256 KiB besides) against a uniform 5 cm grid of 48."""
    dense = ((b.x_max - b.x_min) // 50) * ((b.y_max - b.y_min) // 50) * 48
    used = F.col("leaves") * (192 + 64) + 256 * 1024
    return counts.select("frame_id", "leaves", used.alias("leaf_bytes"), F.lit(dense).alias("uniform_bytes"), (F.lit(100.0) * (dense - used) / dense).alias("saved_percent"))
