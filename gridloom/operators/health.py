"""State over frames: sensor quadrants, smoothed rates, terrain memory and ghost clearing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUADRANTS = ("FRONT_RIGHT", "FRONT_LEFT", "REAR_LEFT", "REAR_RIGHT")


def quadrant_counts(points: DataFrame) -> DataFrame:
    """Points of each frame by quadrant, counted from straight ahead to the left."""
    x, y = F.col("x_mm"), F.col("y_mm")
    inside = ((y >= 0) & (x > 0) | (x == 0) & (y == 0), ((y > 0) & (x <= 0)) | ((y == 0) & (x < 0)), (y < 0) & (x < 0), (y < 0) & (x >= 0))
    return points.groupBy("frame_id").agg(*[F.count_if(c).alias(f"q{k}") for k, c in enumerate(inside)])


def smoothed(values: Column, alpha: float) -> Column:
    """Exponential average of an array, from its first value, after its last."""
    first = F.element_at(values, 1).cast("double")
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), first, lambda a, v: (1 - alpha) * a + alpha * v)


def quadrant_health(counts: DataFrame, sensor: str, alpha: float = 0.08, baseline: float = 80, share: float = 0.15) -> DataFrame:
    """Of each frame of a sensor: whether a forward quadrant sees less than share of its average, which has this frame in it.

    The average starts with the first frame that has more than baseline points in all.
    """

    def own(group: pd.DataFrame) -> pd.DataFrame:
        average, out = None, []
        for r in group.sort_values("frame_id").itertuples():
            q = [r.q0, r.q1, r.q2, r.q3]
            if average is None:
                average = [float(v) for v in q] if sum(q) > baseline else None
            else:
                average = [(1 - alpha) * a + alpha * v for a, v in zip(average, q, strict=True)]
            weak = [QUADRANTS[k] for k in (0, 1) if average and average[k] >= baseline and q[k] < share * average[k]]
            out.append((getattr(r, sensor), r.frame_id, bool(weak), ",".join(weak), average[0] if average else 0.0, average[1] if average else 0.0))
        return pd.DataFrame(out, columns=[sensor, "frame_id", "is_degraded", "quadrants", "front_right", "front_left"])

    return counts.groupBy(sensor).applyInPandas(own, f"{sensor} bigint, frame_id bigint, is_degraded boolean, quadrants string, front_right double, front_left double")


def inflated(leaves: DataFrame, degraded: DataFrame, cost: int = 180) -> DataFrame:
    """leaves (with x_mm, y_mm) in a blind forward quadrant (frame_id, quadrants) cost at least `cost`."""
    d = degraded.select(F.col("frame_id").alias("_f"), F.col("quadrants").alias("_q"))
    j = leaves.join(d, F.col("frame_id") == F.col("_f"), "left")
    x, y = F.col("x_mm"), F.col("y_mm")
    own = F.when((x > 0) & (y >= 0), QUADRANTS[0]).when((x <= 0) & (y > 0), QUADRANTS[1])
    blind = F.coalesce(F.array_contains(F.split("_q", ","), own), F.lit(False))
    return j.withColumn("cost", F.when(blind, F.greatest("cost", F.lit(cost))).otherwise(F.col("cost"))).drop("_f", "_q")


def _gains(noise: float, drift: float, n: int = 64) -> tuple[list[float], list[float]]:
    """The gain at a cell's k-th observation (1 at its first) and the variance after it, for k = 1 to n: both depend on k alone,
    and are at rest long before the 64th."""
    gains, left = [1.0], [2 * noise]
    while len(gains) < n:
        k = left[-1] / (left[-1] + noise)
        gains.append(k)
        left.append((1 - k) * left[-1] + drift)
    return gains, left


def terrain_blend(cells: DataFrame, noise: float = 0.0025, drift: float = 0.002) -> DataFrame:
    """A height filter for each 0.1 m cell over frames: (sensor_id, kx, ky, frame_id, z) to the height and variance after its last frame.

    The filter's gains do not depend on heights, so its result is a weighted sum: the k-th of n observations weighs its gain
    times what all later gains leave of it. A cell's history is ranked and summed, and never held as one value.
    """
    gains, left = _gains(noise, drift)
    kept = [0.0]  # logarithm of what the first k gains leave of what was before
    for g in gains[1:]:
        kept.append(kept[-1] + math.log1p(-g))
    upto = lambda values, k: F.element_at(F.array(*map(F.lit, values)), F.least(k, F.lit(len(values))).cast("int"))
    own = Window.partitionBy("sensor_id", "kx", "ky").orderBy("frame_id", "z")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = cells.select("*", F.row_number().over(own).alias("_k"), F.count(F.lit(1)).over(every).alias("_n"))
    log = lambda k: upto(kept, k) + F.greatest(k - len(kept), F.lit(0)) * math.log1p(-gains[-1])
    weight = upto(gains, F.col("_k")) * F.exp(log(F.col("_n")) - log(F.col("_k")))
    summed = ranked.groupBy("sensor_id", "kx", "ky").agg(F.max("_n").cast("int").alias("n"), F.sum(weight * F.col("z")).alias("z"))
    return summed.withColumn("p", upto(left, F.col("n")))


def bresenham(x1: int, y1: int, most: int = 60) -> list[tuple[int, int]]:
    """Grid cells from the origin to an end, at most `most` steps."""
    dx, dy = abs(x1), abs(y1)
    sx, sy = (1 if x1 > 0 else -1), (1 if y1 > 0 else -1)
    err, x, y, out = dx - dy, 0, 0, []
    for _ in range(most):
        out.append((x, y))
        if (x, y) == (x1, y1):
            break
        twice = 2 * err
        if twice > -dy:
            err, x = err - dy, x + sx
        if twice < dx:
            err, y = err + dx, y + sy
    return out


def ray(x1: Column, y1: Column, most: int = 60) -> Column:
    """bresenham() as an expression: array of n, kx, ky. At step n the lesser axis has gone ceil(n * lesser / greater - 1/2)."""
    dx, dy = F.abs(x1), F.abs(y1)
    long, short = F.greatest(dx, dy), F.least(dx, dy)

    def at(n: Column) -> Column:
        aside = F.when(long == 0, 0).otherwise(F.ceil((2 * n * short - long) / (2 * long))).cast("int")
        kx, ky = F.when(dx >= dy, n).otherwise(aside), F.when(dx >= dy, aside).otherwise(n)
        return F.struct(n.alias("n"), (kx * F.signum(x1).cast("int")).alias("kx"), (ky * F.signum(y1).cast("int")).alias("ky"))

    return F.transform(F.sequence(F.lit(0), F.least(long, F.lit(most - 1))), at)


def restored(leaves: DataFrame, memory: DataFrame, degraded: DataFrame, step_mm: int = 100) -> DataFrame:
    """leaves (with x_mm, y_mm) whose mean_z (millimetres) in a blind quadrant is the remembered height of their place.

    memory: frame_id, kx, ky (cells of step_mm), z (metres); degraded: frame_id, quadrants. Leaves without memory stay.
    """
    d = degraded.select(F.col("frame_id").alias("_f"), F.col("quadrants").alias("_q"))
    m = memory.select(F.col("frame_id").alias("_m"), F.col("kx").alias("_kx"), F.col("ky").alias("_ky"), F.col("z").alias("_z"))
    x, y = F.col("x_mm"), F.col("y_mm")
    inside = ((y >= 0) & (x > 0) | (x == 0) & (y == 0), ((y > 0) & (x <= 0)) | ((y == 0) & (x < 0)), (y < 0) & (x < 0), (y < 0) & (x >= 0))
    own = F.lit(None).cast("string")
    for name, here in zip(QUADRANTS, inside, strict=True):
        own = F.when(here, name).otherwise(own)
    key = lambda c: F.rint(c / step_mm).cast("bigint")
    j = leaves.join(d, F.col("frame_id") == F.col("_f"), "left").withColumn("_blind", F.coalesce(F.array_contains(F.split("_q", ","), own), F.lit(False)))
    j = j.join(m, F.col("_blind") & (F.col("frame_id") == F.col("_m")) & (key(x) == F.col("_kx")) & (key(y) == F.col("_ky")), "left")
    return j.withColumn("mean_z", F.coalesce(F.col("_z") * 1000, "mean_z")).drop("_f", "_q", "_blind", "_m", "_kx", "_ky", "_z")


def footprints(tracks: DataFrame) -> DataFrame:
    """0.5 m cells (kx, ky) around each track: a square that holds a circle of half its greater extent and 0.3 m."""
    r = F.greatest("length", "width") / 2 + 0.3
    reach = (r * 2).cast("int") + 1
    kx, ky = F.rint(F.col("x") * 2).cast("int"), F.rint(F.col("y") * 2).cast("int")
    f = tracks.select("frame_id", "x", "y", kx.alias("cx"), ky.alias("cy"), reach.alias("r"))
    f = f.withColumn("kx", F.explode(F.sequence(F.col("cx") - F.col("r"), F.col("cx") + F.col("r"))))
    return f.withColumn("ky", F.explode(F.sequence(F.col("cy") - F.col("r"), F.col("cy") + F.col("r")))).select("frame_id", "kx", "ky").distinct()


def cleared(leaves: DataFrame, tracks: DataFrame, rays: int = 3) -> DataFrame:
    """leaves (x, y in metres, dz, mean_z, z_max in millimetres, slope, cost) freed of what tracks left behind.

    Freed are cells of the last frame's footprints that are in none of this frame's and hardly rise; road cells on rays
    through the last footprints up to the first occupied cell; and the flat corridor ahead. Footprints grow with the frames
    but compress to almost nothing, so they are kept from being broadcast for their size on disk.
    """
    k = leaves.withColumn("kx", F.rint(F.col("x") * 2).cast("int")).withColumn("ky", F.rint(F.col("y") * 2).cast("int"))
    now = footprints(tracks).hint("merge")
    last = footprints(tracks.withColumn("frame_id", F.col("frame_id") + 1))
    left = last.join(now, ["frame_id", "kx", "ky"], "left_anti").withColumn("left", F.lit(True)).hint("merge")

    ends = tracks.withColumn("frame_id", F.col("frame_id") + 1).withColumn("d", F.hypot("x", "y")).where("d > 0.2")
    ends = ends.withColumn("a", F.explode(F.array(*[F.lit(0.2 * (i - rays // 2)) for i in range(rays)])))
    far = (F.col("d") + 3) / F.col("d")
    ends = ends.select("frame_id", "track_id", "a", ((F.col("x") * F.cos("a") - F.col("y") * F.sin("a")) * far).alias("ex"), ((F.col("x") * F.sin("a") + F.col("y") * F.cos("a")) * far).alias("ey"))
    path = ends.select("frame_id", "track_id", "a", F.explode(ray(F.rint(F.col("ex") * 2).cast("int"), F.rint(F.col("ey") * 2).cast("int"))).alias("s")).select("frame_id", "track_id", "a", "s.*")
    path = path.join(now.withColumn("hit", F.lit(1)).hint("merge"), ["frame_id", "kx", "ky"], "left")
    blocked = F.max("hit").over(Window.partitionBy("frame_id", "track_id", "a").orderBy("n"))
    seen = path.withColumn("_b", blocked).where("_b IS NULL").select("frame_id", "kx", "ky").distinct().withColumn("seen", F.lit(True)).hint("merge")
    j = k.join(left, ["frame_id", "kx", "ky"], "left").join(seen, ["frame_id", "kx", "ky"], "left")
    direct = F.coalesce("left", F.lit(False)) & (F.col("dz") < 150)
    sight = F.coalesce("seen", F.lit(False)) & F.col("mean_z").between(-2150, -1200) & (F.col("z_max") <= -1200)
    corridor = F.col("x").between(0.5, 35) & (F.abs("y") <= 3) & (F.col("dz") < 80) & (F.col("slope") < 6)
    return j.withColumn("cost", F.when(direct | sight | corridor, 0).otherwise(F.col("cost"))).drop("kx", "ky", "left", "seen")

