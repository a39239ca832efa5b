"""Ground: polar seeds and split, plane fit, residuals, thin hazards and height labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.config import SENSOR_HEIGHT
from gridloom.operators.binning import cell
from gridloom.operators.points import per_frame

RINGS, SECTORS = 16, 32
#: Squared reach of the polar grid: the corner of the mapped box.
REACH2 = 60_000**2 + 35_000**2


def polar(points: DataFrame) -> DataFrame:
    """points with ring and sector."""
    x, y = F.col("x_mm").cast("double"), F.col("y_mm").cast("double")
    ring = F.least(F.floor(F.sqrt(x * x + y * y) / float(np.sqrt(REACH2)) * RINGS), F.lit(RINGS - 1))
    sector = F.least(F.floor((F.atan2(y, x) + float(np.pi)) / float(2 * np.pi) * SECTORS), F.lit(SECTORS - 1))
    return points.withColumn("ring", ring.cast("int")).withColumn("sector", sector.cast("int"))


def seeds(points: DataFrame) -> DataFrame:
    """Lowest plausible ground of each polar cell that has any."""
    own = polar(points).where(F.col("z_mm").between(-SENSOR_HEIGHT - 800, -SENSOR_HEIGHT + 350))
    return own.groupBy("frame_id", "ring", "sector").agg(F.min("z_mm").alias("seed"))


def split(points: DataFrame) -> DataFrame:
    """points with is_ground: low, and near its polar cell's seed; within 1 m of the sensor only what is very low."""
    low = F.col("z_mm") <= -SENSOR_HEIGHT + 350
    candidate = F.when(low & (F.col("z_mm") >= -SENSOR_HEIGHT - 800), F.col("z_mm"))
    seed = F.coalesce(F.min(candidate).over(Window.partitionBy("frame_id", "ring", "sector")), F.lit(-SENSOR_HEIGHT))
    rise = F.col("z_mm") - seed
    close = F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm") < 1_000_000
    ground = F.when(close, F.col("z_mm") <= -SENSOR_HEIGHT + 50).otherwise(low & rise.between(-50, 180))
    return polar(points).withColumn("is_ground", ground).drop("ring", "sector")


def plane_sums(points: DataFrame, most: int = 300) -> DataFrame:
    """Of every stride-th point of a frame, stride = n / most: count, sums and sums of products of the coordinates."""
    n, rank = F.count(F.lit(1)).over(per_frame()), F.row_number().over(per_frame().orderBy("point_idx")) - 1
    own = points.withColumn("_s", F.greatest(F.floor(n / most), F.lit(1))).withColumn("_r", rank).where(F.col("_r") % F.col("_s") == 0)
    c = {"x": F.col("x_mm"), "y": F.col("y_mm"), "z": F.col("z_mm")}
    sums = [F.sum(v).alias(f"s{k}") for k, v in c.items()]
    products = [F.sum(c[a] * c[b]).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return own.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def fit_planes(sums: DataFrame) -> DataFrame:
    """Planes a x + b y + c z + d = 0 (metres, c >= 0) from plane_sums(): the covariance's least eigenvector, a row a frame.

    Frames of fewer than 3 points get the plane z = 0.
    """

    @F.pandas_udf("struct<a:double,b:double,c:double,d:double>")
    def plane(n: pd.Series, s: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for count, v in zip(n, s.itertuples(index=False), strict=True):
            if count < 3:
                rows.append((0.0, 0.0, 1.0, 0.0))
                continue
            mean = np.array([v.sx, v.sy, v.sz]) / count
            m = np.array([[v.sxx, v.sxy, v.sxz], [v.sxy, v.syy, v.syz], [v.sxz, v.syz, v.szz]]) / count - np.outer(mean, mean)
            normal = np.linalg.eigh(m)[1][:, 0]
            normal = normal if normal[2] >= 0 else -normal
            rows.append((*normal, -float(normal @ mean) / 1000))
        return pd.DataFrame(rows, columns=list("abcd"))

    s = F.struct(*[F.col(c).cast("double").alias(c) for c in ("sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")])
    return sums.select("frame_id", plane("n", s).alias("p")).select("frame_id", "p.*")


def residual_to_plane(points: DataFrame, planes: DataFrame) -> DataFrame:
    """points with residual: signed distance in metres to the frame's plane (z = 0 where it has none)."""
    p = planes.select(F.col("frame_id").alias("_f"), "a", "b", "c", "d")
    a, b, c, d = (F.coalesce(F.col(k), F.lit(v)) for k, v in zip("abcd", (0.0, 0.0, 1.0, 0.0), strict=True))
    over = a * F.col("x_mm") + b * F.col("y_mm") + c * F.col("z_mm") + d * 1000
    return points.join(p, F.col("frame_id") == F.col("_f"), "left").withColumn("residual", over / 1000 / F.sqrt(a * a + b * b + c * c)).drop("_f", "a", "b", "c", "d")


def residual_to_cell(points: DataFrame, size: int = 1000) -> DataFrame:
    """points with residual_mm: height over the cell's lowest point, between -0.3 and 1.2 m."""
    low = F.min("z_mm").over(Window.partitionBy("frame_id", cell("x_mm", size), cell("y_mm", size)))
    return points.withColumn("residual_mm", F.least(F.greatest(F.col("z_mm") - low, F.lit(-300)), F.lit(1200)))


def low_profile(points: DataFrame) -> DataFrame:
    """points with is_threat: 15 to 50 mm over the cell's ground and brighter than 0.7 of the frame's range."""
    lo, hi = F.min("i_pct").over(per_frame()), F.max("i_pct").over(per_frame())
    bright = F.when(hi > lo, 10 * (F.col("i_pct") - lo) > 7 * (hi - lo)).otherwise(False)
    r = F.col("residual_mm")
    return residual_to_cell(points).withColumn("is_threat", r.between(10, 80) & (r > 15) & (r < 50) & bright)


def threat_probability(height_mm: Column, brightness: Column) -> Column:
    """Logistic of a point's height over the ground and its intensity (0..1)."""
    z = height_mm / 1000.0 * 5.5 / 0.55 * 1.5 + brightness / 0.25 * 1.2 - 2.5
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-50.0)), F.lit(50.0))))


def brightness(points: DataFrame, column: str = "intensity") -> DataFrame:
    """points with brightness 0..1: intensity by 255 in frames that have any above 1, else as it is, cut to 0..1; 0.2 if null."""
    v = F.col(column).cast("double")
    scale = F.when(F.max(v).over(per_frame()) > 1, 255.0).otherwise(1.0)
    return points.withColumn("brightness", F.coalesce(F.least(F.greatest(v / scale, F.lit(0.0)), F.lit(1.0)), F.lit(0.2)))


def candidates(points: DataFrame, height: str, most: int = 120) -> DataFrame:
    """Of the points 10 to 80 mm over the ground (column height), the `most` brightest of each frame, with slot and place.

    Ties go by point_idx. The chosen are dealt by fives, in order of point_idx, into slots; what does not fill one has none.
    """
    own = points.where(F.col(height).between(10, 80))
    own = own.withColumn("_b", F.row_number().over(per_frame().orderBy(F.desc("i_pct"), "point_idx"))).where(F.col("_b") <= most).drop("_b")
    rank, n = F.row_number().over(per_frame().orderBy("point_idx")) - 1, F.count(F.lit(1)).over(per_frame())
    own = own.withColumn("_r", rank).withColumn("_n", n)
    slot = F.when(F.col("_r") < F.col("_n") - F.col("_n") % 5, F.expr("_r div 5").cast("int"))
    return own.withColumn("slot", slot).withColumn("place", F.when(slot.isNotNull(), (F.col("_r") % 5).cast("int"))).drop("_r", "_n")


def slot_threats(chosen: DataFrame, model, height: str) -> DataFrame:
    """frame_id, point_idx, p: a model's greatest probability over a candidate's slot; null unless the model is READY.

    A frame's slots are one input: heights (times 5.5) and brightness in two rows of a padded buffer, as models.slots deals
    them, and the model answers with a logit for each place. Candidates without a slot have probability 0.
    """
    from gridloom.functions import models

    if model.predict is None:
        return chosen.select("frame_id", "point_idx", F.lit(None).cast("double").alias("p"))
    predict = model.predict

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point_idx")
        full = frame[frame.slot.notna()]
        out = pd.Series(0.0, index=frame.index)
        for first in range(0, int(full.slot.max()) + 1 if len(full) else 0, 24):
            own = full[(full.slot >= first) & (full.slot < first + 24)]
            x = np.stack([models.slots((own[height] / 1000 * 5.5).tolist()), models.slots((own.i_pct / 100).clip(0, 1).tolist())])[None]
            p = 1 / (1 + np.exp(-np.clip(np.asarray(predict(x)).reshape(-1), -50, 50)))
            at = (10 + (own.slot - first) * 20 + own.place).astype(int).to_numpy()
            out[own.index] = pd.Series(p[at], index=own.index).groupby(own.slot).transform("max")
        return pd.DataFrame({"frame_id": frame.frame_id, "point_idx": frame.point_idx, "p": out})

    return chosen.select("frame_id", "point_idx", "slot", "place", "i_pct", height).groupBy("frame_id").applyInPandas(run, "frame_id bigint, point_idx bigint, p double")


def thin_hazards(points: DataFrame, height: str, threshold: float = 0.75, size: int = 350, least: int = 5, most: int = 20) -> DataFrame:
    """Clusters of points 10 to 80 mm over the ground (column height, millimetres) that look like a threat.

    A point's probability is its column p (null: none), as slot_threats() gives it, or comes from its height and intensity where there
    is no such column. At most `most` a frame, in the order of their first point. radius and bounds in millimetres.
    """
    given = F.col("p") if "p" in points.columns else threat_probability(F.col(height), F.least(F.col("i_pct") / 100.0, F.lit(1.0)))
    p = points.where(F.col(height).between(10, 80)).withColumn("p", given).where(F.col("p") >= threshold)
    x, y = F.col("x_mm"), F.col("y_mm")
    h = p.groupBy("frame_id", cell("x_mm", size).alias("gx"), cell("y_mm", size).alias("gy")).agg(
        F.min("point_idx").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y"), F.sum("z_mm").alias("sum_z"),
        F.min(x).alias("x_lo"), F.max(x).alias("x_hi"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi"), F.max("p").alias("p"),
    )
    h = h.where(F.col("n") >= least).withColumn("radius", F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo")) / 2 + 100)
    return h.withColumn("_r", F.row_number().over(per_frame().orderBy("first"))).where(F.col("_r") <= most).drop("_r").withColumn("cost", F.lit(255))


def height_label(z: Column) -> Column:
    """0 ground, 1 vegetation, 2 rigid, by height alone."""
    return F.when(z >= 1000, 2).when(z > 150, 1).otherwise(0)


def label_counts(points: DataFrame) -> DataFrame:
    """Of each frame, points by label column: ground, vegetation, rigid, dynamic, and obstacles (rigid and dynamic)."""
    n = lambda *v: F.count_if(F.col("label").isin(*v))
    return points.groupBy("frame_id").agg(n(0).alias("ground"), n(1).alias("vegetation"), n(2).alias("rigid"), n(3).alias("dynamic"), n(2, 3).alias("obstacle"))


def windows(points: DataFrame, size: int = 512, stride: int | None = None) -> DataFrame:
    """Windows of a frame's heights that start every stride points (size, unless given), padded with zeros: frame_id, w, heights."""
    stride = stride or size
    low = F.greatest(F.lit(0), F.ceil((F.col("point_idx") - size + 1) / stride)).cast("bigint")
    w = points.withColumn("w", F.explode(F.sequence(low, F.expr(f"point_idx div {stride}"))) if stride < size else F.expr(f"point_idx div {stride}"))
    w = w.where(F.col("point_idx") < F.col("w") * stride + size)
    own = w.groupBy("frame_id", "w").agg(F.array_sort(F.collect_list(F.struct("point_idx", "z_mm"))).alias("p"))
    z = F.transform("p", lambda p: p["z_mm"])
    return own.select("frame_id", "w", F.concat(z, F.array_repeat(F.lit(0).cast("bigint"), size - F.size("p"))).alias("heights"))


def spherical(points: DataFrame, rows: int = 64, columns: int = 1024, up: float = 3.0, down: float = -25.0, mirror: bool = False, near: float | None = None, far: float | None = None) -> DataFrame:
    """points with u, v of a range image and r in metres; -1 outside the field of view or the range from near to far.

    The plain form takes all beyond 0.1 m. The mirrored one turns the other way round, holds u within the image and takes
    what is between 0.5 and 80 m.
    """
    near, far = near if near is not None else 0.5 if mirror else 0.1, far if far is not None else 80.0 if mirror else None
    x, y, z = (F.col(c) / 1000.0 for c in ("x_mm", "y_mm", "z_mm"))
    r = F.sqrt(x * x + y * y + z * z)
    yaw, pitch = F.atan2(y, x) * (-1 if mirror else 1), F.asin(z / F.greatest(r, F.lit(1e-9)))
    u = F.floor(0.5 * (1 - yaw / float(np.pi)) * columns)
    u = F.least(F.greatest(u, F.lit(0)), F.lit(columns - 1)) if mirror else u
    v = F.floor((1 - (F.degrees(pitch) - down) / (up - down)) * rows)
    ok = (r > near) & u.between(0, columns - 1) & v.between(0, rows - 1)
    ok = ok if far is None else ok & (r < far)
    return points.withColumn("r", r).withColumn("u", F.when(ok, u).otherwise(-1).cast("int")).withColumn("v", F.when(ok, v).otherwise(-1).cast("int"))


def range_image(points: DataFrame, **kwargs) -> DataFrame:
    """The nearest point of each pixel."""
    p = spherical(points, **kwargs).where("u >= 0")
    return p.groupBy("frame_id", "v", "u").agg(F.min(F.struct("r", "point_idx", "x_mm", "y_mm", "z_mm", "i_pct")).alias("p")).select("frame_id", "v", "u", "p.*")
