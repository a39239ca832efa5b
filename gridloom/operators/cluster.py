"""Clusters of obstacle points, their labels, merging and porosity, and suppression of boxes.

A frame's obstacle cells are bounded by the sensor, so what is sequential runs as one group of a frame in Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.binning import cell
from gridloom.operators.frames import fields, least_members, near_blocks, numbered, pair_blocks, places, whole_frames
from gridloom.operators.greedy import losers
from gridloom.operators.points import per_frame

CELL = 350


def region(points: DataFrame) -> DataFrame:
    """Points in the corridor that is searched for objects."""
    return points.where(F.col("x_mm").between(-25_000, 55_000) & F.col("y_mm").between(-20_000, 20_000) & F.col("z_mm").between(-2200, 2500))


def _narrow(v: np.ndarray) -> np.ndarray:
    """Places of sorted numbers, from 1, with gaps cut to 2."""
    return np.cumsum(np.minimum(np.diff(v, prepend=v[:1] - 1), 2))


def bev_labels(x: np.ndarray, y: np.ndarray, frames: np.ndarray, size: int = CELL) -> np.ndarray:
    """Of each point, the number, in order of the least cell, of its frame's 8-connected component; a frame's points stand together."""
    cx, cy = x // size, y // size
    order = np.lexsort([cx, cy, frames])
    fs, ys = frames[order], cy[order]
    step = np.minimum(np.diff(ys, prepend=ys[:1] - 1), 2)
    row = np.cumsum(np.where(np.diff(fs, prepend=fs[:1] - 1) != 0, 2, step))  # rows of neighbouring frames do not touch
    values, at = np.unique(cx, return_inverse=True)
    width = 2 * len(values) + 3
    key = row * width + _narrow(values)[at][order]
    cells, of = np.unique(key, return_inverse=True)
    pairs = [(np.arange(0), np.arange(0))]
    for shift in (1, width - 1, width, width + 1):
        other = np.minimum(np.searchsorted(cells, cells + shift), len(cells) - 1)
        met = np.flatnonzero(cells[other] == cells + shift)
        pairs.append((met, other[met]))
    root = least_members(len(cells), *(np.concatenate(p) for p in zip(*pairs, strict=True)))
    own = np.empty(len(cells), np.int64)
    own[of] = fs
    out = np.empty(len(x), np.int64)
    out[order] = numbered(root == np.arange(len(cells)), own)[root][of]
    return out


def _bev(table: pa.Table, frames: np.ndarray, size: int) -> np.ndarray:
    return bev_labels(table["x_mm"].to_numpy(), table["y_mm"].to_numpy(), frames, size)


def bev_components(points: DataFrame, size: int = CELL) -> DataFrame:
    """points with label: number, in order of the least cell, of the 8-connected component of its cell seen from above.

    Many frames are labelled in one call, and points are neither copied nor joined with cells.
    """
    own = points.where("frame_id IS NOT NULL AND x_mm IS NOT NULL AND y_mm IS NOT NULL")
    own = own.select("frame_id", *[c for c in points.columns if c != "frame_id"])
    return whole_frames(own, lambda table, frames: table.append_column("label", pa.array(_bev(table, frames, size), pa.int64())), f"{fields(own)}, label bigint")


def _neighbours(xyz: np.ndarray, eps: float) -> list[np.ndarray]:
    """Of each point, the points within eps, itself included, in order."""
    a, b = _near_pairs(xyz, np.zeros(len(xyz), np.int64), eps)
    own = np.flatnonzero(np.isfinite(xyz).all(1))
    x, y = np.concatenate([a, b, own]), np.concatenate([b, a, own])
    order = np.lexsort([y, x])
    return np.split(y[order], np.cumsum(np.bincount(x, minlength=len(xyz)))[:-1])


def _near_pairs(xyz: np.ndarray, frames: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """All of near_blocks()."""
    blocks = [(np.arange(0), np.arange(0)), *near_blocks(xyz, frames, eps)]
    return np.concatenate([i for i, _ in blocks]), np.concatenate([j for _, j in blocks])


def dbscan_labels(xyz: np.ndarray, eps: float, least: int, frames: np.ndarray | None = None) -> np.ndarray:
    """-1 for noise; clusters of cores in order of their first core, border points in the first cluster that reaches them.

    frames: of each point, its frame's number, if there are several; a frame's points stand together and are by themselves.
    """
    n = len(xyz)
    frames = np.zeros(n, np.int64) if frames is None else frames
    a, b = _near_pairs(xyz, frames, eps)
    core = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + np.isfinite(xyz).all(1) >= least
    both = core[a] & core[b]
    root = least_members(n, a[both], b[both])
    own = numbered(core & (root == np.arange(n)), frames)[root]
    out = np.where(core, own, n)
    for x, y in ((a, b), (b, a)):
        edge = core[x] & ~core[y]
        np.minimum.at(out, y[edge], own[x[edge]])
    return np.where(out == n, -1, out)


def dbscan(points: DataFrame, eps: int = 450, least: int = 6) -> DataFrame:
    """points with label by density; a frame's points are in one task, compared within 27 cells of eps each, many frames in one call."""

    def labelled(table: pa.Table, frames: np.ndarray) -> pa.Table:
        return table.append_column("label", pa.array(dbscan_labels(places(table, "x_mm", "y_mm", "z_mm"), eps, least, frames), pa.int64()))

    return whole_frames(points, labelled, f"{fields(points)}, label bigint")


def geometric(points: DataFrame, voxel: int = 150, eps: int = 450, least: int = 6, smallest: int = 200) -> DataFrame:
    """Objects by geometry alone: voxels, density clusters, and a box around each; lengths in millimetres.

    frame_id, label, n, the box's corners and doubled centre, and its sides, of at least `smallest`.
    """
    from gridloom.operators.points import first_per_voxel

    found = dbscan(first_per_voxel(points, voxel), eps, least).where("label >= 0")
    sides = [f(f"{a}_mm").alias(f"{a}_{e}") for a in "xyz" for f, e in ((F.min, "lo"), (F.max, "hi"))]
    boxes = found.groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"), *sides).where(F.col("n") >= least)
    extra = {f"{a}_centre2": F.col(f"{a}_lo") + F.col(f"{a}_hi") for a in "xyz"}
    extra |= {f"{a}_side": F.greatest(F.col(f"{a}_hi") - F.col(f"{a}_lo"), F.lit(smallest)) for a in "xyz"}
    return boxes.withColumns(extra).withColumn("kind", F.lit("obstacle"))


def candidates(clusters: DataFrame, porous: DataFrame, boxes: DataFrame) -> DataFrame:
    """What the tracker is given: rigid clusters and a detector's boxes, with source geometric or model; metres.

    clusters: frame_id, label, corners, kind; porous: frame_id, label, is_porous; boxes: frame_id, x, y, length, width,
    height, vx, vy and optionally kind. Order within a frame (det_id) is clusters by label, then boxes by place.
    """
    soft = porous.where("is_porous").select("frame_id", "label")
    rigid = clusters.join(soft, ["frame_id", "label"], "left_anti")
    half = lambda a: (F.col(f"{a}_lo") + F.col(f"{a}_hi")) / 2000.0
    side = lambda a: (F.col(f"{a}_hi") - F.col(f"{a}_lo")) / 1000.0
    nothing = F.lit(None).cast("double")
    own = rigid.select("frame_id", F.lit("geometric").alias("source"), F.col("label").alias("_o"), half("x").alias("x"), half("y").alias("y"), nothing.alias("vx"), nothing.alias("vy"), side("x").alias("length"), side("y").alias("width"), side("z").alias("height"), "kind")
    kinds = F.col("kind") if "kind" in boxes.columns else F.lit("vehicle")
    given = boxes.select("frame_id", F.lit("model").alias("source"), F.lit(0).cast("bigint").alias("_o"), "x", "y", "vx", "vy", "length", "width", "height", kinds.alias("kind"))
    order = per_frame().orderBy("source", "_o", "x", "y", "length", "width", "height")
    return own.unionByName(given).withColumn("det_id", F.row_number().over(order) - 1).drop("_o")


def clustered(points: DataFrame, small: int = 60, most: int = 10_000, eps: int = 450, least: int = 6) -> DataFrame:
    """Labels by components in frames of more than small points of the region, by density in the others; of frames with more
    than `most` points, every third counts. One pass labels both kinds of frames."""
    from gridloom.operators.points import decimate

    r = region(decimate(points, most, 3)).where("frame_id IS NOT NULL")
    r = r.select("frame_id", *[c for c in r.columns if c != "frame_id"])

    def labelled(table: pa.Table, frames: np.ndarray) -> pa.Table:
        many = np.bincount(frames)[frames] > small
        label = np.empty(len(frames), np.int64)
        if many.any():
            label[many] = _bev(table.filter(pa.array(many)), frames[many], CELL)
        if not many.all():
            label[~many] = dbscan_labels(places(table.filter(pa.array(~many)), "x_mm", "y_mm", "z_mm"), eps, least, frames[~many])
        return table.append_column("label", pa.array(label, pa.int64())).filter(pa.array(many | (label >= 0)))

    return whole_frames(r, labelled, f"{fields(r)}, label bigint")


def kind(length: Column, width: Column, height: Column) -> Column:
    """parked_car, pedestrian, vehicle or obstacle by extent in millimetres."""
    car = length.between(3000, 5500) & width.between(1500, 2400) & height.between(1200, 2200)
    return F.when(car, "parked_car").when((height > 1200) & (length < 1200) & (width < 1200), "pedestrian").when((length > 1800) | (width > 1400), "vehicle").otherwise("obstacle")


def summaries(labelled: DataFrame, least: int = 6, most: int = 1500, keep: int = 40) -> DataFrame:
    """The keep largest clusters of least to most points that are no longer than 12 m and no wider than 8 m."""
    aggs = [f(c).alias(f"{c[0]}_{e}") for c in ("x_mm", "y_mm", "z_mm") for f, e in ((F.min, "lo"), (F.max, "hi"), (F.sum, "sum"))]
    c = labelled.groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("i_pct").alias("i_sum"), *aggs).where(F.col("n").between(least, most))
    c = c.withColumn("_r", F.row_number().over(per_frame().orderBy(F.desc("n"), "label"))).where(F.col("_r") <= keep).drop("_r")
    l, w, h = (F.col(f"{a}_hi") - F.col(f"{a}_lo") for a in "xyz")
    return c.where((l <= 12_000) & (w <= 8000)).withColumn("kind", kind(l, w, h))


def merged(clusters: DataFrame, reach: int = 1000) -> DataFrame:
    """Clusters with group, the least label of those that belong to one object. A frame's clusters are compared in one task, many
    frames in a call, so that what they are made of is made once."""
    own = clusters.where("frame_id IS NOT NULL AND label IS NOT NULL")
    own = own.select("frame_id", "label", *[c for c in clusters.columns if c not in ("frame_id", "label")])

    def grouped(table: pa.Table, frames: np.ndarray) -> pa.Table:
        label, vehicle = table["label"].to_numpy(), pc.equal(table["kind"], "vehicle").fill_null(False).to_numpy()
        lo, hi = places(table, "x_lo", "y_lo", "z_lo"), places(table, "x_hi", "y_hi", "z_hi")
        links = [(np.arange(0), np.arange(0))]
        for i, j in pair_blocks(frames):
            gap = np.fmax(np.fmax(lo[i] - hi[j], lo[j] - hi[i]), 0)
            span = np.fmax(hi[i], hi[j])[:, :2] - np.fmin(lo[i], lo[j])[:, :2]
            d2, dz = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1], gap[:, 2]
            near = (vehicle[i] | vehicle[j]) & (d2 <= reach * reach) | (d2 == 0) & (dz < 600) | (d2 <= 360_000) & (span > [1800, 1400]).any(1)
            near = near & (dz <= 1000) | (label[i] == label[j])
            links.append((i[near], j[near]))
        root = least_members(len(label), *(np.concatenate(v) for v in zip(*links, strict=True)))
        return table.append_column("group", pa.array(label[root], pa.int64()))  # in order of label, so the first is the least

    return whole_frames(own, grouped, f"{fields(own)}, group bigint", order="label")


def merged_summaries(clusters: DataFrame) -> DataFrame:
    """One row for each object of merged(): extent, points, sums, parts and label; a vehicle's part makes a vehicle."""
    m = merged(clusters)
    ext = [f(f"{a}_{e}").alias(f"{a}_{e}") for a in "xyz" for f, e in ((F.min, "lo"), (F.max, "hi"), (F.sum, "sum"))]
    g = m.groupBy("frame_id", "group").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("i_sum").alias("i_sum"), F.max(F.col("kind") == "parked_car").alias("_car"), F.max(F.col("kind") == "vehicle").alias("_veh"), F.min("kind").alias("_own"), *ext)
    l, w, h = (F.col(f"{a}_hi") - F.col(f"{a}_lo") for a in "xyz")
    car = F.col("_car") | (l.between(3000, 5500) & w.between(1500, 2400) & h.between(1200, 2200))
    joint = F.when(car, "parked_car").when(F.col("_veh") | (l > 1800) | (w > 1400), "vehicle").when((h > 1200) & (l < 1200) & (w < 1200), "pedestrian").otherwise("obstacle")
    return g.withColumn("kind", F.when(F.col("parts") == 1, F.col("_own")).otherwise(joint)).drop("_car", "_veh", "_own")


def porosity(labelled: DataFrame) -> DataFrame:
    """frame_id, label, is_porous, cost: low growth that lets the beam through is passable."""
    x, y, z = (F.col(c) for c in ("x_mm", "y_mm", "z_mm"))
    var = lambda v: (F.count(F.lit(1)) * F.sum(v * v) - F.sum(v) * F.sum(v)).cast("double") / F.pow(F.count(F.lit(1)).cast("double"), F.lit(2.0)) / 1e6
    c = labelled.groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"), (F.max(z) - F.min(z)).alias("dz"), F.sum("i_pct").alias("i"), (var(x) + var(y)).alias("spread"), var(z).alias("var_z"))
    low = F.col("dz").between(150, 1300)
    soft = F.col("i") <= 60 * F.col("n")
    porous = F.when(F.col("n") < 3, low).when(~low | (F.col("i") >= 75 * F.col("n")), False).when(soft, True).otherwise((F.col("spread") > 0.02) & (F.col("var_z") > 0.005))
    return c.select("frame_id", "label", "n", "dz", porous.alias("is_porous"), F.when(porous, 20).otherwise(255).alias("cost"))


def rotated_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap over union of two boxes x, y, length, width, yaw seen from above, by clipping one with the other; 0 if one has no inside."""
    if a[2] * a[3] <= 0 or b[2] * b[3] <= 0:
        return 0.0

    def corners(v: np.ndarray) -> np.ndarray:
        c, s = math.cos(v[4]), math.sin(v[4])
        return np.array([[v[0] + c * x - s * y, v[1] + s * x + c * y] for x, y in ((v[2] / 2, v[3] / 2), (-v[2] / 2, v[3] / 2), (-v[2] / 2, -v[3] / 2), (v[2] / 2, -v[3] / 2))])

    poly, clip = [tuple(p) for p in corners(a)], corners(b)
    for i in range(4):
        p, q = clip[i], clip[(i + 1) % 4]
        side = lambda t, p=p, q=q: (q[0] - p[0]) * (t[1] - p[1]) - (q[1] - p[1]) * (t[0] - p[0])
        new = []
        for j, t in enumerate(poly):
            s0, s1 = side(poly[j - 1]), side(t)
            if (s0 >= 0) != (s1 >= 0):
                k = s0 / (s0 - s1)
                new.append((poly[j - 1][0] + k * (t[0] - poly[j - 1][0]), poly[j - 1][1] + k * (t[1] - poly[j - 1][1])))
            if s1 >= 0:
                new.append(t)
        poly = new
        if not poly:
            return 0.0
    area = abs(sum(poly[i - 1][0] * poly[i][1] - poly[i][0] * poly[i - 1][1] for i in range(len(poly)))) / 2
    union = a[2] * a[3] + b[2] * b[3] - area
    return float(area / union) if union > 0 else 0.0


#: What rounding may move a corner or an overlap by: lengths in metres, and shares.
_CLOSE = 1e-9


def corners(v: np.ndarray) -> np.ndarray:
    """The corners, in turn, of boxes x, y, length, width, yaw seen from above: n x 5 to n x 4 x 2."""
    c, s = np.cos(v[:, 4:]), np.sin(v[:, 4:])
    a, b = v[:, 2:3] / 2 * [1, -1, -1, 1], v[:, 3:4] / 2 * [1, 1, -1, -1]
    return np.stack([v[:, :1] + c * a - s * b, v[:, 1:2] + s * a + c * b], axis=2)


def shared_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The areas that pairs of boxes share: the corners of each that are in the other, and where sides cross, are the corners of what
    they share, in order of their direction from the middle."""
    p, q = corners(a), corners(b)
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    dp, dq = np.roll(p, -1, axis=1) - p, np.roll(q, -1, axis=1) - q
    inside = lambda t, o, d: (cross(d[:, None], t[:, :, None] - o[:, None]) >= -_CLOSE).all(axis=2)
    det = cross(dp[:, :, None], dq[:, None])
    apart = q[:, None] - p[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        u, w = cross(apart, dq[:, None]) / det, cross(apart, dp[:, :, None]) / det
        met = p[:, :, None] + u[..., None] * dp[:, :, None]
    ok = (np.abs(det) > _CLOSE) & (u >= 0) & (u <= 1) & (w >= 0) & (w <= 1)
    n = len(a)
    points = np.concatenate([p, q, met.reshape(n, 16, 2)], axis=1)
    there = np.concatenate([inside(p, q, dq), inside(q, p, dp), ok.reshape(n, 16)], axis=1)
    points = np.where(there[..., None], points, 0.0)
    size = there.sum(axis=1)
    points = points - (points.sum(axis=1) / np.maximum(size, 1)[:, None])[:, None]
    order = np.argsort(np.where(there, np.arctan2(points[..., 1], points[..., 0]), np.inf), axis=1, kind="stable")
    points, there = np.take_along_axis(points, order[..., None], axis=1), np.take_along_axis(there, order, axis=1)
    points = np.where(there[..., None], points, points[:, :1])  # what is not there is the first corner again
    flat = (a[:, 2] * a[:, 3] <= 0) | (b[:, 2] * b[:, 3] <= 0)  # what has no inside shares nothing
    return np.where((size >= 3) & ~flat, np.abs(cross(points, np.roll(points, -1, axis=1)).sum(axis=1)) / 2, 0.0)


_BOX = ("x", "y", "length", "width", "yaw")


def _above(threshold: float, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.stack([batch.column(keys + k).to_numpy(zero_copy_only=False).astype(float) for k in range(10)], axis=1)
            shared = shared_areas(v[:, :5], v[:, 5:])
            union = v[:, 2] * v[:, 3] + v[:, 7] * v[:, 8] - shared
            yield batch.select(range(keys)).filter(pa.array((union > 0) & (shared > (threshold + _CLOSE) * union)))

    return run


def overlapping(boxes: DataFrame, threshold: float, by: list[str], order: str, cell_m: float = 8.0) -> DataFrame:
    """by, better, worse: pairs of a group's boxes (x, y, length, width, yaw, and a number, order) whose overlap over union is
    above threshold by more than rounding. Pairs come from cells of cell_m that both boxes' circles touch, each from one of them."""
    reach = F.hypot("length", "width") / 2
    k = lambda c, sign: F.floor((F.col(c) + sign * reach) / cell_m)
    b = boxes.select(*by, F.col(order).alias("nth"), *[F.col(c).cast("double").alias(c) for c in _BOX], reach.alias("reach"), k("x", -1).alias("x0"), k("x", 1).alias("x1"), k("y", -1).alias("y0"), k("y", 1).alias("y1"))
    b = b.withColumn("kx", F.explode(F.sequence("x0", "x1"))).withColumn("ky", F.explode(F.sequence("y0", "y1")))
    one, two = (b.select(*by, "kx", "ky", *[F.col(c).alias(f"{c}_{s}") for c in ("nth", *_BOX, "reach", "x0", "y0")]) for s in "ab")
    first = (F.col("kx") == F.greatest("x0_a", "x0_b")) & (F.col("ky") == F.greatest("y0_a", "y0_b"))
    near = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")) < F.col("reach_a") + F.col("reach_b")
    pairs = one.join(two, [*by, "kx", "ky"]).where((F.col("nth_a") < F.col("nth_b")) & first & near)
    pairs = pairs.select(*by, F.col("nth_a").alias("better"), F.col("nth_b").alias("worse"), *[f"{c}_{s}" for s in "ab" for c in _BOX])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema[: len(by) + 2])
    return pairs.mapInArrow(_above(threshold, len(by) + 2), schema)


def suppress(boxes: DataFrame, threshold: float = 0.2, before: int = 1000, after: int = 83) -> DataFrame:
    """Boxes (frame_id, box_id, x, y, length, width, yaw, score, class) that no better one of their class overlaps too much.

    Better is a greater score, then a lesser box_id. Of a frame and class, the `before` best are looked at, and the `after`
    best of those kept stay. Choices are made in rounds over all frames; rows equal in all of the order are interchangeable.
    """
    by = ["frame_id", "class"]
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "box_id", "x", "y", "length", "width", "yaw")
    best = boxes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= before)
    gone = losers(overlapping(best, threshold, by, "_r"), by).withColumnRenamed("worse", "_r")
    kept = best.join(gone, [*by, "_r"], "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_r")))
    return kept.where(F.col("_k") <= after).select(*boxes.columns)


def decode_boxes(df: DataFrame) -> DataFrame:
    """Boxes from anchors (ax..aw, ah, ayaw) and residuals (dx, dy, dz, dl, dw, dh, dsin, dcos): centre, extent and yaw."""
    diagonal = F.hypot("al", "aw")
    e = lambda a, d: F.exp(F.col(d)) * F.col(a)
    return df.select("*", (F.col("dx") * diagonal + F.col("ax")).alias("x"), (F.col("dy") * diagonal + F.col("ay")).alias("y"), (F.col("dz") * F.col("ah") + F.col("az")).alias("z"), e("al", "dl").alias("length"), e("aw", "dw").alias("width"), e("ah", "dh").alias("height"), F.atan2(F.col("dsin") + F.sin("ayaw"), F.col("dcos") + F.cos("ayaw")).alias("yaw"))


def pillars(points: DataFrame, size: int = 200, reach: int = 51_200, each: int = 20, most: int = 30_000) -> DataFrame:
    """The first `each` points of each of a frame's first `most` pillars, with offsets from the pillar's mean and centre."""
    p = points.where(F.col("x_mm").between(-reach, reach - 1) & F.col("y_mm").between(-reach, reach - 1) & F.col("z_mm").between(-5000, 3000))
    p = p.withColumn("px", cell("x_mm", size, -reach)).withColumn("py", cell("y_mm", size, -reach))
    own = Window.partitionBy("frame_id", "py", "px")
    p = p.withColumn("_r", F.row_number().over(own.orderBy("point_idx"))).where(F.col("_r") <= each)
    keep = p.select("frame_id", "py", "px").distinct().withColumn("_k", F.row_number().over(per_frame().orderBy("py", "px"))).where(F.col("_k") <= most).drop("_k")
    p = p.join(keep, ["frame_id", "py", "px"])
    for a in ("x_mm", "y_mm", "z_mm"):
        p = p.withColumn(f"mean_{a[0]}", F.avg(a).over(own))
    centre = lambda k: F.col(k) * size + size / 2 - reach
    p = p.withColumn("from_x", F.col("x_mm") - centre("px")).withColumn("from_y", F.col("y_mm") - centre("py")).withColumn("from_z", F.col("z_mm") + 1000)
    return p.withColumns({f"off_{a}": F.col(f"{a}_mm") - F.col(f"mean_{a}") for a in "xyz"}).drop("_r")


#: Channels of a point of a pillar, lengths in millimetres: place, intensity, ring, offsets from the pillar's mean and its centre.
CHANNELS = ("x_mm", "y_mm", "z_mm", "i_pct", "ring", "off_x", "off_y", "off_z", "from_x", "from_y", "from_z")


def pillar_features(pillars_: DataFrame, model) -> DataFrame:
    """frame_id, px, py, features: the greatest of each of a model's outputs over a pillar's points; null unless it is READY.

    The model maps a matrix of points by CHANNELS (a missing ring is 0) to one of outputs; its weights are the caller's.
    """
    p = pillars_ if "ring" in pillars_.columns else pillars_.withColumn("ring", F.lit(0))
    key = ["frame_id", "px", "py"]
    if model.predict is None:
        return p.select(*key).distinct().withColumn("features", F.lit(None).cast("array<double>"))
    predict = model.predict

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.asarray(predict(frame[list(CHANNELS)].to_numpy(float)), float)
        best = pd.DataFrame(out).groupby([frame.px.to_numpy(), frame.py.to_numpy()]).max()
        return pd.DataFrame({"frame_id": frame.frame_id.iloc[0], "px": best.index.get_level_values(0), "py": best.index.get_level_values(1), "features": list(best.to_numpy())})

    return p.select("frame_id", "px", "py", *[F.col(c).cast("double").alias(c) for c in CHANNELS]).groupBy("frame_id").applyInPandas(run, "frame_id bigint, px bigint, py bigint, features array<double>")
