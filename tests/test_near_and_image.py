"""k nearest, containment and the linear quadtree against loops; range images through a model."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import models
from gridloom.operators import cells, ground, points as pt, raster, segment, spatial
from gridloom.plans import pipeline
from gridloom.plans.common import points

DIR = "/root/testdata/sf0.001"
POINT = "frame_id bigint, point_idx bigint, x_mm bigint, y_mm bigint, z_mm bigint, i_pct bigint"


def test_nearest_are_those_of_all_pairs(spark):
    """Dense and sparse frames, points on one spot, a far one, and frames with fewer than k others."""
    rng = random.Random(2)
    rows = [(0, k, rng.randrange(-3000, 3000), rng.randrange(-3000, 3000), rng.randrange(0, 500), 0) for k in range(400)]
    rows += [(0, 900, 90_000, -80_000, 0, 0), (0, 901, 90_000, -80_000, 0, 0)] + [(0, 910 + k, 1, 1, 1, 0) for k in range(9)]
    rows += [(1, k, rng.randrange(-50_000, 50_000), rng.randrange(-50_000, 50_000), 0, 0) for k in range(60)]
    rows += [(2, k, k * k * 7, 0, 0, 0) for k in range(5)] + [(3, 7, 0, 0, 0, 0)]
    got = {}
    for r in pt.k_nearest(spark.createDataFrame(rows, POINT), 6).collect():
        got.setdefault((r.frame_id, r.point_idx), []).append((r.d2, r.other))
    assert got.keys() == {r[:2] for r in rows if r[0] != 3}
    for f, i, x, y, z, _ in rows:
        near = sorted(((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, j) for g, j, a, b, c, _ in rows if g == f and j != i)[:6]
        assert f == 3 or sorted(got[f, i]) == near


def test_no_points_no_neighbours(spark):
    assert pt.k_nearest(spark.createDataFrame([], POINT), 3).count() == 0


def test_nearest_has_no_join_of_a_frame_with_itself(spark):
    """A frame of many points: no step has more pairs than a multiple of the points, as a plan by frame_id alone would."""
    df = spark.range(6000).selectExpr("0L AS frame_id", "id AS point_idx", "id % 80 * 700 AS x_mm", "id div 80 * 700 AS y_mm", "0L AS z_mm", "0L AS i_pct")
    got = pt.k_nearest(df, 8)
    assert got.groupBy("point_idx").count().where("count <> 8").isEmpty() and got.agg(F.max("d2")).first()[0] <= 3 * 700 * 700 * 3


def test_points_on_borders_count_for_both(spark):
    leaves = spark.createDataFrame([(0, gx, 140, 500, 0) for gx in (79, 80, 81)] + [(0, 321, 560, 125, 7)], "frame_id bigint, gx bigint, gy bigint, size_mm int, cost int")
    df = spark.createDataFrame([(0, 0, 0, 35_250, 0, 0)], POINT)  # on the border of 79 and 80
    got = {(r.size_mm, r.gx): r.cost for r in spatial.costs_of_points(leaves, df.withColumn("y_mm", F.lit(35_250))).collect()}
    assert got == {(500, 79): 255, (500, 80): 255, (500, 81): 0, (125, 321): 7}


@pytest.mark.parametrize("depth", [0, 2, 3, 5])
def test_quadtree_is_the_recursion(spark, depth):
    rng = random.Random(depth)
    rows = [(f, k, rng.choice([rng.randrange(0, 1500), rng.randrange(0, 60)]), rng.randrange(0, 1000), rng.choice([0, 0, 30, 250]) + rng.randrange(-1700, -1690) + (900 if rng.random() < 0.03 else 0), 0) for f in (0, 1) for k in range(150)]
    want = set()

    def split(frame, own, level, gx, gy):
        z = [r[4] for r in own]
        deep = len(own) >= 3 and max(z) - min(z) > 180
        block = level == 0 and deep and sum(v > -1200 for v in z) >= 3
        if not deep or block or level == depth:
            want.add((frame, level, gx, gy, min(z), max(z), len(z), 255 if block else -1))
            return
        parts = {}
        for r in own:
            size2 = (1000 >> level) / 2
            parts.setdefault((int((r[2] + 40_000) * 2 // size2), int((r[3] + 35_000) * 2 // size2)), []).append(r)
        for (a, b), more in parts.items():
            split(frame, more, level + 1, a, b)

    tops = {}
    for r in rows:
        tops.setdefault((r[0], (r[2] + 40_000) // 500, (r[3] + 35_000) // 500), []).append(r)
    for (f, gx, gy), own in tops.items():
        split(f, own, 0, gx, gy)
    # lengths are whole only down to 1000 >> 3 half millimetres
    if depth <= 3:
        assert {tuple(r) for r in cells.split_levels(spark.createDataFrame(rows, POINT), depth).collect()} == want
    else:
        with pytest.raises(ValueError):
            cells.split_levels(spark.createDataFrame(rows, POINT), depth)


def test_images_through_a_model(spark):
    """Scores by class and labels as they are, back at the points of each pixel, against a loop over the points."""
    df = points(spark, DIR).withColumns({"x_mm": F.col("x_mm") * 7, "y_mm": F.col("y_mm") * 7})
    own = df.collect()

    def scores(x):
        """Class by the pixel's column and height; a pixel without a point has class 0."""
        assert x.shape == (1, 5, 64, 1024) and x.dtype == np.float32
        out = np.zeros((1, 4, 64, 1024), np.float32)
        u = np.broadcast_to(np.arange(1024), (64, 1024))
        for k in range(4):
            out[0, k] = ((u % 3 + (x[0, 3] > -1.5)) % 4 == k) * (x[0, 0] > 0)
        return out

    by_class = models.Registry().add("seg", scores)
    plain = models.Registry().add("seg", lambda x: scores(x).argmax(axis=1))
    nearest, pixel = {}, {}
    for p in own:
        x, y, z = p.x_mm / 1000, p.y_mm / 1000, p.z_mm / 1000
        r = math.sqrt(x * x + y * y + z * z)
        u, v = math.floor(0.5 * (1 - math.atan2(y, x) / math.pi) * 1024), math.floor((1 - (math.degrees(math.asin(z / r)) + 25) / 28) * 64)
        if r > 0.1 and 0 <= u < 1024 and 0 <= v < 64:
            pixel[p.frame_id, p.point_idx] = (v, u)
            nearest[p.frame_id, v, u] = min(nearest.get((p.frame_id, v, u), (9e9,)), (r, p.point_idx, p.z_mm))
    want = {}
    for p in own:
        key = (p.frame_id, p.point_idx)
        if key in pixel:
            v, u = pixel[key]
            want[key] = ((u % 3 + (np.float32(nearest[p.frame_id, v, u][2] / 1000) > np.float32(-1.5))) % 4, "model")
        else:
            want[key] = (2 if p.z_mm >= 1000 else 1 if p.z_mm > 150 else 0, "height")
    for model in (by_class, plain):
        got = {(r.frame_id, r.point_idx): (r.label, r.label_source) for r in segment.segmented(df, model).collect()}
        assert len(got) == len(own) and sum(got[k] != want[k] for k in want) <= 0.001 * len(want)  # a direction on a pixel's border
    assert {s for _, s in want.values()} == {"model", "height"}
    off = segment.segmented(df, models.Model("seg", models.UNAVAILABLE))
    assert off.where("label_source <> 'height'").isEmpty() and segment.pixel_labels(df, models.Model("seg", models.DISABLED)).isEmpty()
    wrong = models.Registry().add("seg", lambda x: np.zeros((3, 3)))
    with pytest.raises(Exception, match="answered with"):
        segment.segmented(df, wrong).count()


def test_the_frame_path_takes_models(spark):
    """All rigid by the model: leaves that hold points are lethal. No threat by the model: no thin hazard."""
    df = points(spark, DIR).where("frame_id < 1")
    rigid = models.Registry().add("seg", lambda x: np.full((1, 64, 1024), 2))
    none = models.Registry().add("threats", lambda x: np.full((1, 512), -50.0))
    made = pipeline.process(df, segmentation=rigid, threats=none)
    assert made.thin.count() == 0
    seen = ground.spherical(made.points).where("u >= 0 OR z_mm >= 1000").selectExpr("frame_id", "(x_mm + 40000) div 500 AS kx", "(y_mm + 35000) div 500 AS ky").distinct()
    lethal = made.leaves.where("NOT inpainted").selectExpr("frame_id", "CAST((gx + 0.5) * size_mm AS BIGINT) div 500 AS kx", "CAST((gy + 0.5) * size_mm AS BIGINT) div 500 AS ky", "terrain_cost")
    assert lethal.join(seen, ["frame_id", "kx", "ky"]).where("terrain_cost < 255").isEmpty()


def test_bridged_cells_are_those_of_sparse_closings(spark):
    """The four closings on arrays against the same of sparse cells, borders included."""
    rng = random.Random(9)
    rows = [(f, x, y, rng.random() < (0.9, 0.5, 0.2)[f]) for f in range(3) for x in range(24) for y in range(18) if rng.random() < 0.55]
    table = spark.createDataFrame(rows, "frame_id bigint, gx bigint, gy bigint, ground boolean")
    nx, ny, key = 24, 18, raster.KEY
    g = table.where("ground").select(*key)
    near = raster.dilated(g, 1, 1, nx, ny).join(raster.closed(g, 2, 2, nx, ny), key, "left_semi")
    filled = near
    for r in ((1, 1), (6, 3), (3, 4)):
        filled = filled.unionByName(raster.closed(g, *r, nx, ny))
    want = {tuple(r) for r in filled.distinct().join(table.select(*key), key, "left_anti").select(*key).collect()}
    got = [tuple(r) for r in raster.bridged(table, nx, ny).select(*key).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
