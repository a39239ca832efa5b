"""Steps over whole frames in batches against loops, and that they neither copy nor join points."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells as ce, cluster, frames as fr, points as pt, raster, spatial, telemetry as tm, track as tr
from gridloom.plans import cell_queries as cq, object_queries as oq, point_queries as pq, raster_queries as rq

DIR = "/root/testdata/sf0.001"
POINT = "frame_id bigint, point_idx bigint, x_mm bigint, y_mm bigint, z_mm bigint, i_pct bigint"


def _rows(sizes, spread, seed=5):
    rng = random.Random(seed)
    return [(f, k, rng.randrange(-spread, spread), rng.randrange(-spread, spread), rng.randrange(-500, 500), 0) for f, n in enumerate(sizes) for k in range(n)]


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# F2
def test_dust_of_small_frames_is_the_same_by_all_pairs_and_by_cells(spark, short_batches):
    rows = _rows([1, 2, 5, 6, 7, 16, 40, 90], 4000) + [(6, 900, 30_000, 0, 0, 0), (7, 900, 60_000, 0, 0, 0), (7, 901, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, POINT)
    by_pairs, by_cells = pt.dust_small(df, 5), pt.dust_small(df, 5, direct=0)
    assert sorted(by_pairs.collect(), key=str) == sorted(by_cells.collect(), key=str) and 0 < by_pairs.count() < len(rows)
    mixed = pt.dust_small(df, 5, direct=20)  # frames on both sides
    assert sorted(mixed.collect(), key=str) == sorted(by_cells.collect(), key=str)


def test_dust_copies_and_joins_no_points(spark):
    plan = _plan(pq.QUERIES["dust_filter_small"](spark, DIR))
    assert "Join" not in plan and "Generate explode" not in plan


def test_nearest_distances_are_those_of_all_pairs():
    rows = np.array(_rows([1, 2, 5, 17, 60], 900))
    xyz, frames = rows[:, 2:5], rows[:, 0]
    got = fr.nearest_distances(xyz, frames, 4)
    for i in range(len(xyz)):
        want = sorted(int(((xyz[i] - xyz[j]) ** 2).sum()) for j in range(len(xyz)) if j != i and frames[j] == frames[i])[:4]
        assert got[i].tolist() == want + [-1] * (4 - len(want))


# F3
def test_a_mean_just_below_zero_keeps_its_sign(spark):
    leaf = spark.createDataFrame([(0, 500, 1, 1, -0.4, 300, 200, 255)], "frame_id bigint, size_mm int, gy bigint, gx bigint, mean_z double, dz bigint, z_max bigint, cost int")
    none = spark.createDataFrame([], "frame_id bigint, track_id int, x double, y double, vx double, vy double, is_dynamic boolean")
    frame = tm.frames(leaf, none, 50).first().frame
    assert '"z":-0.0,' in frame and json.loads(frame)["cells"][0]["z"] == 0


# F4
def test_a_message_holds_each_pixel_at_its_place(spark):
    px = spark.createDataFrame([(3, 0, 1, 50), (3, 2, 3, 100), (4, 3, 0, 0)], "frame_id bigint, row int, col int, value int")
    got = raster.grid_message(px, pixels=4)
    data = {r.frame_id: list(r.data) for r in got.collect()}
    assert data == {3: [-1, 50] + [-1] * 9 + [100] + [-1] * 4, 4: [-1] * 12 + [0, -1, -1, -1]}
    assert got.schema["data"].dataType.simpleString() == "array<tinyint>"


def test_a_message_is_not_a_join_of_all_pixels(spark):
    plan = _plan(rq.QUERIES["occupancy_message"](spark, DIR))
    assert "sequence(0, 399" not in plan


# F5, F7
def test_components_of_frames_in_one_batch(spark, short_batches):
    rows = _rows([1, 2, 30, 30, 80], 2500)
    got = {(r.frame_id, r.point_idx): r.label for r in cluster.bev_components(spark.createDataFrame(rows, POINT)).collect()}
    for f in range(5):
        own = {(r[1]): (r[3] // 350, r[2] // 350) for r in rows if r[0] == f}
        left, label, want = set(own.values()), 0, {}
        for c in sorted(left):
            if c in want:
                continue
            todo = [c]
            while todo:
                y, x = todo.pop()
                if (y, x) in left and (y, x) not in want:
                    want[y, x] = label
                    todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            label += 1
        assert {k: want[c] for k, c in own.items()} == {k: got[f, k] for k in own}


def test_components_and_clusters_join_no_points(spark):
    assert "Join" not in _plan(oq.QUERIES["bev_components"](spark, DIR))
    plan = _plan(oq.QUERIES["clusters_by_size"](spark, DIR))
    assert "Join" not in plan and "Union" not in plan


def test_clusters_by_the_size_of_the_frame(spark, short_batches):
    df = spark.createDataFrame(_rows([3, 15, 25, 60, 61, 120], 1500), POINT)
    own = cluster.region(df)
    n = own.groupBy("frame_id").count().withColumnRenamed("count", "n")
    many, few = (own.join(n.where(w), "frame_id").drop("n") for w in ("n > 60", "n <= 60"))
    want = cluster.bev_components(many).unionByName(cluster.dbscan(few).where("label >= 0"))
    assert sorted(cluster.clustered(df).collect()) == sorted(want.collect())


# F6
def test_balls_are_those_of_all_pairs(spark, short_batches):
    rows = _rows([1, 3, 20, 70], 1500) + [(3, 900, None, 0, 0, 0)]
    got = pt.dense_balls(spark.createDataFrame(rows, POINT), 800, 4)
    near = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5], strict=True)) <= 640_000
    whole = [r for r in rows if r[2] is not None]
    assert sorted(tuple(r) for r in got.collect()) == sorted(r for r in whole if sum(near(r, o) for o in whole if o[0] == r[0]) >= 4)
    plan = _plan(pq.QUERIES["speckle_strip_ball"](spark, DIR))
    assert "Join" not in plan and "explode" not in plan


# F8
def test_throttling_goes_on_from_batch_to_batch(spark, short_batches):
    rng = random.Random(3)
    rows = [(u, i, None if rng.random() < 0.05 else float(rng.randrange(0, 90))) for u in (1, 2, None) for i in range(60)] + [(7, 0, 5.0)]
    got = tm.throttled(spark.createDataFrame(rows, "user_id bigint, event_id bigint, t double"), "user_id", "t", "event_id", 10.0)
    want = set()
    for u in (1, 2, None, 7):
        last = -1e9
        for t, i in sorted((-1e12 if r[2] is None else r[2], r[1]) for r in rows if r[0] == u):
            if t == -1e12 or t >= last + 10:
                want.add((u, i))
                last = last if t == -1e12 else t
    assert {tuple(r) for r in got.collect()} == want
    assert "FlatMapGroups" not in _plan(oq.QUERIES["throttled_1hz"](spark, DIR))
    assert got.agg(F.count(F.lit(1))).first()[0] == len(want)


# F1
def test_copies_of_cells_are_not_broadcast(spark):
    """The plans as adaptive execution leaves them: no side of these joins is sent to the driver."""
    rng = random.Random(1)
    cells = spark.createDataFrame([(f, x, y, rng.random() < 0.9, -1_600_000) for f in range(3) for x in range(12) for y in range(12) if rng.random() < 0.8], "frame_id bigint, gx bigint, gy bigint, ground boolean, z_um bigint")
    holes = cells.select("frame_id", F.col("gx") + 1, "gy").toDF("frame_id", "gx", "gy")
    got = raster.smoothed(cells, holes)
    own = {tuple(r)[:3]: r.z_um for r in cells.where("ground").collect()}
    for r in got.collect():
        if 4 <= r.gx and 2 <= r.gy:  # away from the mirrored borders
            box = [z for (f, x, y), z in own.items() if f == r.frame_id and abs(x - r.gx) <= 4 and abs(y - r.gy) <= 2]
            assert (r.sum_z, r.n_z) == (sum(box), len(box))
    assert "BroadcastHashJoin" not in _plan(got)
    leaves = spark.createDataFrame([(0, 1, 1, 500, -1700, -1500, 200, -1600.0, 0)], "frame_id bigint, gx bigint, gy bigint, size_mm int, z_min bigint, z_max bigint, dz bigint, mean_z double, cost int")
    points = spark.createDataFrame(_rows([5], 900), POINT)
    circles = spark.createDataFrame([(0, 0.0, 0.0, 700.0, 255)], "frame_id bigint, x double, y double, radius double, cost int")
    for plan in (spatial.occupancy(leaves, points), spatial.vegetation(leaves, points.withColumn("label", F.lit(1))), spatial.stamp(spatial.centres(leaves), circles)):
        plan.collect()
        assert "BroadcastHashJoin" not in _plan(plan)


# F9
def test_documents_are_made_of_what_was_made_once(spark):
    """One pass for the components, which merging takes as they are, and points read from a table instead of the source."""
    plan = _plan(oq.QUERIES["document_statistics"](spark, DIR))
    assert plan.count("MapInArrow") == 2 and "FlatMapGroups" not in plan and "lineitem" not in plan


def test_merging_looks_at_every_pair_of_a_frame(spark, short_batches, monkeypatch):
    monkeypatch.setattr(fr, "_BLOCK", 5)
    frames = np.repeat([0, 1, 2, 3], [1, 2, 6, 3])
    got = [(a, b) for i, j in fr.pair_blocks(frames) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(got) == [(a, b) for a in range(12) for b in range(a + 1, 12) if frames[a] == frames[b]]
    line = "frame_id bigint, label bigint, kind string, x_lo bigint, x_hi bigint, y_lo bigint, y_hi bigint, z_lo bigint, z_hi bigint"
    rows = [(f, k, None if k == 3 else "obstacle", 1000 * k * k, 1000 * k * k + 900, 0, 500, 0, 500) for f in (1, 2, None) for k in range(12)]
    rows += [(2, 40, "vehicle", 121_000 + 1500, 124_000, 0, 500, 0, 500), (2, 41, "obstacle", 124_000, 125_000, 0, 500, 2000, 2500)]
    got = {(r.frame_id, r.label): r.group for r in cluster.merged(spark.createDataFrame(rows, line)).collect()}
    want = {(f, k): 0 if k < 2 else k for f in (1, 2) for k in range(12)} | {(2, 40): 11, (2, 41): 41}
    assert got == want


# F10
def test_sensors_step_together_as_each_does_alone(spark, short_batches, monkeypatch):
    """Crowded, empty and missing frames, crossing and coasting tracks; and a task makes a step a frame, not one a sensor."""
    monkeypatch.setattr(tr, "MOST", 6)
    rng = random.Random(8)
    value = lambda share, lo, hi: rng.uniform(lo, hi) if rng.random() < share else None
    rows = []
    for sensor in range(9):
        for frame in range(sensor % 3, 60, 1 + sensor % 2):
            many = rng.choice([0, 1, 2, 3, 3, 4, 9]) if rng.random() < 0.9 else -1
            rows += [(sensor, frame, k, rng.uniform(0, 5), rng.uniform(0, 5), value(0.3, -2, 2), value(0.3, -2, 2), 4.0, 1.8, float(k), rng.choice(["car", "post", None])) for k in range(many)]
            rows += [(sensor, frame, 0, None, None, None, None, None, None, None, None)] * (many == 0)
    fleet, want = tr.Fleet(0.1), []
    value = lambda v: np.nan if v is None else v
    part = lambda own: (np.array([[value(v) for v in r[3:10]] for r in own], float), np.array([r[10] for r in own], object))
    for sensor in range(9):
        alone = tr.Follower(0.1)
        for frame in range(60):
            if own := [r for r in rows if r[:2] == (sensor, frame)]:
                alone.frame(sensor, frame, *part(own))
        want += alone.reported().to_pylist()
    got = []
    for frame in range(60):
        if own := sorted((r for r in rows if r[1] == frame), key=lambda r: (r[0], r[2])):
            fleet.frame(frame, np.array([r[0] for r in own]), *part(own))
            got += [r for b in fleet.reported() for r in b.to_pylist()]
    key = lambda r: (r["sensor_id"], r["frame_id"], r["track_id"])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 500
    monkeypatch.undo()
    df = spark.createDataFrame(rows, "sensor_id bigint, frame_id bigint, det_id int, x double, y double, vx double, vy double, length double, width double, height double, kind string")
    assert "Sort [frame_id" in _plan(tr.track(df))


# F11
def test_levels_are_split_after_one_sort(spark, short_batches):
    rows = [(f if f else None, *r) for f, *r in _rows([40, 1, 200, 600], 700)] + [(3, 900, None, 0, 0, 0), (3, 901, 0, 0, None, 0), (3, 902, 60_000, 35_000, 0, 0)]
    rows = [(f, i, x, y, z if z is None or i % 90 == 0 else z - 1900, c) for f, i, x, y, z, c in rows]
    want = []

    def quarter(frame, k, gx, gy, own):
        lo, hi = min(p[4] for p in own), max(p[4] for p in own)
        split = len(own) >= 3 and hi - lo > 180
        lethal = k == 0 and split and sum(p[4] > -1200 for p in own) >= 3
        if k == 3 or not split or lethal:
            want.append((frame, k, gx, gy, lo, hi, len(own), 255 if lethal else -1))
            return
        for a in (0, 1):
            for b in (0, 1):
                x, y = 2 * gx + a, 2 * gy + b
                inner = [p for p in own if (2 * (p[2] + 40_000) // (1000 >> k + 1), 2 * (p[3] + 35_000) // (1000 >> k + 1)) == (x, y)]
                if inner:
                    quarter(frame, k + 1, x, y, inner)

    whole = [r for r in rows if None not in r[2:]]
    for cell in {(r[0], (r[2] + 40_000) // 500, (r[3] + 35_000) // 500) for r in whole}:
        quarter(cell[0], 0, *cell[1:], [r for r in whole if (r[0], (r[2] + 40_000) // 500, (r[3] + 35_000) // 500) == cell])
    got = ce.split_levels(spark.createDataFrame(rows, POINT))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len({w[1] for w in want}) == 4
    plan = _plan(cq.QUERIES["quad_split_levels"](spark, DIR))
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
