import itertools
import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions import models, register
from gridloom.operators import cluster, health, track
from gridloom.operators.assignment import assign
from gridloom.plans.object_queries import detections
from gridloom.sources import sweeps, velodyne
from gridloom.streaming import stateful

DIR = "/root/testdata/sf0.001"


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
@settings(max_examples=80, deadline=None)
def test_assignment_is_least(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    pairs = assign(cost)
    assert len(pairs) == min(n, m) == len({r for r, _ in pairs}) == len({c for _, c in pairs})
    small, big = (n, m) if n <= m else (m, n)
    c = cost if n <= m else cost.T
    best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
    assert math.isclose(sum(cost[r, k] for r, k in pairs), best)


def test_dbscan_on_constructed_points():
    a = np.array([[x * 100.0, 0, 0] for x in range(8)])
    b = a + [5000, 0, 0]
    noise = np.array([[2500.0, 0, 0]])
    border = np.array([[1100.0, 0, 0]])
    labels = cluster.dbscan_labels(np.vstack([b, noise, a, border]), 450, 5)
    assert list(labels) == [0] * 8 + [-1] + [1] * 8 + [1]


def test_rotated_overlap():
    box = np.array([0, 0, 4, 2, 0.3])
    assert math.isclose(cluster.rotated_iou(box, box), 1.0)
    assert math.isclose(cluster.rotated_iou(np.array([0, 0, 2, 2, 0]), np.array([1, 0, 2, 2, 0])), 1 / 3)
    assert cluster.rotated_iou(np.array([0, 0, 2, 2, 0]), np.array([9, 0, 2, 2, 1])) == 0
    assert math.isclose(cluster.rotated_iou(np.array([0, 0, 2, 2, 0]), np.array([0, 0, 2, 2, math.pi / 4])), (8 * math.sqrt(2) - 8) / (8 - (8 * math.sqrt(2) - 8)))


def test_porosity_of_grass_and_trunk(spark):
    rng = np.random.default_rng(0)
    grass = [(0, 1, i, int(rng.integers(0, 900)), int(rng.integers(0, 900)), int(rng.integers(100, 700)), int(rng.integers(20, 50))) for i in range(60)]
    trunk = [(0, 2, 100 + i, int(rng.integers(0, 90)), 0, i * 42, int(rng.integers(85, 100))) for i in range(60)]
    df = spark.createDataFrame(grass + trunk, "frame_id bigint, label bigint, point_idx bigint, x_mm bigint, y_mm bigint, z_mm bigint, i_pct bigint")
    got = {r.label: (r.is_porous, r.cost) for r in cluster.porosity(df).collect()}
    assert got == {1: (True, 20), 2: (False, 255)}


def test_track_converges_coasts_and_ends():
    tracks, next_id = [], 0
    for k in range(30):
        d = {"x": 5 + 0.2 * k, "y": 1.0, "length": 4.0, "width": 1.8, "height": 1.5, "kind": "vehicle"}
        tracks, next_id = track.step(tracks, next_id, [d], 0.1)
    assert next_id == 1 and tracks[0].hits == 30 and abs(tracks[0].vx - 2.0) < 0.4
    lives = []
    for _ in range(7):
        tracks, next_id = track.step(tracks, next_id, [], 0.1)
        lives.append(len(tracks))
    assert lives == [1] * 5 + [0, 0]
    assert not tracks


def test_stream_gives_what_batch_gives(spark, tmp_path):
    own = detections(spark, DIR).where("sensor_id < 3").toPandas()
    want = track.track(spark.createDataFrame(own)).toPandas()
    for k, part in enumerate((own[own.frame_id < 20], own[(own.frame_id >= 20) & (own.frame_id < 41)], own[own.frame_id >= 41])):
        part.to_parquet(tmp_path / f"{k}.parquet")
    schema = spark.createDataFrame(own).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = stateful.tracks(s).writeStream.format("memory").queryName("tracked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("tracked").toPandas()
    key = ["sensor_id", "frame_id", "track_id"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_sweep_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    for width in (3, 4, 5):
        n = {3: 7, 4: 8, 5: 3}[width]  # counts that only this width divides, in the order 4, 5, 3
        rng.random((n, width)).astype("<f4").tofile(tmp_path / f"{width}.bin")
    (tmp_path / "bad.bin").write_bytes(b"abc")
    got = velodyne.read(spark, str(tmp_path))
    assert {r.path[-5]: r["count"] for r in got.groupBy("path").count().collect()} == {"3": 7, "4": 8, "5": 3}
    assert got.where("path LIKE '%3.bin' AND intensity <> 15").count() == 0 and got.where("ring IS NOT NULL").count() == 3
    velodyne.register(spark)
    assert spark.read.format("velodyne").load(str(tmp_path)).count() == 18
    out = tmp_path / "out"
    out.mkdir()
    velodyne.write(got.where("path LIKE '%4.bin'"), str(out))
    assert (out / "4.bin").read_bytes() == (tmp_path / "4.bin").read_bytes()
    assert {r.frame_id for r in velodyne.numbered(got).select("frame_id").distinct().collect()} == {0, 1, 2}
    assert velodyne.folder_of(["d/velodyne", "d"], "static", "d") == "d/velodyne" and velodyne.folder_of([], "static", "d") is None


def test_procedural_sweep(spark):
    p = sweeps.procedural(spark, 2)
    assert p.count() == 17_200 and p.select("frame_id", "point_idx").distinct().count() == 17_200
    assert p.where("point_idx < 6000 AND NOT (y_mm BETWEEN -4000 AND 4000 AND z_mm BETWEEN -1615 AND -1585)").count() == 0


def test_playback():
    p = stateful.Playback(10)
    assert p.handle('{"command": "ping"}') == {"type": "pong"}
    assert p.handle('{"command": "seek", "frame": 99}')["frame"] == 9 and p.advance() == 9 and p.at == 0
    assert p.handle('{"command": "toggle_pause"}')["paused"] and p.advance() is None
    assert p.handle('{"command": "next"}')["frame"] == 1 and p.handle('{"command": "play"}')["paused"] is False
    assert p.handle('{"command": "set_speed", "speed": 99}')["speed"] == 10 and p.pause_s(4, 0.0) == 0.05
    assert p.handle('{"command": "set_dataset", "dataset": "dynamic"}')["type"] == "dataset_swapped"
    assert p.handle("nonsense")["type"] == p.handle('{"command": "jump"}')["type"] == "error"


def test_sql_functions(spark):
    names = register(spark)
    assert "bresenham" in names
    r = spark.sql("SELECT zone_of(10000, 0) AS z, cost_band(181) AS b, cell_id(2, 100, -1.5D, 2.25D) AS c, cell_of(-1, 500) AS k, bev_iou(0D, 0D, 2D, 2D, 1D, 0D, 2D, 2D) AS i").first()
    assert (r.z, r.b, r.c, r.k) == (2, "lethal", "z2_0.10m_-001.5000_+002.2500", -1) and abs(r.i - 1 / 3) < 1e-12
    path = [(x.x, x.y) for x in spark.sql("SELECT * FROM bresenham(3, -2)").collect()]
    assert path == health.bresenham(3, -2) and path[0] == (0, 0) and path[-1] == (3, -2)
    assert len(health.bresenham(500, 1)) == 60


def test_models_never_stand_in(spark):
    r = models.Registry()
    assert r.get("none").state == models.UNAVAILABLE and r.add("off", lambda x: x, enabled=False).state == models.DISABLED
    assert r.add_onnx("gone", "/nowhere.onnx").state == models.UNAVAILABLE
    own = r.add("sum", lambda x: x.sum(axis=1))
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert models.score(df, own, ["a", "b"], "s").first().s == 3.0
    row = models.score(df, r.get("gone"), ["a", "b"], "s").first()
    assert row.s is None and row.s_state == models.UNAVAILABLE
    assert models.slots([1.0] * 10)[[9, 10, 14, 15, 30, 34]].tolist() == [0, 1, 1, 0, 1, 1]
