"""Values of what SQL does not express, against slow and simple forms, and of operators on constructed inputs."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import models
from gridloom.operators import cells, cluster, ground, health, points as pt, raster, spatial, telemetry as tm, track
from gridloom.plans import cell_queries as cq, object_queries as oq, terrain_queries as tq
from gridloom.plans.common import points, tracks, wide
from gridloom.plans.pipeline import process
from gridloom.sources import settings, sweeps, velodyne
from gridloom.streaming import stateful

DIR = "/root/testdata/sf0.001"
POINT = "frame_id bigint, point_idx bigint, x_mm bigint, y_mm bigint, z_mm bigint, i_pct bigint"


def flood(cells_):
    """Component number of each cell by flooding, in order of the least (y, x)."""
    left, out, k = set(cells_), {}, 0
    for start in sorted(cells_, key=lambda c: (c[1], c[0])):
        if start not in left:
            continue
        edge = [start]
        left.discard(start)
        while edge:
            x, y = edge.pop()
            out[(x, y)] = k
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            edge += near
        k += 1
    return out


def test_cluster_summary(spark):
    own = oq._obstacles(spark, DIR).toPandas()
    want = {}
    for frame, p in own.groupby("frame_id"):
        key = list(zip((p.x_mm // 350).tolist(), (p.y_mm // 350).tolist(), strict=True))
        number = flood(set(key))
        p = p.assign(label=[number[k] for k in key])
        groups = [(len(g), k, g) for k, g in p.groupby("label") if 3 <= len(g) <= 1500]
        for n, _, g in sorted(groups, key=lambda v: (-v[0], v[1]))[:40]:
            size = [int(g[c].max() - g[c].min()) for c in ("x_mm", "y_mm")]
            if size[0] <= 12_000 and size[1] <= 8000:
                want[(frame, int(g.x_mm.min()), int(g.y_mm.min()), int(g.z_mm.sum()))] = n
    got = {(r.frame_id, r.x_lo, r.y_lo, r.z_sum): r.n for r in oq.QUERIES["cluster_summary"](spark, DIR).collect()}
    assert got == want and len(got) > 20


def test_merged_clusters_are_what_links_reach(spark):
    parts = oq._summaries(spark, DIR).toPandas()
    got = cluster.merged(oq._summaries(spark, DIR)).toPandas()
    gap = lambda a, b, k: max(a[f"{k}_lo"] - b[f"{k}_hi"], b[f"{k}_lo"] - a[f"{k}_hi"], 0)
    span = lambda a, b, k: max(a[f"{k}_hi"], b[f"{k}_hi"]) - min(a[f"{k}_lo"], b[f"{k}_lo"])
    for frame, own in parts.groupby("frame_id"):
        rows = own.to_dict("records")
        up = {r["label"]: r["label"] for r in rows}
        for _ in rows:
            for a in rows:
                for b in rows:
                    d2, dz = gap(a, b, "x") ** 2 + gap(a, b, "y") ** 2, gap(a, b, "z")
                    veh = "vehicle" in (a["kind"], b["kind"])
                    if a["label"] < b["label"] and dz <= 1000 and ((veh and d2 <= 1e6) or (d2 == 0 and dz < 600) or (d2 <= 360_000 and (span(a, b, "x") > 1800 or span(a, b, "y") > 1400))):
                        up[a["label"]] = up[b["label"]] = min(up[a["label"]], up[b["label"]])
        assert dict(zip(*(got[got.frame_id == frame][c].tolist() for c in ("label", "group")), strict=True)) == up
    merged = oq.QUERIES["cluster_merge"](spark, DIR).toPandas()
    assert merged.parts.sum() == len(parts) and merged.n.sum() == parts.n.sum()


def test_sizes_choose_the_method(spark):
    rows = oq.QUERIES["clusters_by_size"](spark, DIR).toPandas()
    from gridloom.plans.common import small

    own = cluster.region(small(spark, DIR)).toPandas()
    want = {}
    for frame, p in own.groupby("frame_id"):
        p = p.sort_values("point_idx")
        if len(p) > 20:
            want[frame] = (len(set(flood(set(zip((p.x_mm // 350).tolist(), (p.y_mm // 350).tolist(), strict=True))).values())), len(p))
        else:
            labels = cluster.dbscan_labels(p[["x_mm", "y_mm", "z_mm"]].to_numpy(float), 450, 6)
            if (labels >= 0).any():
                want[frame] = (len(set(labels[labels >= 0])), int((labels >= 0).sum()))
    assert {r.frame_id: (r.clusters, r.points) for r in rows.itertuples()} == want


def test_density_by_cells_is_density_by_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(10):
        xyz = rng.integers(-1500, 1500, (120, 3)).astype(float)
        near = ((xyz[:, None] - xyz[None]) ** 2).sum(-1) <= 450**2
        for own, row in zip(cluster._neighbours(xyz, 450), near, strict=True):
            assert own.tolist() == np.flatnonzero(row).tolist()


def test_suppression(spark):
    boxes, kept = oq._boxes(spark, DIR).toPandas(), oq.QUERIES["bev_nms"](spark, DIR).toPandas()
    chosen = set(kept.box_id)
    for _, own in boxes.groupby(["frame_id", "class"]):
        own = own.sort_values(["score", "box_id"], ascending=[False, True])
        v, taken = own[["x", "y", "length", "width", "yaw"]].to_numpy(), []
        for i in range(len(own)):
            if all(cluster.rotated_iou(v[i], v[k]) <= 0.2 for k in taken):
                taken.append(i)
        assert set(own.box_id.iloc[taken[:83]]) == chosen & set(own.box_id)


def test_planes_and_residuals(spark):
    low = ground.split(points(spark, DIR)).where("is_ground").toPandas().sort_values(["frame_id", "point_idx"])
    got = {r.frame_id: np.array([r.a, r.b, r.c, r.d]) / 1e6 for r in tq.QUERIES["plane_fit"](spark, DIR).collect()}
    every = points(spark, DIR).toPandas()
    counted = {r.frame_id: (r.on_plane, r.above) for r in tq.QUERIES["plane_residuals"](spark, DIR).collect()}
    for frame, p in low.groupby("frame_id"):
        some = p.iloc[:: max(len(p) // 300, 1)][["x_mm", "y_mm", "z_mm"]].to_numpy(float) / 1000
        normal = np.linalg.svd(some - some.mean(0), full_matrices=False)[2][-1]
        normal = normal if normal[2] >= 0 else -normal
        d = -normal @ some.mean(0)
        assert np.allclose(got[frame], [*normal, d], atol=1e-5)
        r = every[every.frame_id == frame][["x_mm", "y_mm", "z_mm"]].to_numpy(float) / 1000 @ normal + d
        assert abs(counted[frame][0] - int((np.abs(r) < 0.05).sum())) <= 1 and abs(counted[frame][1] - int((r > 0.3).sum())) <= 1


def test_overlaps_are_resolved(spark):
    every = cells.snapped(cells.foveated(wide(spark, DIR))).toPandas()
    want = Counter()
    for frame, own in every.groupby("frame_id"):
        taken = set()
        for r in own.sort_values(["zone", "size_mm", "cell_id"]).itertuples():
            half = r.size_mm / 2
            bins = {(a, b) for a in range(int((r.x * 1000 - half + 1) // 50), int((r.x * 1000 + half - 1) // 50) + 1) for b in range(int((r.y * 1000 - half + 1) // 50), int((r.y * 1000 + half - 1) // 50) + 1)}
            if not bins & taken:
                taken |= bins
                want[(frame, r.zone)] += 1
    assert {(r.frame_id, r.zone): r.cells for r in cq.QUERIES["foveated_resolved"](spark, DIR).collect()} == want


@pytest.mark.parametrize("end", [(0, 0), (7, 0), (0, -9), (5, 5), (-6, 6), (9, 4), (4, 9), (-11, 3), (3, -11), (-8, -5), (80, 33), (200, -1), (2, 1), (1, 2), (4, 2)])
def test_rays(spark, end):
    got = spark.range(1).select(health.ray(F.lit(end[0]), F.lit(end[1])).alias("r")).first().r
    assert [(p.kx, p.ky) for p in got] == health.bresenham(*end) and [p.n for p in got] == list(range(len(got)))


def test_ghosts(spark):
    """Every leaf against the rules, with rays by the loop."""
    l = spatial.centres(oq._leaves(spark, DIR)).withColumn("x", F.col("x_mm") / 1000).withColumn("y", F.col("y_mm") / 1000).toPandas()
    t = tracks(spark, DIR).toPandas()
    got = {(r.frame_id, r.size_mm, r.gx, r.gy): r.cost for r in oq.QUERIES["ghost_clear"](spark, DIR).collect()}
    feet, at = {}, lambda v: int(np.rint(v * 2))
    for r in t.itertuples():
        reach = int((max(r.length, r.width) / 2 + 0.3) * 2) + 1
        feet.setdefault(r.frame_id, set()).update((at(r.x) + a, at(r.y) + b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1))
    seen = {}
    for r in t.itertuples():
        d, frame = math.hypot(r.x, r.y), r.frame_id + 1
        for a in (-0.2, 0.0, 0.2) if d > 0.2 else ():
            far = (d + 3) / d
            ex, ey = (r.x * math.cos(a) - r.y * math.sin(a)) * far, (r.x * math.sin(a) + r.y * math.cos(a)) * far
            for cell in health.bresenham(at(ex), at(ey)):
                if cell in feet.get(frame, ()):
                    break
                seen.setdefault(frame, set()).add(cell)
    for r in l.itertuples():
        cell = (at(r.x), at(r.y))
        left = cell in feet.get(r.frame_id - 1, ()) and cell not in feet.get(r.frame_id, ()) and r.dz < 150
        sight = cell in seen.get(r.frame_id, ()) and -2150 <= r.mean_z <= -1200 and r.z_max <= -1200
        ahead = 0.5 <= r.x <= 35 and abs(r.y) <= 3 and r.dz < 80 and r.slope < 6
        assert got[(r.frame_id, r.size_mm, r.gx, r.gy)] == (0 if left or sight or ahead else r.cost)


def test_frames_and_their_validation(spark):
    docs = {r.frame_id: json.loads(r.frame) for r in oq.QUERIES["telemetry_frame"](spark, DIR).collect()}
    shown = tm.capped(tm.served(oq._leaves(spark, DIR)), 50).toPandas()
    t = tracks(spark, DIR).toPandas()
    for frame, own in shown.groupby("frame_id"):
        doc = docs[frame]
        assert {(c["size_mm"], c["gx"], c["gy"], c["cost"], c["color"]) for c in doc["cells"]} == set(own[["size_mm", "gx", "gy", "cost", "color"]].itertuples(index=False, name=None))
        assert doc["system_stats"] == {"cells": len(own), "lethal": int((own.cost > 180).sum())}
        assert [o["track_id"] for o in doc["dynamic_objects"]] == sorted(t[(t.frame_id == frame) & t.is_dynamic].track_id)
    free = sum(any(c["cost"] == 0 for c in json.loads(r.frame)["cells"]) for r in tm.frames(oq._leaves(spark, DIR), tracks(spark, DIR), 200).collect())
    assert {r.ok: r.frames for r in oq.QUERIES["frame_validation"](spark, DIR).collect()} == {True: 2 * len(docs) - free, False: free}


def test_whole_path(spark):
    """The frame path on made-up sweeps: parts agree with each other, and the vehicle that moves is tracked."""
    p = sweeps.procedural(spark, 12, 100)
    made = process(p, sensor=F.lit(0).cast("bigint"))
    stats = made.statistics.toPandas().sort_values("frame_id")
    assert len(stats) == 12 and (stats.point_count > 5000).all() and (stats.ground_points + stats.obstacle_points == stats.point_count).all()
    assert (stats.safe_cells + stats.caution_cells + stats.hazard_cells == stats.cell_count).all()
    assert (stats.cell_count == made.leaves.groupBy("frame_id").count().toPandas().set_index("frame_id")["count"].reindex(stats.frame_id).to_numpy()).all()
    moving = made.tracks.where("is_dynamic").toPandas()
    assert len(moving) and abs(moving.sort_values("frame_id").vx.iloc[-1] - 3.5) < 1.5 and (moving.y - 1.8).abs().median() < 1
    assert set(made.health.select("frame_id").toPandas().frame_id) == set(range(12))
    docs = made.documents.collect()
    assert len(docs) == 12 and all(json.loads(r.frame)["cells"] for r in docs)
    pixels = made.raster.toPandas()
    assert set(pixels.value) <= {0, 50, 100} and pixels.row.between(0, 399).all()


def test_empty_null_and_odd_frames(spark):
    none = spark.createDataFrame([], POINT)
    odd = spark.createDataFrame([(0, 0, None, 5, -1600, 10), (0, 1, 100, None, None, None), (0, 2, 0, 0, -1600, 20), (0, 2, 0, 0, -1600, 20)], POINT)
    for df, n in ((none, 0), (odd, 4)):
        assert cells.leaves(df).count() == 0 and pt.first_per_voxel(df.where("x_mm IS NOT NULL AND y_mm IS NOT NULL AND z_mm IS NOT NULL")).count() == (1 if n else 0)
        assert ground.split(df).count() == n and pt.dust(df).count() <= n and cluster.bev_components(df.where("x_mm IS NOT NULL AND y_mm IS NOT NULL")).count() <= n
        assert ground.candidates(df.withColumn("h", F.lit(20)), "h").count() == n and cluster.geometric(df.where("z_mm IS NOT NULL")).count() == 0
        assert raster.inpainted(raster.cell_table(cells.evaluate(cells.leaves(df)))).count() == 0
    floats = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert pt.finite(floats, "x").count() == 1
    metres = spark.createDataFrame([(0, 0, 1.2345, -2.0, 0.0005, None), (0, 1, float("nan"), 0.0, 0.0, 1.0)], "frame_id bigint, point_idx bigint, x double, y double, z double, intensity double")
    assert [tuple(r) for r in pt.to_millimetres(metres).collect()] == [(0, 0, 1234, -2000, 0, 50)]


def test_track_starts_and_blends():
    first = lambda **v: track.step([], 0, [{"x": 0.0, "y": 0.0, "length": 1.0, "width": 1.0, "height": 1.0, "kind": "vehicle", **v}], 0.1)[0][0]
    assert first().pvx == first(vx=0.0, vy=0.0).pvx == 2.0 and first(vx=1.0, vy=0.0).pvx == 1.0
    t = first()
    both, one = track.updated(t, 0.0, 0.0, (2.0, 3.0)), track.updated(t, 0.0, 0.0, (2.0, None))
    assert math.isclose(both.vx, 0.6) and math.isclose(both.vy, 0.9) and math.isclose(one.vx, 0.6) and one.vy == 0 == track.updated(t, 0.0, 0.0, (math.nan, math.nan)).vx


def test_moving_and_boxes(spark):
    t = spark.createDataFrame([(0, 0.1, 0.1), (1, 0.2, 0.0)], "track_id int, vx double, vy double")
    assert [r.track_id for r in pt.moving(t).collect()] == [1]
    anchor = spark.createDataFrame([(1.0, 2.0, 0.0, 4.0, 3.0, 1.5, 0.0, 0.1, -0.2, 0.5, 0.0, math.log(2), 0.0, 1.0, 0.0)], ", ".join(f"{c} double" for c in "ax ay az al aw ah ayaw dx dy dz dl dw dh dsin dcos".split()))
    b = cluster.decode_boxes(anchor).first()
    assert np.allclose([b.x, b.y, b.z, b.length, b.width, b.height, b.yaw], [1.5, 1.0, 0.75, 4.0, 6.0, 1.5, math.pi / 4])
    memory = spark.createDataFrame([(0, k, k, 0) for k in range(5)], "sensor_id int, first int, kx int, ky int")
    assert {r.first for r in tm.retained(memory, 3).collect()} == {2, 3, 4}


def test_slots_and_their_model(spark):
    p = spark.createDataFrame([(0, k, 0, 0, -1600, 10 + k % 3) for k in range(133)], POINT).withColumn("h", F.lit(20))
    chosen = ground.candidates(p, "h")
    assert chosen.count() == 120 and chosen.where("slot IS NULL").count() == 0 and chosen.agg(F.max("slot")).first()[0] == 23
    seen = []
    ready = models.Registry().add("m", lambda x: (seen.append(x.shape), np.where(x[:, 1] > 0.115, 3.0, -3.0))[1])
    rows = ground.slot_threats(chosen, ready, "h").collect()
    assert len(rows) == 120 and {round(r.p, 3) for r in rows} == {round(1 / (1 + math.exp(-3)), 3)}
    gone = ground.slot_threats(chosen, models.Registry().get("m"), "h").collect()
    assert len(gone) == 120 and all(r.p is None for r in gone)


def test_side_tables(spark, tmp_path):
    assert settings.detector(spark) == settings.Detector() and settings.Detector().grid == (512, 512, 1)
    (tmp_path / "d.yaml").write_text(json.dumps({"CLASS_NAMES": ["a", "b"], "DATA_CONFIG": {"POINT_CLOUD_RANGE": [0, 0, 0, 10, 20, 4], "DATA_PROCESSOR": [{"NAME": "x"}, {"VOXEL_SIZE": [0.5, 1, 4]}]}}))
    got = settings.detector(spark, str(tmp_path / "d.yaml"))
    assert got.grid == (20, 20, 1) and got.classes == ("a", "b")
    (tmp_path / "c.json").write_text('{"0": "ground", "-1": "none", "note": "x"}')
    (tmp_path / "bad.json").write_text("{")
    assert {(r.label, r.name) for r in settings.class_map(spark, str(tmp_path / "c.json")).collect()} == {(0, "ground"), (-1, "none")}
    assert settings.settings(spark, str(tmp_path / "bad.json"), 7) == 7 and settings.threshold(spark, str(tmp_path / "nowhere.json")) == 0.75
    (tmp_path / "t.json").write_text('{"threshold": 0.6}')
    assert settings.threshold(spark, str(tmp_path / "t.json")) == 0.6


def test_folders(spark, tmp_path):
    assert velodyne.resolved(spark, str(tmp_path)) is None
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "1.bin").write_bytes(b"")
    assert velodyne.resolved(spark, str(tmp_path)) == str(tmp_path)
    (tmp_path / "dynamic").mkdir()
    (tmp_path / "dynamic" / "1.bin").write_bytes(b"")
    assert velodyne.resolved(spark, str(tmp_path), "dynamic") == f"{tmp_path}/dynamic"


def test_logs_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 7, "vehicle", 1.0, 2.0, 3.0, 4.0)], "timestamp double, track_id bigint, object_class string, pos_x double, pos_y double, vel_x double, vel_y double")
    write = stateful.append_logs(str(tmp_path), "dynamic_tracks_history")
    for number in (0, 1, 1):
        write(rows, number)
    got = spark.read.parquet(str(tmp_path / "dynamic_tracks_history")).collect()
    assert len(got) == 2 and {r.speed for r in got} == {5.0} and {r.batch for r in got} == {0, 1}
    assert [f.name for f in tm.log_rows(rows, "system_health").schema] == [c.split()[0] for c in tm.HEALTH.split(", ")]
    tm.export_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "csv"))
    lines = {x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().splitlines()}
    assert lines == {"a,b", "1,"}


def test_live_sweeps_and_windows(spark):
    q = stateful.live(spark, 50).writeStream.format("memory").queryName("live").start()
    try:
        import time

        until = time.time() + 60
        while time.time() < until and not spark.table("live").limit(1).count():
            time.sleep(1)
    finally:
        q.stop()
    sizes = spark.table("live").groupBy("frame_id").agg(F.count("*").alias("n"), F.min("x_mm").alias("x")).collect()
    assert sizes and all(r.n == 8600 for r in sizes)
    events = spark.createDataFrame([(0, 1.0, "a"), (7, 3.0, "a")], "s int, value double, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    assert stateful.rates(events, slide="5 seconds").agg(F.sum("n")).first()[0] == 4 and stateful.rates(events).agg(F.sum("n")).first()[0] == 2
    assert stateful.sessions(events, "event_type").count() == 2


def test_more_commands():
    p = stateful.Playback(10)
    assert p.handle('{"action": "switch_dataset", "mode": "Dynamic"}')["dataset"] == "dynamic"
    assert p.handle('{"type": "playback_next"}')["frame"] == 1 and p.handle('{"action": "set_speed", "value": 0.01}')["speed"] == 0.1
    assert p.handle('{"action": "pong"}') == {"type": "pong"} and p.handle('{"command": "seek"}')["frame"] == 0
    assert p.handle("[]")["type"] == "error" and p.handle('{"action": "set_dataset", "mode": "x"}')["type"] == "error"


def test_numbers_of_files(spark):
    names = [f"f{k:03d}.bin" for k in np.random.default_rng(2).permutation(300)]
    rows = spark.createDataFrame([(n, k) for n in names for k in range(2)], "path string, point_idx int")
    got = {r.path: r.frame_id for r in velodyne.numbered(rows).select("path", "frame_id").distinct().collect()}
    assert got == {n: k for k, n in enumerate(sorted(names))}


def test_dust_by_size(spark):
    few = spark.createDataFrame([(0, k, 100 * (k % 20), 100 * (k // 20), -1600, 10) for k in range(200)] + [(0, 999, 40_000, 0, 2000, 10)], POINT)
    kept = pt.dust(few)
    assert kept.where("point_idx = 999").count() == 0 and kept.count() >= 190


def test_pillar_features(spark):
    own = cluster.pillars(points(spark, DIR).limit(400))
    ready = models.Registry().add("pfn", lambda x: np.maximum(x @ np.eye(11)[:, :3], 0))
    got = {(r.frame_id, r.px, r.py): r.features for r in cluster.pillar_features(own, ready).collect()}
    want = own.toPandas().groupby(["frame_id", "px", "py"])[["x_mm", "y_mm", "z_mm"]].max().clip(lower=0)
    assert {k: tuple(v) for k, v in got.items()} == {k: tuple(map(float, v)) for k, v in zip(want.index, want.to_numpy(), strict=True)}
    assert all(r.features is None for r in cluster.pillar_features(own, models.Registry().get("pfn")).collect())


def test_cursor(spark):
    p = velodyne.numbered(spark.createDataFrame([(f"{k}.bin", k) for k in range(3)], "path string, point_idx int"))
    at = lambda n, **how: [r.frame_id for r in velodyne.frame(p, n, 3, **how).collect()]
    assert (at(1), at(5), at(-1), at(5, loop=False), at(-1, loop=False)) == ([1], [2], [2], [2], [0])
