"""Tracking, terrain memory and joins as streams: against plain loops, over restarts, with late rows and state that ends."""

import math
import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import health, track
from gridloom.operators.assignment import assign
from gridloom.streaming import stateful

DETECTION = "sensor_id bigint, frame_id bigint, det_id int, x double, y double, vx double, vy double, length double, width double, height double, kind string"
KEY = ["sensor_id", "frame_id", "track_id"]


def plain_step(tracks, next_id, seen, dt):
    """One frame of one sensor with dictionaries, track by track."""
    for t in tracks:
        for a in "xy":
            t[a] += t["v" + a] * dt
            t["p" + a] += t["pv" + a] * dt * dt + 0.05
            t["pv" + a] += 0.2
        t["age"] += 1
        t["misses"] += 1
    free = set(range(len(seen)))
    if tracks and seen:
        cost = np.array([[math.hypot(t["x"] - d["x"], t["y"] - d["y"]) for d in seen] for t in tracks])
        for i, j in assign(cost):
            if cost[i, j] > 1.8:
                continue
            t, d = tracks[i], seen[j]
            free.discard(j)
            off = {a: d[a] - t[a] for a in "xy"}
            gain = {a: t["p" + a] / (t["p" + a] + 0.08) for a in "xy"}
            pull = {a: t["pv" + a] * t["dt"] / (t["p" + a] + 0.08) for a in "xy"}
            if math.hypot(*off.values()) < 0.08:
                damp = 0.8 if math.hypot(t["vx"], t["vy"]) < 0.25 else 1.0
                v = {a: t["v" + a] * damp for a in "xy"}
            else:
                v = {a: t["v" + a] + pull[a] * off[a] for a in "xy"}
            if math.hypot(*v.values()) < 0.12:
                v = {"x": 0.0, "y": 0.0}
            for a in "xy":
                if d["v" + a] is not None:
                    v[a] = 0.7 * v[a] + 0.3 * d["v" + a]
                t["v" + a] = v[a]
                t[a] += gain[a] * off[a]
                t["p" + a] *= 1 - gain[a]
                t["pv" + a] = max(0.05, t["pv" + a] * max(0.1, 1 - pull[a] * t["dt"]))
            t.update(hits=t["hits"] + 1, misses=0, kind=d["kind"])
    tracks = [t for t in tracks if t["misses"] <= 5 and t["px"] + t["py"] + t["pvx"] + t["pvy"] < 10]
    for j in sorted(free):
        if len(tracks) < 40:
            d = seen[j]
            v = {a: d["v" + a] or 0.0 for a in "xy"}
            pv = 1.0 if any(v.values()) else 2.0
            tracks.append({"id": next_id, "x": d["x"], "y": d["y"], "vx": v["x"], "vy": v["y"], "px": 0.5, "py": 0.5, "pvx": pv, "pvy": pv, "dt": dt, "hits": 1, "age": 1, "misses": 0, "kind": d["kind"]})
            next_id += 1
    return tracks, next_id


def plain(rows, dt=0.1):
    out = {}
    for sensor in sorted({r[0] for r in rows}):
        tracks, next_id = [], 0
        for frame in sorted({r[1] for r in rows if r[0] == sensor}):
            own = sorted((r for r in rows if r[:2] == (sensor, frame) and r[3] is not None), key=lambda r: r[2])
            tracks, next_id = plain_step(tracks, next_id, [dict(zip(("x", "y", "vx", "vy", "kind"), (*r[3:7], r[10]), strict=True)) for r in own], dt)
            out |= {(sensor, frame, t["id"]): (t["x"], t["y"], t["vx"], t["vy"], t["px"], (t["pvx"] + t["pvy"]) / 2, t["hits"], t["age"], t["misses"], t["kind"]) for t in tracks if t["hits"] >= 3}
    return out


def some_rows(seed, sensors=3, frames=60):
    rng = random.Random(seed)
    rows = []
    for s in range(sensors):
        things = [[rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(-2, 2), rng.uniform(-2, 2)] for _ in range(rng.choice([3, 12, 55]))]
        for f in range(frames):
            here = []
            for t in things:
                t[0], t[1] = t[0] + 0.1 * t[2], t[1] + 0.1 * t[3]
                if rng.random() < 0.75 and not 20 <= f < 27:
                    known = rng.random() < 0.3
                    here.append((t[0] + rng.gauss(0, 0.1), t[1] + rng.gauss(0, 0.1), t[2] if known else None, t[3] if known and rng.random() < 0.8 else None))
            rng.shuffle(here)
            rows += [(s, f, k, *h, 4.0 + k, 1.8, 1.5, rng.choice(["vehicle", "obstacle"])) for k, h in enumerate(here)] or [(s, f, 0, *[None] * 8)]
    return rows


def compared(got, want):
    found = {(r.sensor_id, r.frame_id, r.track_id): (r.x, r.y, r.vx, r.vy, r.px, r.pv, r.hits, r.age, r.misses, r.kind) for r in got}
    assert len(got) == len(found) and found.keys() == want.keys()
    for k, v in want.items():
        assert found[k][6:] == v[6:] and np.allclose(found[k][:6], v[:6], rtol=1e-9, atol=1e-9), k


@pytest.mark.parametrize("seed", range(3))
def test_tracks_are_those_of_a_plain_loop(spark, seed):
    """In one batch, and in Arrow batches of a few rows, whose borders fall inside frames."""
    rows = some_rows(seed)
    want = plain(rows)
    df = spark.createDataFrame(rows, DETECTION)
    compared(track.track(df).collect(), want)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        compared(track.track(df.repartition(3)).collect(), want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_no_frames_no_tracks(spark):
    assert track.track(spark.createDataFrame([], DETECTION)).count() == 0


def run_once(df, tmp_path, name):
    """One run of a query to its end, and its progress."""
    q = df.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return q


def test_tracking_goes_on_after_restarts(spark, tmp_path):
    """Each part is a query of its own from the same checkpoint; a frame that comes again is late; state is bounded."""
    rows = some_rows(5, sensors=2)
    folder = str(tmp_path / "in")
    for k, (a, b) in enumerate(((0, 17), (17, 40), (30, 60))):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], DETECTION).coalesce(1).write.mode("append").parquet(folder)
        q = run_once(stateful.tracks(spark.readStream.schema(DETECTION).parquet(folder)), tmp_path, "t")
        assert stateful.held(q) <= 2 * (track.MOST + 1), k
    compared(spark.read.parquet(str(tmp_path / "t-out")).collect(), plain(rows))


def test_a_silent_sensor_is_forgotten(spark, tmp_path):
    folder = str(tmp_path / "in")
    seen = []
    for sensor, frames, minute in ((0, range(0, 5), 0), (1, range(0, 5), 1), (1, range(5, 8), 30), (1, range(8, 9), 31), (0, range(9, 14), 32)):
        rows = [(sensor, f, 0, 1.0, 1.0, None, None, 4.0, 2.0, 1.5, "vehicle") for f in frames]
        own = spark.createDataFrame(rows, DETECTION).withColumn("ts", F.expr(f"timestamp'2024-01-01 00:00:00' + INTERVAL {minute} MINUTE"))
        own.coalesce(1).write.mode("append").parquet(folder)
        q = run_once(stateful.tracks(spark.readStream.schema(f"{DETECTION}, ts timestamp").parquet(folder), time="ts", idle_ms=600_000), tmp_path, "s")
        seen.append(stateful.held(q))
    got = spark.read.parquet(str(tmp_path / "s-out")).where("sensor_id = 0").collect()
    # after the silence a track begins anew, with the first number
    assert {r.track_id for r in got} == {0} and {(r.frame_id, r.hits) for r in got} == {(2, 3), (3, 4), (4, 5), (11, 3), (12, 4), (13, 5)}
    assert seen[3] < seen[1]


class Remembered:
    """Terrain memory with an ordered dictionary."""

    def __init__(self, most, slack):
        self.most, self.slack, self.own, self.last = most, slack, OrderedDict(), None

    def frame(self, number, cells):
        out = []
        if self.last is not None and number <= self.last:
            return out
        self.last = number
        for x, y, z in cells:
            if (x, y) not in self.own:
                self.own[x, y] = [z, 0.005, 1]
            else:
                c = self.own[x, y]
                k = c[1] / (c[1] + 0.0025)
                self.own[x, y] = [c[0] + k * (z - c[0]), (1 - k) * c[1] + 0.002, c[2] + 1]
            out.append((number, x, y, *self.own[x, y]))
        if len(self.own) > self.most:
            for k in list(self.own)[: len(self.own) - self.most + self.slack]:
                del self.own[k]
        return out


def test_terrain_memory_is_bounded_and_in_order(spark, tmp_path):
    rng = random.Random(4)
    schema = "sensor_id bigint, frame_id bigint, nth bigint, kx bigint, ky bigint, z double"
    frames = {(s, f): [(rng.randrange(-40, 40) + f // 3 * 9, rng.randrange(-6, 6), rng.uniform(-2, 1)) for _ in range(80)] for s in (0, 1) for f in range(24)}
    frames[1, 23] = frames[1, 23] * 2  # the same cells again in a frame
    folder, want = str(tmp_path / "in"), set()
    for s in (0, 1):
        own = Remembered(600, 50)
        for f in range(24):
            want |= {(s, *r) for r in own.frame(f, frames[s, f])}
    for a, b in ((0, 5), (5, 6), (4, 15), (15, 24)):  # frame 4 and 5 come again
        rows = [(s, f, k, *c) for (s, f), cells in frames.items() if a <= f < b for k, c in enumerate(cells)]
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        q = run_once(stateful.terrain(spark.readStream.schema(schema).parquet(folder), most=600, slack=50), tmp_path, "m")
        entries = stateful.held(q)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "m-out")).collect()]
    assert set(got) == want and any(r[6] == 1 for r in want if r[1] > 12) and entries <= 2 * (600 + 600 // 512 + 2 + 1)


def test_terrain_blend_is_the_fold(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for cell in range(12):
        own, n = None, rng.choice([1, 2, 3, 70, 400])
        for f in range(n):
            z = rng.uniform(-2, 1)
            rows.append((cell % 2, cell, -cell, f * 3, z))
            own = (z, 0.005) if own is None else (own[0] + own[1] / (own[1] + 0.0025) * (z - own[0]), (1 - own[1] / (own[1] + 0.0025)) * own[1] + 0.002)
        want[cell % 2, cell, -cell] = (n, *own)
    rng.shuffle(rows)
    got = health.terrain_blend(spark.createDataFrame(rows, "sensor_id bigint, kx bigint, ky bigint, frame_id bigint, z double")).collect()
    assert len(got) == len(want)
    for r in got:
        n, z, p = want[r.sensor_id, r.kx, r.ky]
        assert r.n == n and abs(r.z - z) < 1e-12 and abs(r.p - p) < 1e-15


def test_detections_meet_their_latest_pose(spark, tmp_path):
    """Late detections are dropped and counted, poses age out, and the rows are those of a loop over all pairs in time."""
    at = lambda ms: F.timestamp_millis(F.lit(1_704_067_200_000) + ms)
    dets, poses = str(tmp_path / "d"), str(tmp_path / "p")
    det = lambda rows: spark.createDataFrame(rows, "sensor_id bigint, frame_id bigint, det_id int, x double, y double, ms bigint").withColumn("ts", at(F.col("ms")))
    pose = lambda rows: spark.createDataFrame(rows, "sensor_id bigint, x double, y double, yaw double, ms bigint").withColumn("ts", at(F.col("ms")))
    d = [(s, f, k, 1.0 + k, 2.0, f * 100 + 30) for s in (0, 1) for f in range(100) for k in range(2)]
    p = [(s, ms * 0.01, 5.0, ms / 10_000, ms) for s in (0, 1) for ms in range(0, 10_000, 70) if not (s == 1 and 4000 < ms < 5000)]
    late = [(0, 500, 0, 0.0, 0.0, 150), (1, 501, 0, 0.0, 0.0, 160)]
    batches = ([r for r in d if r[5] < 5000], [r for r in p if r[4] < 5000]), ([r for r in d if r[5] >= 5000], [r for r in p if r[4] >= 5000]), (late, []), ([(0, 900, 0, 0.0, 0.0, 60_000)], [(0, 0.0, 0.0, 0.0, 60_000)]), ([(0, 901, 0, 0.0, 0.0, 120_000)], [(0, 0.0, 0.0, 0.0, 120_000)])
    lost = kept = 0
    for one, two in batches:
        det(one).coalesce(1).write.mode("append").parquet(dets)
        pose(two).coalesce(1).write.mode("append").parquet(poses)
        joined = stateful.posed(spark.readStream.schema(det([]).schema).parquet(dets), spark.readStream.schema(pose([]).schema).parquet(poses))
        q = run_once(joined, tmp_path, "j")
        lost, kept = lost + stateful.dropped(q), max(kept, stateful.held(q))
    got = {(r.sensor_id, r.frame_id, r.det_id): (r.world_x, r.world_y, r.age_ms) for r in spark.read.parquet(str(tmp_path / "j-out")).collect()}
    want = {}
    for s, f, k, x, y, ms in d:
        near = [q for q in p if q[0] == s and ms - 200 <= q[4] <= ms]
        if near:
            _, px, py, yaw, t = max(near, key=lambda q: q[4])
            want[s, f, k] = (px + math.cos(yaw) * x - math.sin(yaw) * y, py + math.sin(yaw) * x + math.cos(yaw) * y, ms - t)
    own = {k: v for k, v in got.items() if k[1] < 500}
    assert lost == 2 and not {k for k in got if k[1] in (500, 501)} and own.keys() == want.keys()
    assert all(np.allclose(own[k], want[k]) for k in want) and any(s == 1 and 42 <= f < 50 for s, f, _ in {r[:3] for r in d} - want.keys())
    # what has aged out is gone: the state after the last batch is that batch's and what is within reach of the watermark
    assert stateful.held(q) < 40
    batch = stateful.posed(det(d), pose(p)).collect()
    assert {(r.sensor_id, r.frame_id, r.det_id) for r in batch} == want.keys()
