"""Multi-object tracking: constant-velocity filters, assignment, coasting. One set of array steps serves batch and stream.

A sensor's tracks are a matrix with a row for each. The batch form deals sensors to tasks, sorts detections by frame and passes
over them once, a bounded Arrow batch at a time, with the tracks carried from batch to batch: a task takes its sensors' next
frames in one step, as a step costs more than a sensor does. It holds a batch, a frame and the last tracks of its sensors,
however long their lives are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.assignment import assign, assign_all

#: Fixed values of the filter: measurement noise, damping, standstill, gate of the innovation, gate of a match, coasting.
R, DAMP, STILL, QUIET, GATE, COAST, MOST = 0.08, 0.8, 0.12, 0.08, 1.8, 5, 40
SCHEMA = "sensor_id bigint, frame_id bigint, track_id bigint, x double, y double, vx double, vy double, px double, pv double, hits int, age int, misses int, length double, width double, height double, kind string"
#: Columns of the matrices of a set of tracks.
X, Y, VX, VY, PX, PY, PVX, PVY, DT, LENGTH, WIDTH, HEIGHT = range(12)
ID, HITS, AGE, MISSES = range(4)


@dataclass(frozen=True)
class Track:
    """Position and velocity with their variances, and what the last detection looked like."""

    track_id: int
    x: float
    y: float
    vx: float
    vy: float
    px: float
    py: float
    pvx: float
    pvy: float
    dt: float
    hits: int = 1
    age: int = 1
    misses: int = 0
    length: float = 0.0
    width: float = 0.0
    height: float = 0.0
    kind: str = "obstacle"


@dataclass
class Tracks:
    """Tracks as rows: state (floats, X to HEIGHT), counts (ID to MISSES) and kinds."""

    state: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray

    @classmethod
    def none(cls) -> Tracks:
        return cls(np.zeros((0, 12)), np.zeros((0, 4), np.int64), np.zeros(0, object))

    @classmethod
    def of(cls, tracks: list[Track]) -> Tracks:
        if not tracks:
            return cls.none()
        rows = [astuple(t) for t in tracks]
        return cls(np.array([r[1:10] + r[13:16] for r in rows], float), np.array([(r[0], *r[10:13]) for r in rows], np.int64), np.array([r[16] for r in rows], object))

    def single(self) -> list[Track]:
        rows = zip(self.state.tolist(), self.counts.tolist(), self.kinds.tolist(), strict=True)
        return [Track(c[ID], *s[:9], *c[1:], *s[9:], k) for s, c, k in rows]

    def take(self, which: np.ndarray) -> Tracks:
        return Tracks(self.state[which], self.counts[which], self.kinds[which])


def predict(state: np.ndarray, dt: float) -> np.ndarray:
    """States moved on by dt, less certain."""
    out = state.copy()
    out[:, X : Y + 1] += state[:, VX : VY + 1] * dt
    out[:, PX : PY + 1] += state[:, PVX : PVY + 1] * dt * dt + 0.05
    out[:, PVX : PVY + 1] += 0.20
    return out


def correct(state: np.ndarray, z: np.ndarray, measured: np.ndarray) -> np.ndarray:
    """States corrected by one position each; small innovations damp slow motion instead of feeding it. A measured velocity
    counts by axis, unless it is not finite."""
    out = state.copy()
    off, p, pv, dt = z - state[:, X : Y + 1], state[:, PX : PY + 1], state[:, PVX : PVY + 1], state[:, DT : DT + 1]
    gain, pull = p / (p + R), pv * dt / (p + R)
    v = state[:, VX : VY + 1]
    slow = np.where(np.hypot(v[:, :1], v[:, 1:]) < 0.25, v * DAMP, v)
    v = np.where(np.hypot(off[:, :1], off[:, 1:]) < QUIET, slow, v + pull * off)
    v = np.where(np.hypot(v[:, :1], v[:, 1:]) < STILL, 0.0, v)
    out[:, VX : VY + 1] = np.where(np.isfinite(measured), 0.7 * v + 0.3 * np.nan_to_num(measured), v)
    out[:, X : Y + 1] += gain * off
    out[:, PX : PY + 1] = p * (1 - gain)
    out[:, PVX : PVY + 1] = np.maximum(0.05, pv * np.maximum(0.1, 1 - pull * dt))
    return out


def advance(tracks: Tracks, next_id: int, seen: np.ndarray, kinds: np.ndarray, dt: float) -> tuple[Tracks, int]:
    """One frame: predict all, assign without a gate, drop pairs beyond it, update, prune, spawn in order up to MOST.

    seen: x, y, vx, vy, length, width, height of each detection, velocities not finite where they are unknown.
    """
    state, counts, names = predict(tracks.state, dt), tracks.counts.copy(), tracks.kinds
    counts[:, AGE : MISSES + 1] += 1
    free = np.ones(len(seen), bool)
    if len(state) and len(seen):
        cost = np.hypot(state[:, X : X + 1] - seen[:, 0], state[:, Y : Y + 1] - seen[:, 1])
        pairs = np.array(assign(cost), int)
        pairs = pairs[cost[pairs[:, 0], pairs[:, 1]] <= GATE]
        if len(pairs):
            i, j = pairs.T
            new = correct(state[i], seen[j, :2], seen[j, 2:4])
            new[:, LENGTH : HEIGHT + 1] = seen[j, 4:]
            state[i] = new
            counts[i, HITS] += 1
            counts[i, MISSES] = 0
            names = names.copy()
            names[i] = kinds[j]
            free[j] = False
    alive = (counts[:, MISSES] <= COAST) & (state[:, PX] + state[:, PY] + state[:, PVX] + state[:, PVY] < 10)
    if not alive.all():
        state, counts, names = state[alive], counts[alive], names[alive]
    born = np.flatnonzero(free)[: max(0, MOST - len(state))]
    if len(born):
        n = len(born)
        v = seen[born, 2:4]
        v = np.where(np.isfinite(v), v, 0.0)
        fresh = np.empty((n, 12))
        fresh[:, X : Y + 1], fresh[:, VX : VY + 1], fresh[:, PX : PY + 1], fresh[:, DT] = seen[born, :2], v, 0.5, dt
        fresh[:, PVX : PVY + 1] = np.where(v.any(axis=1), 1.0, 2.0)[:, None]  # a velocity of 0 is as uncertain as none
        fresh[:, LENGTH : HEIGHT + 1] = seen[born, 4:]
        first = np.tile(np.array([0, 1, 1, 0]), (n, 1))
        first[:, ID] = np.arange(next_id, next_id + n)
        state, counts, names = np.concatenate([state, fresh]), np.concatenate([counts, first]), np.concatenate([names, kinds[born]])
        next_id += n
    return Tracks(state, counts, names), next_id


def updated(t: Track, zx: float, zy: float, velocity: tuple[float | None, float | None] | None = None) -> Track:
    """One track corrected by a measurement."""
    own = Tracks.of([t])
    v = [math.nan if c is None else c for c in velocity or (None, None)]
    return Tracks(correct(own.state, np.array([[zx, zy]], float), np.array([v], float)), own.counts, own.kinds).single()[0]


def step(tracks: list[Track], next_id: int, detections: list[dict], dt: float) -> tuple[list[Track], int]:
    """advance() of a list of tracks by a list of detections."""
    value = lambda d, c: math.nan if (v := d.get(c)) is None else v
    seen = np.array([[value(d, c) for c in ("x", "y", "vx", "vy", "length", "width", "height")] for d in detections], float).reshape(-1, 7)
    out, next_id = advance(Tracks.of(tracks), next_id, seen, np.array([d["kind"] for d in detections], object), dt)
    return out.single(), next_id


class Follower:
    """Frames of one sensor after another to reported tracks. Frames not after the last one are late and dropped."""

    def __init__(self, dt: float, tracks: Tracks | None = None, next_id: int = 0, last: int | None = None):
        self.dt, self.tracks, self.next_id, self.last = dt, tracks or Tracks.none(), next_id, last
        self.out: list[tuple[int, int, Tracks]] = []

    def frame(self, sensor: int, frame: int, seen: np.ndarray, kinds: np.ndarray) -> None:
        if self.last is not None and frame <= self.last:
            return
        real = ~np.isnan(seen[:, 0])  # a row with a null x stands for an empty frame
        self.tracks, self.next_id = advance(self.tracks, self.next_id, seen[real], kinds[real], self.dt)
        self.last = frame
        sure = self.tracks.counts[:, HITS] >= 3  # confirmed
        if sure.any():
            self.out.append((sensor, frame, self.tracks if sure.all() else self.tracks.take(sure)))

    def reported(self) -> pa.RecordBatch:
        """What is reported of confirmed tracks since the last call."""
        out, self.out = self.out, []
        sizes = [len(t.counts) for _, _, t in out]
        of = lambda k: np.repeat(np.array([o[k] for o in out], np.int64), sizes)
        every = Tracks(*(np.concatenate([getattr(t, a) for _, _, t in out]) if out else getattr(Tracks.none(), a) for a in ("state", "counts", "kinds")))
        return _rows(of(0), of(1), every)


def _rows(sensor: np.ndarray, frame: np.ndarray, tracks: Tracks) -> pa.RecordBatch:
    s, c = tracks.state, tracks.counts
    columns = [sensor, frame, c[:, ID], s[:, X], s[:, Y], s[:, VX], s[:, VY], s[:, PX], (s[:, PVX] + s[:, PVY]) / 2, *(c[:, k].astype(np.int32) for k in (HITS, AGE, MISSES)), s[:, LENGTH], s[:, WIDTH], s[:, HEIGHT]]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(tracks.kinds.tolist(), pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])


def _wider(a: np.ndarray, *shape: int) -> np.ndarray:
    """a with room for more rows and columns."""
    out = np.zeros((*shape, *a.shape[2:]), a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


class Fleet:
    """advance() of many sensors at once: a row of tracks for each sensor, of which the first n are there. Frames come in order."""

    def __init__(self, dt: float):
        self.dt = dt
        self.rows: dict[int, int] = {}
        self.state, self.counts, self.kinds = np.zeros((16, 4, 12)), np.zeros((16, 4, 4), np.int64), np.zeros((16, 4), object)
        self.n, self.next_id = np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.out: list[tuple[np.ndarray, int, Tracks]] = []

    def _room(self, rows: int, width: int) -> None:
        """Makes room, twice as much as there was, if it is needed."""
        have = self.kinds.shape
        if rows > have[0] or width > have[1]:
            shape = [h if need <= h else max(need, 2 * h) for h, need in zip(have, (rows, width), strict=True)]
            self.state, self.counts, self.kinds = (_wider(a, *shape) for a in (self.state, self.counts, self.kinds))
            self.n, self.next_id = (np.pad(a, (0, shape[0] - len(a))) for a in (self.n, self.next_id))

    def frame(self, frame: int, sensor: np.ndarray, seen: np.ndarray, kinds: np.ndarray) -> None:
        """One frame of the sensors that have one; their rows stand together, in order."""
        first = np.flatnonzero(np.diff(sensor, prepend=sensor[0] - 1))
        own = sensor[first]
        at = np.array([self.rows.setdefault(v, len(self.rows)) for v in own.tolist()])
        self._room(len(self.rows), 1)
        real = ~np.isnan(seen[:, 0])  # a row with a null x stands for an empty frame
        of = np.repeat(np.arange(len(own)), np.diff(first, append=len(sensor)))[real]
        m = np.bincount(of, minlength=len(own))
        n = self.n[at]
        width, most = int(n.max()), int(m.max())
        z, names, there = np.full((len(own), most, 7), np.nan), np.zeros((len(own), most), object), np.arange(most) < m[:, None]
        z[there], names[there] = seen[real], kinds[real]

        state = predict(self.state[at, :width].reshape(-1, 12), self.dt).reshape(len(own), width, 12)
        counts, called, free = self.counts[at, :width], self.kinds[at, :width], there.copy()
        counts[:, :, AGE : MISSES + 1] += 1
        for a, b in {*zip(n.tolist(), m.tolist(), strict=True)}:
            if a and b:
                k = np.flatnonzero((n == a) & (m == b))
                cost = np.hypot(state[k, :a, None, X] - z[k, None, :b, 0], state[k, :a, None, Y] - z[k, None, :b, 1])
                g, i, j = assign_all(cost)
                near = cost[g, i, j] <= GATE
                g, i, j = k[g[near]], i[near], j[near]
                new = correct(state[g, i], z[g, j, :2], z[g, j, 2:4])
                new[:, LENGTH : HEIGHT + 1] = z[g, j, 4:]
                state[g, i], called[g, i], free[g, j] = new, names[g, j], False
                counts[g, i, HITS] += 1
                counts[g, i, MISSES] = 0
        alive = (np.arange(width) < n[:, None]) & (counts[:, :, MISSES] <= COAST) & (state[:, :, PX] + state[:, :, PY] + state[:, :, PVX] + state[:, :, PVY] < 10)
        left = alive.sum(1)
        fewer = np.flatnonzero(left < n)
        if len(fewer):
            order = np.argsort(~alive[fewer], axis=1, kind="stable")
            state[fewer], counts[fewer], called[fewer] = (a[fewer[:, None], order] for a in (state, counts, called))
        nth = np.cumsum(free, axis=1) - 1
        i, j = np.nonzero(free & (nth < MOST - left[:, None]))
        if len(i):
            place = left[i] + nth[i, j]
            wide = max(width, int(place.max()) + 1)
            self._room(1, wide)
            state, counts, called = (_wider(a, len(own), wide) for a in (state, counts, called))
            v = z[i, j, 2:4]
            v = np.where(np.isfinite(v), v, 0.0)
            fresh = np.empty((len(i), 12))
            fresh[:, X : Y + 1], fresh[:, VX : VY + 1], fresh[:, PX : PY + 1], fresh[:, DT] = z[i, j, :2], v, 0.5, self.dt
            fresh[:, PVX : PVY + 1] = np.where(v.any(axis=1), 1.0, 2.0)[:, None]  # a velocity of 0 is as uncertain as none
            fresh[:, LENGTH : HEIGHT + 1] = z[i, j, 4:]
            state[i, place], called[i, place], counts[i, place] = fresh, names[i, j], [0, 1, 1, 0]
            counts[i, place, ID] = self.next_id[at[i]] + nth[i, j]
            born = np.bincount(i, minlength=len(own))
            left = left + born
            self.next_id[at] += born
            width = wide
        self.state[at, :width], self.counts[at, :width], self.kinds[at, :width], self.n[at] = state, counts, called, left
        sure = (np.arange(width) < left[:, None]) & (counts[:, :, HITS] >= 3)  # confirmed
        if sure.any():
            self.out.append((own[np.nonzero(sure)[0]], frame, Tracks(state[sure], counts[sure], called[sure])))

    def reported(self) -> Iterator[pa.RecordBatch]:
        """What is reported of confirmed tracks since the last call."""
        out, self.out = self.out, []
        if out:
            every = Tracks(*(np.concatenate([getattr(t, a) for _, _, t in out]) for a in ("state", "counts", "kinds")))
            yield _rows(np.concatenate([v for v, _, _ in out]), np.repeat([f for _, f, _ in out], [len(v) for v, _, _ in out]), every)


#: Columns that a follower reads, velocities being optional.
SEEN = ("x", "y", "vx", "vy", "length", "width", "height")


def narrowed(detections: DataFrame, *more: str) -> DataFrame:
    """sensor_id, frame_id, det_id, kind, SEEN (unknown velocities null) and more columns."""
    v = [(F.col(c) if c in detections.columns else F.lit(None)).cast("double").alias(c) for c in SEEN]
    return detections.select(F.col("sensor_id").cast("bigint").alias("sensor_id"), F.col("frame_id").cast("bigint").alias("frame_id"), "det_id", "kind", *v, *more)


def _follow(dt: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, held = Fleet(dt), None, []

        def flush() -> None:
            if held:
                own.frame(now, *(np.concatenate(v) for v in zip(*held, strict=True)))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            sensor, frame = (batch.column(k).to_numpy() for k in (0, 1))
            kinds = batch.column(3).to_numpy(zero_copy_only=False)
            seen = np.stack([batch.column(4 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(SEEN))], axis=1)
            cuts = np.flatnonzero(frame[1:] != frame[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sensor)], strict=True):
                if frame[a] != now:
                    flush()
                    now = int(frame[a])
                held.append((sensor[a:b], seen[a:b], kinds[a:b]))  # the last frame goes on in the next batch, perhaps
            yield from own.reported()
        flush()
        yield from own.reported()

    return run


def track(detections: DataFrame, dt: float = 0.1) -> DataFrame:
    """Tracks of each sensor's detections (sensor_id, frame_id, det_id, x, y, length, width, height, kind[, vx, vy]).

    A row with a null x stands for an empty frame. A sensor's frames are one sequence, which one task passes over in order, a
    batch at a time; a task takes a frame of all of its sensors in one step.
    """
    parts = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("frame_id", "sensor_id", "det_id")
    return narrowed(detections).repartition(parts, "sensor_id").sortWithinPartitions(*order).mapInArrow(_follow(dt), SCHEMA)


def derived(tracks: DataFrame, confirm: int = 3, dynamic: float = 0.25) -> DataFrame:
    """tracks with speed, heading (radians), velocity_rmse, is_confirmed and is_dynamic.

    velocity_rmse is a quarter of the root of the mean velocity variance (pv) over the hits, between 0.04 and 1.2.
    """
    speed = F.hypot("vx", "vy")
    spread = F.greatest(F.col("pv"), F.lit(0.0)) / F.greatest(F.col("hits"), F.lit(1))
    sure = F.col("hits") >= confirm
    out = {"speed": speed, "heading": F.atan2("vy", "vx"), "velocity_rmse": F.least(F.greatest(F.sqrt(spread) * 0.25, F.lit(0.04)), F.lit(1.2)), "is_confirmed": sure, "is_dynamic": sure & (speed >= dynamic)}
    return tracks.withColumns(out)
