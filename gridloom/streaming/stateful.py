"""Streams: tracking and terrain memory with state that ends, joins of streams under watermarks, sinks and playback commands."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gridloom.operators import track as tr

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str | None, late: str) -> DataFrame:
    """df by key through a processor, with timers by the time column's watermark if there is one.

    State of this kind needs the RocksDB store, which the session is set to; a query reads that when it starts. Timers go by
    event time, as a replay then ends state where the first run did.
    """
    df.sparkSession.conf.set(_STORE, _ROCKS)
    df = df.withWatermark(time, late) if time else df
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime" if time else "None")


class Idle(StatefulProcessor):
    """A processor whose state for a key goes by a timer when the watermark is idle_ms beyond the key's latest time."""

    def __init__(self, time: str | None, idle_ms: int):
        self.time, self.idle_ms, self.handle, self.states = time, idle_ms, None, ()

    def awaited(self, batch: pd.DataFrame) -> None:
        """Sets the key's only timer anew, if its time has moved."""
        if self.time is None:
            return
        due = int(batch[self.time].max().value // 1_000_000) + self.idle_ms
        old = list(self.handle.listTimers())
        if all(t < due for t in old):
            for t in old:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for s in self.states:
            s.clear()
        return iter(())

    def close(self) -> None:
        pass


_TRACK = "hits long, age long, misses long, kind string, " + ", ".join(f"{c} double" for c in ("x", "y", "vx", "vy", "px", "py", "pvx", "pvy", "dt", "length", "width", "height"))


class Tracking(Idle):
    """A sensor's tracks as map state, by track_id, and its place in its sequence. A track that has coasted too long leaves the state."""

    def __init__(self, dt: float, time: str | None, idle_ms: int):
        super().__init__(time, idle_ms)
        self.dt = dt

    def init(self, handle) -> None:
        self.handle = handle
        self.own = handle.getMapState("tracks", "track_id long", _TRACK)
        self.at = handle.getValueState("place", "next_id long, last long")
        self.states = (self.own, self.at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = sorted((k[0], v) for k, v in self.own.iterator())
        next_id, last = self.at.get() or (0, None)
        state = np.array([v[4:] for _, v in known], float).reshape(-1, 12)
        counts = np.array([(k, *v[:3]) for k, v in known], np.int64).reshape(-1, 4)
        own = tr.Follower(self.dt, tr.Tracks(state, counts, np.array([v[3] for _, v in known], object)), next_id, last)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["frame_id", "det_id"], kind="stable")
        frame, seen, kinds = batch.frame_id.to_numpy(), batch[list(tr.SEEN)].to_numpy(float), batch.kind.to_numpy(object)
        cuts = [0, *(np.flatnonzero(frame[1:] != frame[:-1]) + 1).tolist(), len(frame)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own.frame(int(key[0]), int(frame[a]), seen[a:b], kinds[a:b])
        alive = own.tracks
        for k in {k for k, _ in known} - set(alive.counts[:, tr.ID].tolist()):
            self.own.removeKey((k,))
        for s, c, kind in zip(alive.state.tolist(), alive.counts.tolist(), alive.kinds.tolist(), strict=True):
            self.own.updateValue((c[tr.ID],), (*c[1:], kind, *s))
        self.at.update((own.next_id, own.last))
        self.awaited(batch)
        yield own.reported().to_pandas()


def tracks(detections: DataFrame, dt: float = 0.1, time: str | None = None, late: str = "2 seconds", idle_ms: int = 600_000) -> DataFrame:
    """The stream form of operators.track.track: the same steps, with a sensor's tracks kept as state between batches.

    Frames of a batch are taken in order; a frame that is not after the last one is late and dropped. State holds at most MOST
    tracks and one place a sensor. With a time column, rows later than `late` are dropped too, and a sensor that is silent
    for idle_ms is forgotten: should it come back, its tracks begin anew.
    """
    return with_state(tr.narrowed(detections, *([time] if time else [])), "sensor_id", Tracking(dt, time, idle_ms), tr.SCHEMA, time, late)


#: Fixed values of terrain memory: most cells of a sensor, and how many more go when there are too many.
MOST_CELLS, SLACK = 15_000, 500
#: Cells of memory that are one entry of the state: a square of this many by as many, and a run of insertions.
_TILE, _RUN = 16, 512
BLENDED = "sensor_id bigint, frame_id bigint, kx bigint, ky bigint, z double, p double, n bigint"


class Terrain(Idle):
    """A sensor's remembered heights as map state by tile, and the order in which its cells came, as map state by run.

    A cell is one height with its variance; what is over MOST_CELLS after a frame goes in the order of insertion, and SLACK
    more. Reading a batch's tiles and writing them back costs calls by tile and not by cell.
    """

    def __init__(self, noise: float, drift: float, most: int, slack: int, time: str | None, idle_ms: int):
        super().__init__(time, idle_ms)
        self.noise, self.drift, self.most, self.slack = noise, drift, most, slack

    def init(self, handle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "tx long, ty long", "kx array<bigint>, ky array<bigint>, z array<double>, p array<double>, n array<bigint>")
        self.order = handle.getMapState("order", "run long", "kx array<bigint>, ky array<bigint>")
        self.at = handle.getValueState("place", "first long, next long, last long")
        self.states = (self.cells, self.order, self.at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, nxt, last = self.at.get() or (0, 0, None)
        tiles: dict[tuple[int, int], dict[tuple[int, int], list]] = {}
        runs: dict[int, list[tuple[int, int]]] = {}

        def tile(k: tuple[int, int]) -> dict:
            at = (k[0] // _TILE, k[1] // _TILE)
            if at not in tiles:
                got = self.cells.getValue(at) if self.cells.containsKey(at) else ((), (), (), (), ())
                tiles[at] = {(x, y): [z, p, n] for x, y, z, p, n in zip(*got, strict=True)}
            return tiles[at]

        def run(number: int) -> list:
            if number not in runs:
                got = self.order.getValue((number,)) if self.order.containsKey((number,)) else ((), ())
                runs[number] = list(zip(*got, strict=True))
            return runs[number]

        batch = pd.concat(list(rows), ignore_index=True).sort_values(["frame_id", "nth"], kind="stable")
        out = []
        for frame, own in batch.groupby("frame_id", sort=True):
            if last is not None and frame <= last:
                continue
            for x, y, z in zip(own.kx.tolist(), own.ky.tolist(), own.z.tolist(), strict=True):
                there = tile((x, y))
                cell = there.get((x, y))
                if cell is None:
                    cell = there[x, y] = [z, 2 * self.noise, 1]
                    run(nxt // _RUN).append((x, y))
                    nxt += 1
                else:
                    gain = cell[1] / (cell[1] + self.noise)
                    cell[:] = [cell[0] + gain * (z - cell[0]), (1 - gain) * cell[1] + self.drift, cell[2] + 1]
                out.append((int(key[0]), int(frame), x, y, *cell))
            if nxt - first > self.most:
                for _ in range(nxt - first - self.most + self.slack):
                    k = run(first // _RUN)[first % _RUN]
                    del tile(k)[k]
                    first += 1
            last = int(frame)
        for at, own in tiles.items():
            if own:
                self.cells.updateValue(at, tuple(list(v) for v in zip(*((*k, *v) for k, v in own.items()), strict=True)))
            elif self.cells.containsKey(at):
                self.cells.removeKey(at)
        for number, own in runs.items():
            if number >= first // _RUN:
                self.order.updateValue((number,), tuple(list(v) for v in zip(*own, strict=True)))
            elif self.order.containsKey((number,)):
                self.order.removeKey((number,))
        self.at.update((first, nxt, last))
        self.awaited(batch)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BLENDED.split(", ")])


def terrain(cells: DataFrame, noise: float = 0.0025, drift: float = 0.002, most: int = MOST_CELLS, slack: int = SLACK, time: str | None = None, late: str = "2 seconds", idle_ms: int = 600_000) -> DataFrame:
    """Heights of 0.1 m cells blended over frames with bounded memory: (sensor_id, frame_id, nth, kx, ky, z) to the height,
    variance and count of each cell after each of its frames.

    nth is a cell's place within its frame, which is the order of insertion. A frame not after the last one is late and
    dropped. A forgotten cell that is seen again starts anew. With a time column, a sensor silent for idle_ms is forgotten.
    """
    whole = [F.col(c).cast("bigint").alias(c) for c in ("sensor_id", "frame_id", "nth", "kx", "ky")]
    own = cells.select(*whole, F.col("z").cast("double").alias("z"), *([time] if time else []))
    return with_state(own, "sensor_id", Terrain(noise, drift, most, slack, time, idle_ms), BLENDED, time, late)


#: What a stream's progress says of a stateful operator's rows.
_DROPPED, _HELD = "numRowsDroppedByWatermark", "numRowsTotal"


def posed(detections: DataFrame, poses: DataFrame, time: str = "ts", within: str = "200 milliseconds", late: str = "2 seconds") -> DataFrame:
    """A stream of detections (sensor_id, frame_id, det_id, x, y, ts) with the latest pose (sensor_id, x, y, yaw, ts) of their
    sensor that is not after them and at most `within` before: world_x, world_y and age_ms.

    Both streams have watermarks: rows later than `late` are dropped, and what can find no partner any more leaves the state,
    so state is bounded by what arrives in late + within. A detection comes out once, when no better pose can come; one without
    a pose does not. Batch tables work alike.
    """
    d = detections.withWatermark(time, late).alias("d")
    p = poses.select(F.col("sensor_id").alias("pose_sensor"), F.col("x").alias("pose_x"), F.col("y").alias("pose_y"), F.col("yaw").alias("pose_yaw"), F.col(time).alias("pose_ts")).withWatermark("pose_ts", late)
    near = d.join(p, F.expr(f"sensor_id = pose_sensor AND pose_ts <= {time} AND pose_ts >= {time} - INTERVAL {within}"))
    best = near.groupBy(time, "sensor_id", "frame_id", "det_id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max(F.struct("pose_ts", "pose_x", "pose_y", "pose_yaw")).alias("p"))
    c, s = F.cos("p.pose_yaw"), F.sin("p.pose_yaw")
    age = (F.unix_micros(time) - F.unix_micros("p.pose_ts")) / 1000
    return best.select("sensor_id", "frame_id", "det_id", time, (F.col("p.pose_x") + c * F.col("x") - s * F.col("y")).alias("world_x"), (F.col("p.pose_y") + s * F.col("x") + c * F.col("y")).alias("world_y"), age.alias("age_ms"))


def dropped(query) -> int:
    """Rows that a running query's stateful operators have dropped as late, over the batches that it still reports."""
    return sum(int(o[_DROPPED]) for p in query.recentProgress for o in p["stateOperators"])


def held(query) -> int:
    """Rows in a running query's state after its last batch."""
    return sum(int(o[_HELD]) for o in query.lastProgress["stateOperators"])


def rates(events: DataFrame, time: str = "ts", late: str = "2 seconds", window: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Counts and means by window, sliding if slide is given, and kind; events later than `late` are dropped."""
    g = events.withWatermark(time, late).groupBy(F.window(time, window, slide), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "3 seconds", late: str = "2 seconds") -> DataFrame:
    """Spells of a key without a pause of `gap`: what is stale ends one."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def append_logs(path: str, log: str):
    """A foreachBatch function that appends rows of one of telemetry.LOGS to <path>/<log>.

    Each batch is a partition, which is replaced if the batch is run again, so that nothing is logged twice.
    """
    from gridloom.operators.telemetry import log_rows

    def write(batch: DataFrame, number: int) -> None:
        out = log_rows(batch, log).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{log}")

    return write


class Playback:
    """What the viewer's commands ask of a sequence of frames: pause, resume, toggle_pause, step, seek, set_speed, set_dataset, ping."""

    #: Other names of the commands.
    ALIASES = {
        "play": "resume", "playback_resume": "resume", "playback_play": "resume", "playback_pause": "pause", "pause_toggle": "toggle_pause",
        "next": "step", "step_forward": "step", "playback_next": "step", "swap_dataset": "set_dataset", "switch_dataset": "set_dataset", "dataset_toggle": "set_dataset", "speed": "set_speed",
    }

    def __init__(self, frames: int, datasets: tuple[str, ...] = ("static", "dynamic")):
        self.frames, self.datasets = frames, datasets
        self.at, self.speed, self.paused, self.dataset = 0, 1.0, False, datasets[0]

    def handle(self, message: str) -> dict:
        """Applies one JSON command, once, and returns the reply."""
        try:
            m = json.loads(message)
            name = str(m.get("action") or m.get("command") or m["type"]).lower().strip()
            name = self.ALIASES.get(name, name)
            if name in ("ping", "pong"):
                return {"type": "pong"}
            if name in ("pause", "resume", "toggle_pause"):
                self.paused = {"pause": True, "resume": False, "toggle_pause": not self.paused}[name]
            elif name == "step":
                self.paused = True
                self.at = (self.at + 1) % max(1, self.frames)
            elif name == "seek":
                self.at = max(0, min(int(m.get("frame", 0)), self.frames - 1))
            elif name == "set_speed":
                self.speed = max(0.1, min(10.0, float(m.get("speed") or m.get("value", 1.0))))
            elif name == "set_dataset":
                wanted = str(m.get("mode") or m.get("dataset") or self.datasets[0]).lower()
                if wanted not in self.datasets:
                    return {"type": "error", "message": f"unknown dataset {wanted}"}
                self.dataset, self.at = wanted, 0
                return {"type": "dataset_swapped", "dataset": self.dataset}
            else:
                return {"type": "error", "message": f"unknown command {name}"}
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return {"type": "error", "message": str(e)}
        return {"type": "ok", "frame": self.at, "speed": self.speed, "paused": self.paused}

    def advance(self) -> int | None:
        """The next frame to show, or None while paused."""
        if self.paused or not self.frames:
            return None
        shown, self.at = self.at, (self.at + 1) % self.frames
        return shown

    def pause_s(self, fps: float, spent_s: float) -> float:
        """How long to wait after a frame."""
        return max(0.05, 1 / fps / self.speed - spent_s)


def live(spark, per_second: int = 4, dt_ms: int = 50) -> DataFrame:
    """A stream of the points of made-up sweeps at a steady rate: frame_id, ts and the columns of sources.sweeps.procedural.

    Hashes repeat every 500 frames, and the vehicle, which starts 2 m ahead and goes 4 m a second, starts again every 200.
    """
    from gridloom.sources.sweeps import sweep_points

    frames = spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("frame_id"), F.col("timestamp").alias("ts"))
    each = frames.select("frame_id", "ts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8599).cast("bigint"))).alias("point_idx"))
    ahead = F.lit(2000) + (F.col("frame_id") % 200) * dt_ms * 4
    return sweep_points(each, F.col("frame_id") % 500, ahead, "ts")
