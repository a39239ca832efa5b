"""Telemetry: frames and their JSON, capped cells, histories, latest state, gaps, recordings and viewer rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.cells import band, drivable

#: Columns of the three logs.
HEALTH = "timestamp double, loop_fps double, latency_ms double, active_quadtree_cells bigint, ram_usage_mb double, vram_usage_mb double"
TRACKS = "timestamp double, track_id bigint, object_class string, pos_x double, pos_y double, vel_x double, vel_y double, speed double, heading double"
HAZARDS = "timestamp double, hazard_type string, location_x double, location_y double, clearance_margin double, action_taken string"


def evenly(df: DataFrame, group: list[str], order: list[str], count: Column, slots: Column) -> DataFrame:
    """Rows whose rank in a group (from 0, of count) is floor(i (count - 1) / (slots - 1)) for an i below slots; all if they fit."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    d = df.withColumn("_r", r).withColumn("_c", count).withColumn("_m", slots)
    # r is taken if some i in 0 .. m-1 has floor(i (c - 1) / (m - 1)) = r
    i = F.ceil(F.col("_r") * (F.col("_m") - 1) / (F.col("_c") - 1))
    hit = (F.floor(i * (F.col("_c") - 1) / (F.col("_m") - 1)) == F.col("_r")) & (i < F.col("_m"))
    ok = F.when(F.col("_c") <= F.col("_m"), True).when(F.col("_m") <= 0, False).when(F.col("_m") == 1, F.col("_r") == 0).otherwise(hit)
    return d.where(ok).drop("_r", "_c", "_m")


def capped(leaves: DataFrame, most: int) -> DataFrame:
    """At most `most` leaves a frame: those without cost and the others share it, half for the former at least, evenly sampled."""
    frame = Window.partitionBy("frame_id")
    l = leaves.withColumn("_free", F.col("cost") == 0).withColumn("_nf", F.count_if(F.col("cost") == 0).over(frame)).withColumn("_nh", F.count_if(F.col("cost") != 0).over(frame))
    high = F.least(F.col("_nh"), F.greatest(F.lit(0), most - F.least(F.col("_nf"), F.lit(most // 2))))
    slots = F.when(F.col("_nf") + F.col("_nh") <= most, F.lit(most)).when(F.col("_free"), F.greatest(F.lit(0), most - high)).otherwise(high)
    count = F.when(F.col("_free"), F.col("_nf")).otherwise(F.col("_nh"))
    return evenly(l, ["frame_id", "_free"], ["size_mm", "gy", "gx"], count, slots).drop("_free", "_nf", "_nh")


def raw_points(points: DataFrame, most: int) -> DataFrame:
    """Of each frame, the coordinates of every stride-th point in one array, in order; stride = max(1, n div most)."""
    frame = Window.partitionBy("frame_id")
    n = F.count(F.lit(1)).over(frame)
    r = F.row_number().over(frame.orderBy("point_idx")) - 1
    own = points.withColumn("_s", F.greatest(F.floor(n / most), F.lit(1))).withColumn("_r", r).where("_r % _s = 0")
    p = F.array_sort(F.collect_list(F.struct("_r", "x_mm", "y_mm", "z_mm")))
    return own.groupBy("frame_id").agg(F.flatten(F.transform(p, lambda v: F.array(v["x_mm"], v["y_mm"], v["z_mm"]))).alias("xyz"))


def served(leaves: DataFrame) -> DataFrame:
    """leaves with what is sent of them: cost 0 on the road, unless it is 100, its band and colour."""
    road = drivable(F.col("mean_z"), F.col("dz"), F.col("z_max")) & (F.col("cost") != 100)
    cost = F.when(road, 0).otherwise(F.col("cost"))
    return leaves.withColumn("cost", cost).withColumn("band", band(F.col("cost"))).withColumn("color", F.when(F.col("cost") <= 50, "green").when(F.col("cost") <= 180, "yellow").otherwise("red"))


def serialised(leaves: DataFrame, *more: str) -> DataFrame:
    """frame_id, more columns and cell, a struct as it is sent: place, heights and size in metres of two digits, both costs, and whether observed.

    leaves need x_mm, y_mm, size_mm, z_min, z_max, dz, mean_z, slope, n, cost; semantic_cost and variance may be absent. What
    was not observed (cost -1, no points, no height) has its place, costs of -1 and nulls. A cost of 100 in either stays, the
    road costs 0, and else the greater of both counts; an obstacle without a cost is lethal.
    """
    have = lambda c: F.col(c) if c in leaves.columns else F.lit(None)
    raw, semantic = F.coalesce("cost", F.lit(0)), F.coalesce(have("semantic_cost").cast("int"), "cost", F.lit(0))
    seen = (raw != -1) & (F.coalesce("n", F.lit(0)) > 0) & F.col("mean_z").isNotNull()
    own = F.when(raw > 0, raw).when((F.col("dz") > 250) | (F.col("z_max") > -1150), 255).otherwise(0)
    cost = F.when(~seen, -1).when((raw == 100) | (semantic == 100), 100).when(drivable(F.col("mean_z"), F.col("dz"), F.col("z_max")), 0).otherwise(F.greatest(own, semantic, F.lit(0))).cast("int")
    metres = lambda c: F.rint(F.col(c) / 10.0) / 100.0  # half to even, in centimetres
    only = lambda v: F.when(seen, v)
    parts = {"x": metres("x_mm"), "y": metres("y_mm"), "z": only(metres("mean_z")), "z_min": only(metres("z_min")), "z_max": only(metres("z_max")), "size": metres("size_mm"), "cost": cost, "semantic_cost": cost, "observed": seen}
    parts |= {"delta_z": only(metres("dz")), "variance": only(F.bround(have("variance").cast("double"), 2)), "slope": only(F.bround("slope", 1)), "pts": F.when(seen, F.col("n")).otherwise(0).cast("bigint")}
    return leaves.select("frame_id", *more, F.struct(*[v.alias(k) for k, v in parts.items()]).alias("cell"))


def completed(frames_: DataFrame) -> DataFrame:
    """Statistics of frames with what is missing filled in: cell_count from active_cells or n_cells, point_count of 12 a cell,
    coarse_cells of 70 % (half up), fine_cells, refinement_ratio, and tracks from n_objects and n_dynamic.

    frames_ has these columns, null where a frame does not say; n_cells, n_objects and n_dynamic count what it holds.
    """
    ok = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    f = frames_.withColumn("cell_count", F.coalesce(ok("cell_count"), ok("active_cells"), F.col("n_cells"), F.lit(0)).cast("bigint"))
    f = f.withColumn("active_cells", F.col("cell_count")).withColumn("point_count", F.coalesce(ok("point_count"), F.col("cell_count") * 12).cast("bigint"))
    f = f.withColumn("coarse_cells", F.coalesce(ok("coarse_cells"), F.floor(F.col("cell_count") * 0.7 + 0.5)).cast("bigint"))
    f = f.withColumn("fine_cells", F.coalesce(ok("fine_cells"), F.greatest(F.lit(0), F.col("cell_count") - F.col("coarse_cells"))).cast("bigint"))
    f = f.withColumn("refinement_ratio", F.coalesce(ok("refinement_ratio"), F.try_divide("fine_cells", "cell_count"), F.lit(0.0)).cast("double"))
    return f.withColumn("active_tracks", F.coalesce(ok("active_tracks"), F.col("n_objects"), F.lit(0)).cast("bigint")).withColumn("dynamic_tracks", F.coalesce(ok("dynamic_tracks"), F.col("n_dynamic"), F.lit(0)).cast("bigint"))


def frames(leaves: DataFrame, tracks: DataFrame, most: int = 10_000) -> DataFrame:
    """frame_id and a JSON document of its capped cells, moving tracks and counts."""
    cells = capped(served(leaves), most).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("size_mm", "gy", "gx", (F.rint("mean_z") / 1000).alias("z"), "cost", "color"))).alias("cells"), F.count_if(F.col("band") == "lethal").alias("lethal"))
    t = tracks.where("is_dynamic").groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("track_id", *[F.bround(c, 2).alias(c) for c in ("x", "y", "vx", "vy")]))).alias("dynamic_objects"))
    doc = F.to_json(F.struct("frame_id", "cells", F.coalesce("dynamic_objects", F.array()).alias("dynamic_objects"), F.struct(F.size("cells").alias("cells"), "lethal").alias("system_stats")))
    return cells.join(t, "frame_id", "left").select("frame_id", doc.alias("frame"))


#: What is sent of a frame. Cells, objects and statistics are structs in the document, and raw_points one flat array.
CELL = "struct<x:double,y:double,z:double,z_min:double,z_max:double,size:double,cost:int,semantic_cost:int,observed:boolean,delta_z:double,variance:double,slope:double,pts:bigint>"
OBJECT = "struct<id:bigint,class:string,stationary:boolean,x:double,y:double,z:double,vx:double,vy:double,speed:double,heading:double,dimensions:array<double>,bbox:array<double>,hazard_cones:array<struct<t:int,cx:double,cy:double,polygon:array<array<double>>>>>"
DOCUMENT = f"frame_id bigint, mode string, system_status string, cells array<{CELL}>, dynamic_objects array<{OBJECT}>, raw_points array<double>"
#: Fixed value: MiB that a frame's leaves should stay below.
MEMORY_TARGET_MIB = 15.0


def sent_objects(tracks: DataFrame, cones: DataFrame, clusters: DataFrame) -> DataFrame:
    """frame_id, object: moving tracks with the cones that they may reach, and parked cars as stationary objects with ids -1, -2, ...

    tracks: track_id, kind, x, y, vx, vy, length, width, height, is_dynamic in metres (kind and height may be absent); those that are
    neither dynamic nor faster than 0.15 m/s are not sent. clusters: merged_summaries() in millimetres.
    """
    two = lambda v: F.bround(v.cast("double"), 2)
    have = lambda c, v: F.col(c) if c in tracks.columns else F.lit(v)
    corner = lambda v: F.array(two(v["x"]), two(v["y"]))
    ahead = cones.groupBy("frame_id", "track_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), two(F.col("cx")).alias("cx"), two(F.col("cy")).alias("cy"), F.transform("polygon", corner).alias("polygon")))).alias("_cones"))
    speed = F.hypot("vx", "vy")
    t = tracks.where(F.col("is_dynamic") | (speed >= 0.15)).join(ahead, ["frame_id", "track_id"], "left")
    parts = lambda *names: F.array(*[two(n) for n in names])
    length, width, height = F.col("length"), F.col("width"), have("height", 0.0).cast("double")
    none = F.array().cast("array<struct<t:int,cx:double,cy:double,polygon:array<array<double>>>>")
    moving = F.struct(
        F.col("track_id").cast("bigint").alias("id"), have("kind", "vehicle").alias("class"), F.lit(False).alias("stationary"), two(F.col("x")).alias("x"), two(F.col("y")).alias("y"), F.lit(0.0).alias("z"),
        two(F.col("vx")).alias("vx"), two(F.col("vy")).alias("vy"), two(speed).alias("speed"), two(F.atan2("vy", "vx")).alias("heading"), parts(length, width, height).alias("dimensions"),
        parts(F.col("x") - length / 2, F.col("y") - width / 2, F.lit(0.0), F.col("x") + length / 2, F.col("y") + width / 2, height).alias("bbox"), F.coalesce("_cones", none).alias("hazard_cones"),
    )
    m = lambda c: F.col(c) / 1000.0
    mean = lambda a: F.col(f"{a}_sum") / F.col("n") / 1000.0
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy("group"))
    zero = F.lit(0.0)
    parked = F.struct(
        (-F.col("_r")).cast("bigint").alias("id"), F.lit("parked_car").alias("class"), F.lit(True).alias("stationary"), two(mean("x")).alias("x"), two(mean("y")).alias("y"), two(mean("z")).alias("z"),
        zero.alias("vx"), zero.alias("vy"), zero.alias("speed"), zero.alias("heading"), parts(*[m(f"{a}_hi") - m(f"{a}_lo") for a in "xyz"]).alias("dimensions"),
        parts(*[m(f"{a}_{e}") for e in ("lo", "hi") for a in "xyz"]).alias("bbox"), none.alias("hazard_cones"),
    )
    cars = clusters.where("kind = 'parked_car'").withColumn("_r", rank)
    return t.select("frame_id", moving.alias("object")).unionByName(cars.select("frame_id", parked.alias("object")))


def sent_statistics(statistics: DataFrame) -> DataFrame:
    """frame_id, system_status, system_stats: frame_statistics() under all the names that viewers know, and what derives from them.

    mapping_accuracy and surface_precision are the plain share of safe cells in percent. Timings are the caller's: columns that end
    in _ms, and fps and latency_ms, are passed on if statistics has them. Memory is modelled; what cannot be known is absent.
    """
    mib = lambda c: F.round(F.col(c) / float(1 << 20), 2)
    share = F.round(F.coalesce(F.try_divide(F.col("safe_cells") * 100.0, F.col("cell_count")), F.lit(0.0)), 1)
    own = {c: F.col(c) for c in statistics.columns if c not in ("frame_id", "system_status", "leaf_bytes", "uniform_bytes", "saved_percent")}
    own |= {"active_cells": F.col("cell_count"), "mapping_accuracy": share, "surface_precision": share, "sensor_health": F.col("system_status")}
    own |= {c: mib("leaf_bytes") for c in ("mapping_memory_mib", "ram_mb", "adaptive_theoretical_mib")}
    own |= {c: mib("uniform_bytes") for c in ("uniform_5cm_theoretical_mib", "uniform_5cm_full_domain_theoretical_memory_mib")}
    own |= {"theoretical_reduction_percent": F.round("saved_percent", 1), "mapping_memory_target_mib": F.lit(MEMORY_TARGET_MIB), "mapping_memory_target_status": F.when(F.col("leaf_bytes") / float(1 << 20) < MEMORY_TARGET_MIB, "PASS").otherwise("FAIL")}
    own |= {"target_fps": F.lit(33), "target_latency_ms": F.lit(30), "ground_truth_status": F.lit("NOT AVAILABLE")}
    if "latency_ms" in statistics.columns:
        own["total_latency_ms"] = F.col("latency_ms")
    if "fps" in statistics.columns:
        own["actual_fps"] = F.col("fps")
    return statistics.select("frame_id", "system_status", F.struct(*[v.alias(k) for k, v in own.items()]).alias("system_stats"))


def documents(leaves: DataFrame, objects: DataFrame, statistics: DataFrame, points: DataFrame, most: int = 10_000, most_points: int = 2000, mode: str = "2.5D ADAPTIVE") -> DataFrame:
    """frame_id and the whole JSON document of each frame of statistics: cells as serialised() has them, objects as sent_objects(),
    statistics as sent_statistics(), and the coordinates of every stride-th point in metres. A frame without cells, objects or
    points has empty arrays. Cells and points are capped by frame, as the viewer asks; arrays are in order of size, gy, gx, of id, and of place."""
    chosen = capped(leaves, most).withColumn("_at", F.struct("size_mm", "gy", "gx"))
    extra = chosen.select("frame_id", "_at", *[c for c in leaves.columns if c not in ("frame_id", "_at")])
    cells = serialised(extra, "_at").groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "cell"))), lambda v: v["cell"]).alias("cells"))
    own = objects.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct(F.col("object.id").alias("i"), "object"))).alias("o")).select("frame_id", F.transform("o", lambda v: v["object"]).alias("dynamic_objects"))
    raw = raw_points(points, most_points).select("frame_id", F.transform("xyz", lambda v: v / 1000.0).alias("raw_points"))
    f = sent_statistics(statistics).join(cells, "frame_id", "left").join(own, "frame_id", "left").join(raw, "frame_id", "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    doc = F.struct("frame_id", F.lit(mode).alias("mode"), "system_status", "system_stats", empty("cells", CELL), empty("dynamic_objects", OBJECT), empty("raw_points", "double"))
    return f.select("frame_id", F.to_json(doc).alias("document"))


FRAME_SCHEMA = "frame_id bigint, cells array<struct<size_mm:int,gy:bigint,gx:bigint,z:double,cost:int,color:string,observed:boolean>>, dynamic_objects array<struct<track_id:int,x:double,y:double,vx:double,vy:double>>, system_stats struct<cells:int,lethal:bigint>"


def valid_frame(frame: Column) -> Column:
    """Whether a parsed frame is complete: cells with a cost of 0 to 255 and a height, or unobserved ones with -1 and none."""
    cell_ok = lambda c: F.coalesce((c["cost"].between(0, 255) & c["z"].isNotNull()) | (~F.coalesce(c["observed"], F.lit(True)) & (c["cost"] == -1) & c["z"].isNull()), F.lit(False))
    track_ok = lambda t: t["x"].isNotNull() & t["y"].isNotNull()
    whole = frame["frame_id"].isNotNull() & frame["cells"].isNotNull() & frame["dynamic_objects"].isNotNull() & frame["system_stats"].isNotNull()
    return F.coalesce(whole & F.forall(frame["cells"], cell_ok) & F.forall(frame["dynamic_objects"], track_ok), F.lit(False))


def parsed(documents: DataFrame, column: str) -> DataFrame:
    """documents with frame (parsed) and ok."""
    return documents.withColumn("frame", F.from_json(column, FRAME_SCHEMA)).withColumn("ok", valid_frame(F.col("frame")))


def stage_latency(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, least, greatest and 95th percentile (linear) by stage."""
    v = F.col(value)
    return samples.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.percentile(v, 0.95).alias("p95"))


def latest(rows: DataFrame, key: str, time: str, tie: str, *columns: str) -> DataFrame:
    """Last row of each key: aggregated before it is shuffled, so a key with most rows is no burden."""
    best = F.max(F.struct(time, tie, *[c for c in columns if c not in (time, tie)])).alias("m")
    return rows.groupBy(key).agg(best).select(key, "m.*")


def ring(rows: DataFrame, time: str, tie: str, most: int = 100) -> DataFrame:
    """The last `most` rows."""
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(most)


def ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.2, run: int = 100_000) -> DataFrame:
    """Exponential average of each key after its last row, from its first value.

    An average is a weighted sum, so runs of a key are folded apart and combined: a run of n rows scales what came before
    by (1 - alpha)^n. Runs are of about `run` rows, by their place in a range sort, and no task holds a whole key.
    """
    buckets = int(rows.count() // run) + 8
    ranged = rows.select(key, *order, F.col(value).cast("double").alias("_v")).repartitionByRange(buckets, key, *order).sortWithinPartitions(key, *order).withColumn("_run", F.spark_partition_id())
    runs = ranged.groupBy(key, "_run").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_v"))), lambda r: r["_v"]).alias("v"))
    fold = F.aggregate("v", F.lit(0.0), lambda a, x: (1 - alpha) * a + alpha * x)
    runs = runs.select(key, "_run", F.size("v").alias("n"), F.element_at("v", 1).alias("first"), fold.alias("a"))
    parts = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_run", "n", "first", "a"))).alias("r"))
    start = F.element_at("r", 1)["first"]  # the first value counts as the average before the first row
    return parts.select(key, F.aggregate("r", start, lambda s, r: s * F.pow(F.lit(1 - alpha), r["n"]) + r["a"]).alias("ema"))


def history_means(history: DataFrame, source: str, *metrics: str) -> DataFrame:
    """Mean and greatest of each metric by source."""
    return history.groupBy(source).agg(*[f(m).alias(f"{n}_{m}") for m in metrics for f, n in ((F.avg, "mean"), (F.max, "max"))])


def replay_delays(recording: DataFrame, key: str, speed: float = 1.0) -> DataFrame:
    """Milliseconds to wait after each frame of a recording: at least 16, null after the last."""
    w = Window.partitionBy(key).orderBy("elapsed_ms", "frame")
    return recording.withColumn("delay_ms", F.greatest(F.lit(16.0), (F.lead("elapsed_ms").over(w) - F.col("elapsed_ms")) / speed))


def session_seconds(recording: DataFrame, key: str) -> DataFrame:
    """How long each recording lasts."""
    return recording.groupBy(key).agg(((F.max("elapsed_ms") - F.min("elapsed_ms")) / 1000).alias("seconds"))


def reconnect_delays(attempt: Column, first_s: int = 1, most_s: int = 8) -> Column:
    """Seconds to wait before the attempt-th try (from 0) to reconnect: doubled each time, up to most_s."""
    return F.least(F.lit(float(first_s)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30))), F.lit(float(most_s)))


def recording_problems(recording: DataFrame, key: str, most: int = 600) -> DataFrame:
    """Of each recording: frames, how many go back in time or lie outside a day, and whether it can be replayed."""
    w = Window.partitionBy(key).orderBy("frame")
    r = recording.withColumn("_back", F.col("elapsed_ms") < F.lag("elapsed_ms").over(w)).withColumn("_far", ~F.col("elapsed_ms").between(0, 86_400_000))
    s = r.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.count_if("_back").alias("back"), F.count_if("_far").alias("outside"))
    return s.withColumn("ok", F.col("frames").between(1, most) & (F.col("back") == 0) & (F.col("outside") == 0))


def _spaced(gap_s: float):
    """Arrow batches of key, tie, _t, _first (whether a key's first row), in order of key and time, to key and tie of the rows taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -np.inf  # the time after which the key of the batch before goes on; -inf: at once
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column(2).to_numpy(zero_copy_only=False)
            first = batch.column(3).to_numpy(zero_copy_only=False)
            taken = np.isnan(t)  # what has no time is taken, and holds up nothing
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(first), [len(t)]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if first[a]:
                    last = -np.inf
                at = a + np.flatnonzero(~taken[a:b])
                own = t[at]
                after = np.searchsorted(own, own + gap_s, "left").tolist()
                k = int(np.searchsorted(own, last, "left"))
                while k < len(own):
                    taken[at[k]], last = True, own[k] + gap_s
                    k = max(k + 1, after[k])
            yield batch.select([0, 1]).filter(pa.array(taken))

    return run


def throttled(rows: DataFrame, key: str, time: str, tie: str, gap_s: float) -> DataFrame:
    """Rows of each key at least gap_s after the last one taken, starting with its first.

    Keys are passed over in order of time, many in one Arrow batch; what goes from batch to batch is the last time taken. Each
    taken row is found from the last one by a search, so a task holds a batch, however long a key is.
    """
    schema = f"{key} {dict(rows.dtypes)[key]}, {tie} {dict(rows.dtypes)[tie]}"
    order = Window.partitionBy(key).orderBy("_t", tie)
    own = rows.select(key, tie, F.col(time).cast("double").alias("_t")).withColumn("_first", F.row_number().over(order) == 1)
    return own.mapInArrow(_spaced(gap_s), schema)


def stale_gaps(rows: DataFrame, key: str, time: str, tie: str, limit_s: float = 3.0) -> DataFrame:
    """Pauses of a key longer than limit_s: from, to, seconds.

    time is a timestamp or epoch seconds. Pauses are of whole microseconds, as differences of doubles miss limits and halves.
    """
    w = Window.partitionBy(key).orderBy(time, tie)
    g = rows.select(key, F.col(time).alias("from"), F.lead(time).over(w).alias("to"))
    micros = lambda c: F.rint(F.col(c).cast("double") * 1e6).cast("bigint")
    return g.withColumn("seconds", (micros("to") - micros("from")) / F.lit(1e6)).where(F.col("seconds") > limit_s)


def health_rollup(rows: DataFrame, time: str, value: str, window: str) -> DataFrame:
    """Count, mean and greatest by tumbling window."""
    g = rows.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("greatest"))
    return g.select(F.col("window.start").alias("start"), "n", "mean", "greatest")


def milliseconds(t: Column) -> Column:
    """Epoch seconds or milliseconds to milliseconds."""
    return F.when(t < 1e11, t * 1000).otherwise(t)


def stamp(t: Column) -> Column:
    """Epoch seconds as struct(sec, nanosec)."""
    return F.struct(F.floor(t).cast("bigint").alias("sec"), F.floor((t - F.floor(t)) * 1_000_000_000).cast("bigint").alias("nanosec"))


def visible(leaves: DataFrame, low: int = -5000, high: int = 10_000) -> DataFrame:
    """Leaves whose lowest point the viewer shows, with the colour's hue by height."""
    hue = 0.66 * (1 - F.least(F.greatest((F.col("mean_z") / 1000 + 2) / 3.5, F.lit(0.0)), F.lit(1.0)))
    return leaves.where(F.col("z_min").between(low, high)).withColumn("hue", hue)


def class_group(name: Column) -> Column:
    """vehicle, pedestrian, animal or obstacle, by what a class name contains; null is an obstacle."""
    has = lambda p: name.rlike(f"(?i){p}")
    return F.when(has("vehicle|car|truck|bus"), "vehicle").when(has("pedestrian|person|human"), "pedestrian").when(has("animal|dog|cow|cattle"), "animal").otherwise("obstacle")


#: Fixed values of the viewer: height and scale of a tile by band, and of one that nothing was seen of; floor of what is unknown or high.
TILES = {"lethal": (0.20, 0.98), "caution": (0.10, 0.98), "safe": (0.04, 1.02)}
UNSEEN, FLOOR = (0.01, 0.96), -1.68


def viewer_tiles(leaves: DataFrame, semantic: bool = False) -> DataFrame:
    """leaves with effective_cost, tile_height, scale and floor (metres), as the viewer draws them.

    Unobserved leaves (cost -1, or no mean_z) cost -1. The road costs 0. Others cost their semantic_cost in semantic mode and
    their cost otherwise, each standing in for the other where it is null; 0 without both.
    """
    own = F.col("semantic_cost") if "semantic_cost" in leaves.columns else F.lit(None).cast("int")
    first, second = (own, F.col("cost")) if semantic else (F.col("cost"), own)
    unseen = F.coalesce(F.col("cost") == -1, F.lit(False)) | F.col("mean_z").isNull()
    effective = F.when(unseen, -1).when(drivable(F.col("mean_z"), F.col("dz"), F.col("z_max")), 0).otherwise(F.coalesce(first, second, F.lit(0)))
    t = leaves.withColumn("effective_cost", effective.cast("int"))
    shown = lambda k: F.when(F.col("effective_cost") < 0, UNSEEN[k]).when(F.col("effective_cost") > 180, TILES["lethal"][k]).when(F.col("effective_cost") > 50, TILES["caution"][k]).otherwise(TILES["safe"][k])
    floor = F.when((F.col("effective_cost") >= 0) & (F.col("z_min") < -1000), F.col("z_min") / 1000.0).otherwise(FLOOR)
    return t.withColumn("tile_height", shown(0)).withColumn("scale", shown(1)).withColumn("floor", floor)


def layer(tracks: DataFrame, mode: str = "all") -> DataFrame:
    """Tracks that a layer shows: all, static (those not dynamic) or dynamic."""
    return tracks if mode == "all" else tracks.where(F.col("is_dynamic") if mode == "dynamic" else ~F.coalesce("is_dynamic", F.lit(False)))


def object_table(tracks: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` objects of each frame by track_id, as text of two digits: position, velocity, speed, and heading in degrees."""
    order = Window.partitionBy("frame_id").orderBy("track_id")
    own = tracks.withColumn("row", F.row_number().over(order)).where(F.col("row") <= most)
    pair = lambda a, b: F.format_string("%.2f, %.2f", F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))
    speed = F.coalesce(F.hypot("vx", "vy"), F.lit(0.0))
    shown = F.when(speed > 0, F.format_string("%.2f m/s", speed)).otherwise("0.00 m/s (Stationary)")
    heading = F.format_string("%.1f", F.coalesce(F.degrees(F.atan2("vy", "vx")), F.lit(0.0)))
    return own.select("frame_id", "row", "track_id", pair("x", "y").alias("position"), pair("vx", "vy").alias("velocity"), shown.alias("speed"), heading.alias("heading"))


def normalised(objects: DataFrame) -> DataFrame:
    """Objects of a frame in one form: x, y, z, vx, vy from position and velocity arrays or from columns of those names, speed,
    heading (radians, from heading, heading_deg or the velocity), dimensions by class where there are fewer than three, is_dynamic.

    Columns that are absent count as null; what is null everywhere is 0.
    """
    have = lambda c, t: F.col(c).cast(t) if c in objects.columns else F.lit(None).cast(t)
    place, motion = have("position", "array<double>"), have("velocity", "array<double>")
    at = lambda a, i, c: F.coalesce(F.get(a, F.lit(i)), have(c, "double"), F.lit(0.0)).alias(c)
    o = objects.select(*[c for c in objects.columns if c not in ("x", "y", "z", "vx", "vy", "speed", "heading", "position", "velocity", "dimensions", "is_dynamic")], at(place, 0, "x"), at(place, 1, "y"), at(place, 2, "z"), at(motion, 0, "vx"), at(motion, 1, "vy"),
        have("speed", "double").alias("speed"), have("heading", "double").alias("heading"), have("heading_deg", "double").alias("_deg"), have("dimensions", "array<double>").alias("dimensions"), have("is_dynamic", "boolean").alias("is_dynamic"), have("class", "string").alias("_class"))
    o = o.withColumn("speed", F.coalesce("speed", F.hypot("vx", "vy"))).withColumn("heading", F.coalesce("heading", F.radians("_deg"), F.atan2("vy", "vx")))
    usual = F.when(F.col("_class") == "vehicle", F.array(*map(F.lit, (1.9, 4.2, 1.6)))).otherwise(F.array(*map(F.lit, (0.6, 0.6, 1.75))))
    whole = F.coalesce(F.size("dimensions") >= 3, F.lit(False))
    return o.withColumn("dimensions", F.when(whole, F.col("dimensions")).otherwise(usual)).withColumn("is_dynamic", F.coalesce("is_dynamic", F.col("speed") > 0.05)).drop("_deg", "_class")


def frame_statistics(points: DataFrame, leaves: DataFrame, tracks: DataFrame, thin: DataFrame, drops: DataFrame, clusters: DataFrame, health: DataFrame) -> DataFrame:
    """One row for each frame of points (with is_ground): counts, ratios, states and modelled memory, as far as they derive from data.

    point_count, ground_points, obstacle_points, ground_inlier_ratio; cell_count and its bands and sizes, refinement_ratio;
    active_tracks, dynamic_tracks, parked_cars, thin_hazards, negative_obstacles; system_status and degraded_quadrants;
    modelled bytes of the leaves and of a uniform grid. Counts of what a frame lacks are 0. Timings are the caller's: see
    stage_latency().
    """
    from gridloom.operators.cells import band_counts, memory_model

    one = lambda df, name: df.groupBy("frame_id").agg(F.count(F.lit(1)).alias(name))
    p = points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("point_count"), F.count_if("is_ground").alias("ground_points"), F.count_if(~F.col("is_ground")).alias("obstacle_points"))
    bands = band_counts(leaves)
    memory = memory_model(bands.select("frame_id", "leaves")).drop("leaves")
    t = tracks.groupBy("frame_id").agg(F.count(F.lit(1)).alias("active_tracks"), F.count_if("is_dynamic").alias("dynamic_tracks"))
    parked = clusters.groupBy("frame_id").agg(F.count_if(F.col("kind") == "parked_car").alias("parked_cars"))
    parts = [bands.withColumnsRenamed({"leaves": "cell_count", "safe": "safe_cells", "caution": "caution_cells", "lethal": "hazard_cells", "coarse": "coarse_cells", "fine": "fine_cells"}), t, parked, one(thin, "thin_hazards"), one(drops, "negative_obstacles")]
    out = p
    for part in parts:
        out = out.join(part, "frame_id", "left")
    counted = [c for c in out.columns if c != "frame_id"]
    out = out.na.fill(0, counted).join(memory, "frame_id", "left")
    state = health.select("frame_id", F.when(F.col("is_degraded"), "DEGRADED").otherwise("NOMINAL").alias("_state"), F.col("quadrants").alias("_q"))
    out = out.join(state, "frame_id", "left").withColumn("system_status", F.coalesce("_state", F.lit("NOMINAL"))).withColumn("degraded_quadrants", F.coalesce("_q", F.lit(""))).drop("_state", "_q")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumn("ground_inlier_ratio", ratio("ground_points", "point_count")).withColumn("refinement_ratio", ratio("fine_cells", "cell_count"))


def sweep_box(points: DataFrame) -> DataFrame:
    """Of each frame, the box around its points: centre (doubled) and size by axis."""
    aggs = []
    for c in ("x_mm", "y_mm", "z_mm"):
        aggs += [(F.min(c) + F.max(c)).alias(f"centre2_{c[0]}"), (F.max(c) - F.min(c)).alias(f"size_{c[0]}")]
    return points.groupBy("frame_id").agg(*aggs)


def frame_summary(leaves: DataFrame) -> DataFrame:
    """Of each frame: bands, what is strictly safe (cost under 50), heights, and the plain share of safe leaves."""
    b = band(F.col("cost"))
    s = leaves.groupBy("frame_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(b == "safe").alias("safe"), F.count_if(b == "caution").alias("caution"), F.count_if(b == "lethal").alias("lethal"), F.count_if(F.col("cost") < 50).alias("strictly_safe"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"))
    return s.withColumn("safe_ratio", F.col("safe") / F.col("cells"))


def velocity_error(estimates: DataFrame, truth: DataFrame, reach: float = 2.0) -> DataFrame:
    """Of each frame: root mean square of the velocity's error of tracks against the nearest true object within reach."""
    e, t = estimates.alias("e"), truth.alias("t")
    d2 = (F.col("e.x") - F.col("t.x")) * (F.col("e.x") - F.col("t.x")) + (F.col("e.y") - F.col("t.y")) * (F.col("e.y") - F.col("t.y"))
    v2 = (F.col("e.vx") - F.col("t.vx")) * (F.col("e.vx") - F.col("t.vx")) + (F.col("e.vy") - F.col("t.vy")) * (F.col("e.vy") - F.col("t.vy"))
    near = e.join(t, F.col("e.frame_id") == F.col("t.frame_id")).where(d2 <= reach * reach).groupBy("e.frame_id", "e.track_id").agg(F.min(F.struct(d2.alias("d"), F.col("t.track_id").alias("i"), v2.alias("v"))).alias("m"))
    return near.groupBy("frame_id").agg(F.count(F.lit(1)).alias("tracks"), F.sqrt(F.avg("m.v")).alias("rmse"))


def state(pose: DataFrame, tracks: DataFrame, bounds: DataFrame, key: str, time: str) -> DataFrame:
    """One row for each key with the last pose, tracks and bounds (columns value and time), null where there is none."""
    out = None
    for name, table in (("pose", pose), ("tracks", tracks), ("bounds", bounds)):
        last = table.groupBy(key).agg(F.max_by("value", time).alias(name), F.max(time).alias(f"{name}_at"))
        out = last if out is None else out.join(last, key, "full")
    return out


def export_csv(summary: DataFrame, path: str) -> None:
    """A CSV file with a header whose nulls are empty."""
    summary.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def shares(counts: DataFrame, *columns: str) -> DataFrame:
    """counts with the percentage of each column in the sum of all of them; 0 where there is nothing."""
    total = sum((F.col(c) for c in columns), F.lit(0))
    return counts.withColumns({f"{c}_percent": F.coalesce(F.try_divide(100.0 * F.col(c), total), F.lit(0.0)) for c in columns})


#: Length and width that the viewer draws for a class without extent, metres.
FOOTPRINTS = {"vehicle": (4.2, 1.9), "animal": (1.2, 0.7), "pedestrian": (0.6, 0.6), "obstacle": (0.9, 0.9)}


def footprint(length: Column, width: Column, name: Column) -> tuple[Column, Column]:
    """Length and width, by class where they are missing or not positive."""
    out = []
    for k, given in enumerate((length, width)):
        usual = F.lit(FOOTPRINTS["obstacle"][k])
        for group, size in FOOTPRINTS.items():
            usual = F.when(class_group(name) == group, size[k]).otherwise(usual)
        out.append(F.when(given > 0, given).otherwise(usual))
    return out[0], out[1]


def detections(rows: DataFrame, column: str = "v") -> DataFrame:
    """Boxes from arrays of x, y, z, length, width, height, yaw and, if they are there, vx, vy; shorter ones go.

    Boxes need a positive extent and a place within 60 m ahead and behind and 40 m aside.
    """
    names = ("x", "y", "z", "length", "width", "height", "yaw", "vx", "vy")
    d = rows.where(F.size(column) >= 7).select("frame_id", *[F.try_element_at(column, F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(names)])
    return d.where((F.least("length", "width", "height") > 0) & F.col("x").between(-60, 60) & F.col("y").between(-40, 40))


def labels_of_pixels(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """points (with u, v) with the label of their pixel; by height where they have none."""
    from gridloom.operators.ground import height_label

    seen = pixels.select("frame_id", "v", "u", F.col("label").alias("_label"))
    return points.join(seen, ["frame_id", "v", "u"], "left").withColumn("label", F.coalesce("_label", height_label(F.col("z_mm")))).drop("_label")


def retained(memory: DataFrame, most: int = 15_000) -> DataFrame:
    """The cells of each sensor's terrain memory that stay: the most recently first seen (first, kx, ky)."""
    order = Window.partitionBy("sensor_id").orderBy(F.desc("first"), "kx", "ky")
    return memory.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


LOGS = {"system_health": HEALTH, "dynamic_tracks_history": TRACKS, "hazard_events": HAZARDS}


def log_rows(rows: DataFrame, log: str) -> DataFrame:
    """rows in the columns of a log, in order; columns that are absent are null, except that speed and heading of tracks
    come from the velocity."""
    if log == "dynamic_tracks_history":
        moving = {"speed": F.hypot("vel_x", "vel_y"), "heading": F.atan2("vel_y", "vel_x")}
        rows = rows.withColumns({c: v for c, v in moving.items() if c not in rows.columns})
    columns = [c.split() for c in LOGS[log].split(", ")]
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])
