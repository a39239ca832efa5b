"""Queries over clusters, tracks, state and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import cells, cluster, ground, health, telemetry as tm, track
from gridloom.plans.cell_queries import leaves_sql
from gridloom.plans import terrain_queries
from gridloom.plans.common import SMALL, TRACKS, P, greedy_sql, points, small, tracks
from gridloom.tables import Tables


def _micro(c, scale=1e6):
    return F.round(F.col(c) * scale).cast("bigint").alias(c)


def _obstacles(s, d):
    return cluster.region(ground.split(points(s, d)).where("NOT is_ground"))


def _few(s, d):
    return cluster.region(small(s, d))


def _micros(c):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def _events(s, d):
    """t: epoch seconds."""
    return s.read.parquet(f"{d}/events.parquet").withColumn("t", _micros("ts") / 1e6)


def _summaries(s, d):
    return cluster.summaries(cluster.bev_components(_obstacles(s, d)), least=3)


def _leaves(s, d):
    return cells.evaluate(cells.leaves(points(s, d)))


def detections(s, d):
    """Objects that drift, three a frame, of all events: 16 sensors with up to 1000 frames for each 16,000 events."""
    e = _events(s, d).select("event_id")
    e = e.select(F.expr("event_id div 16000 * 16 + event_id % 16").alias("sensor_id"), F.expr("event_id % 16000 div 16").alias("frame_id")).withColumn("det_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    f, k, n = F.col("frame_id").cast("double"), F.col("det_id").cast("double"), F.col("sensor_id").cast("double")
    wobble = F.pmod(F.col("frame_id") * 7 + F.col("det_id") * 3 + F.col("sensor_id"), F.lit(5)).cast("double") * 0.01
    return e.select("sensor_id", "frame_id", "det_id", (k * 6 - 5 + f * 0.1 * (k - 1) + n * 0.2 + wobble).alias("x"), (k * 2 + f * 0.05 - wobble).alias("y"), F.lit(4.0).alias("length"), F.lit(1.8).alias("width"), F.lit(1.5).alias("height"), F.lit("vehicle").alias("kind"))


def _tracks_seen(s, d):
    return track.track(detections(s, d)).select("sensor_id", "frame_id", "track_id", *[_micro(c, 1e4) for c in ("x", "y", "vx", "vy")], "hits", "misses")


def _rmse(s, d):
    key = F.struct("sensor_id", "frame_id").alias("frame_id")  # a frame of one sensor
    got = track.track(detections(s, d)).withColumn("frame_id", key)
    true = detections(s, d).select(key, F.col("det_id").alias("track_id"), "x", "y", ((F.col("det_id") - 1) * 1.0).alias("vx"), F.lit(0.5).alias("vy"))
    return tm.velocity_error(got, true).select("frame_id.sensor_id", "frame_id.frame_id", "tracks", _micro("rmse", 1e4))


def _terrain(s, d):
    p = points(s, d).select((F.col("frame_id") % 2).alias("sensor_id"), "frame_id", F.rint(F.col("x_mm") / 100).cast("bigint").alias("kx"), F.rint(F.col("y_mm") / 100).cast("bigint").alias("ky"), "z_mm")
    c = p.groupBy("sensor_id", "kx", "ky", "frame_id").agg((F.min("z_mm") / 1000.0).alias("z"))
    return health.terrain_blend(c).select("sensor_id", "kx", "ky", "n", _micro("z", 1e5), _micro("p", 1e7))


def _quadrants(s, d):
    return health.quadrant_counts(points(s, d)).withColumn("sensor_id", F.expr("frame_id div 8"))


def _ghosts(s, d):
    from gridloom.operators.spatial import centres

    l = centres(_leaves(s, d)).withColumn("x", F.col("x_mm") / 1000).withColumn("y", F.col("y_mm") / 1000)
    t = tracks(s, d)
    return health.cleared(l, t).select("frame_id", "size_mm", "gx", "gy", "cost")


def _degraded(s, d):
    from gridloom.operators.spatial import centres

    bad = points(s, d).select("frame_id").distinct().select("frame_id", F.when(F.col("frame_id") % 2 == 0, "FRONT_LEFT").otherwise("FRONT_RIGHT").alias("quadrants"))
    return health.inflated(centres(_leaves(s, d)), bad).select("frame_id", "size_mm", "gx", "gy", "cost")


def _boxes(s, d):
    """A hundred boxes a frame, of all events: 20 frames for each 2000."""
    e = _events(s, d)
    i = F.col("event_id")
    return e.select(F.expr("event_id div 2000 * 20 + event_id % 20").alias("frame_id"), i.alias("box_id"), ((i * 37 % 100) / 10.0).alias("x"), ((i * 53 % 100) / 10.0).alias("y"), (3 + i % 3).cast("double").alias("length"), (1.5 + (i % 2) * 0.5).alias("width"), ((i % 8) * 0.4).alias("yaw"), ((i * 7919) % 10_007 / 10_007.0).alias("score"), (i % 3).cast("int").alias("class"))


def _recording(s, d):
    return _events(s, d).select("user_id", F.col("event_id").alias("frame"), (F.floor(_micros("ts") / 1000) - 1_704_067_200_000).alias("elapsed_ms"))


def _validated(s, d):
    from gridloom.operators.telemetry import frames, parsed

    made = frames(_leaves(s, d), tracks(s, d), 200)
    bad = made.select("frame_id", F.regexp_replace("frame", '"cost":0', '"cost":-7').alias("frame"))
    return parsed(made.unionByName(bad), "frame").groupBy("ok").agg(F.count(F.lit(1)).alias("frames"))


_PILLAR = ["frame_id", "point_idx", "px", "py"]
QUERIES = {
    "bev_components": lambda s, d: cluster.bev_components(_few(s, d)).select("frame_id", "point_idx", "label"),
    "cluster_summary": lambda s, d: _summaries(s, d).select("frame_id", "n", "i_sum", "x_lo", "x_hi", "y_lo", "y_hi", "z_lo", "z_hi", "x_sum", "y_sum", "z_sum", "kind"),
    "dbscan_small": lambda s, d: cluster.dbscan(_few(s, d), 2000, 3).select("frame_id", "point_idx", "label"),
    "clusters_by_size": lambda s, d: cluster.clustered(small(s, d), 20).groupBy("frame_id").agg(F.count_distinct("label").alias("clusters"), F.count(F.lit(1)).alias("points")),
    "cluster_merge": lambda s, d: cluster.merged_summaries(_summaries(s, d)),
    "porosity": lambda s, d: cluster.porosity(points(s, d).withColumn("label", F.expr("(x_mm + 8000) div 1000 * 8 + (y_mm + 4000) div 1000"))),
    "bev_nms": lambda s, d: cluster.suppress(_boxes(s, d)).select("frame_id", "class", "box_id"),
    "pillar_stats": lambda s, d: cluster.pillars(points(s, d)).select(*_PILLAR, _micro("mean_x", 10), _micro("mean_z", 10), (F.col("from_x") * 2).cast("bigint").alias("from_x2")),
    "track_step": _tracks_seen,
    "velocity_rmse": _rmse,
    "terrain_blend": _terrain,
    "quadrant_counts": lambda s, d: health.quadrant_counts(points(s, d)),
    "quadrant_health": lambda s, d: health.quadrant_health(_quadrants(s, d), "sensor_id").select("frame_id", "is_degraded", "quadrants", _micro("front_right", 1e4), _micro("front_left", 1e4)),
    "ghost_clear": _ghosts,
    "degraded_inflation": _degraded,
    "payload_cells_capped": lambda s, d: tm.capped(_leaves(s, d), 60).select("frame_id", "size_mm", "gx", "gy", "cost"),
    "served_leaves": lambda s, d: tm.served(_leaves(s, d)).select("frame_id", "size_mm", "gx", "gy", "cost", "band", "color"),
    "raw_points_stride": lambda s, d: tm.raw_points(points(s, d), 200).select("frame_id", F.size("xyz").alias("size"), F.element_at("xyz", 1).alias("x0"), F.element_at("xyz", -1).alias("z1"), F.aggregate("xyz", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total")),
    "telemetry_frame": lambda s, d: tm.frames(_leaves(s, d), tracks(s, d), 50),
    "frame_validation": _validated,
    "frame_summary": lambda s, d: tm.frame_summary(_leaves(s, d)).withColumn("safe_ratio", F.round(F.col("safe_ratio") * 1e6).cast("bigint")),
    "visible_cells": lambda s, d: tm.visible(_leaves(s, d), -2000, 0).groupBy("frame_id").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.round(F.col("hue") * 1e6).cast("bigint")).alias("hue")),
    "sweep_box": lambda s, d: tm.sweep_box(points(s, d)),
    "stage_p95": lambda s, d: tm.stage_latency(_events(s, d), "event_type", "value").select("event_type", "n", _micro("mean"), _micro("least"), _micro("greatest"), _micro("p95")),
    "latest_state": lambda s, d: tm.latest(_events(s, d), "user_id", "ts", "event_id", "event_type", "value").select("user_id", "event_id", "event_type", "value"),
    "ring_buffer_100": lambda s, d: tm.ring(_events(s, d).select("event_id", "ts", "user_id", "event_type"), "ts", "event_id"),
    "ema_latency": lambda s, d: tm.ema(_events(s, d), "event_type", ["ts", "event_id"], "value").select("event_type", _micro("ema", 1e4)),
    "history_means": lambda s, d: tm.history_means(_events(s, d), "event_type", "value").select("event_type", _micro("mean_value"), _micro("max_value")),
    "replay_delays": lambda s, d: tm.replay_delays(_recording(s, d), "user_id", 2.0).select("user_id", "frame", "delay_ms"),
    "recording_check": lambda s, d: tm.recording_problems(_recording(s, d), "user_id"),
    "throttled_1hz": lambda s, d: tm.throttled(_events(s, d), "user_id", "t", "event_id", 86_400.0),
    "stale_gaps": lambda s, d: tm.stale_gaps(_events(s, d), "user_id", "t", "event_id", 3 * 86_400.0).select("user_id", F.round(F.col("seconds") * 1000).cast("bigint").alias("ms")),
    "health_rollup": lambda s, d: tm.health_rollup(_events(s, d), "ts", "value", "1 day").select("n", _micro("mean"), _micro("greatest"), (_micros("start") / 1000).cast("bigint").alias("start_ms")),
    "hazard_rollup": lambda s, d: _events(s, d).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("worst")).select("event_type", "user_id", "n", _micro("worst")),
    "timestamp_forms": lambda s, d: _events(s, d).select("event_id", F.round(tm.milliseconds(F.col("t"))).cast("bigint").alias("ms"), tm.stamp(F.col("t"))["sec"].alias("sec")),
}

_SIDE = lambda a, b, m: f"({b}x[{m % 4 + 1}] - {b}x[{m}]) * ({a}y[k] - {b}y[{m}]) - ({b}y[{m % 4 + 1}] - {b}y[{m}]) * ({a}x[k] - {b}x[{m}]) >= -1e-9"
_INSIDE = lambda a, b: " AND ".join(_SIDE(a, b, m) for m in (1, 2, 3, 4))
_CORNERS = lambda c: "[" + ", ".join(f"{c} + {'c' if c == 'x' else 's'} * ({i}) * length / 2 {'- s' if c == 'x' else '+ c'} * ({j}) * width / 2" for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1))) + "]"
_NMS = f"""b0 AS (SELECT event_id // 2000 * 20 + event_id % 20 AS frame_id, event_id AS box_id, (event_id * 37 % 100) / 10.0::DOUBLE AS x, (event_id * 53 % 100) / 10.0::DOUBLE AS y, (3 + event_id % 3)::DOUBLE AS length,
    1.5::DOUBLE + (event_id % 2) * 0.5::DOUBLE AS width, (event_id % 8) * 0.4::DOUBLE AS yaw, (event_id * 7919) % 10007 / 10007.0::DOUBLE AS score, (event_id % 3)::INTEGER AS class FROM events),
  b1 AS (SELECT *, cos(yaw) AS c, sin(yaw) AS s, row_number() OVER (PARTITION BY frame_id, class ORDER BY score DESC, box_id) AS r FROM b0),
  b2 AS (SELECT frame_id, class, box_id, r, x, y, length * width AS area, sqrt(length * length + width * width) / 2 AS reach, {_CORNERS('x')} AS px, {_CORNERS('y')} AS py FROM b1 WHERE r <= 1000),
  pr AS (SELECT a.frame_id, a.class, a.r AS better, b.r AS worse, a.area + b.area AS areas, a.px AS ax, a.py AS ay, b.px AS gx, b.py AS gy FROM b2 a JOIN b2 b ON a.frame_id = b.frame_id AND a.class = b.class AND a.r < b.r
    AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < a.reach + b.reach),
  cr AS (SELECT *, ax[k] AS x1, ay[k] AS y1, ax[k % 4 + 1] - ax[k] AS dx, ay[k % 4 + 1] - ay[k] AS dy, gx[m] AS x2, gy[m] AS y2, gx[m % 4 + 1] - gx[m] AS ex, gy[m % 4 + 1] - gy[m] AS ey FROM pr, range(1, 5) t(k), range(1, 5) u(m)),
  pt AS (SELECT frame_id, class, better, worse, areas, ax[k] AS qx, ay[k] AS qy FROM pr, range(1, 5) t(k) WHERE {_INSIDE('a', 'g')}
    UNION ALL SELECT frame_id, class, better, worse, areas, gx[k], gy[k] FROM pr, range(1, 5) t(k) WHERE {_INSIDE('g', 'a')}
    UNION ALL SELECT frame_id, class, better, worse, areas, x1 + ((x2 - x1) * ey - (y2 - y1) * ex) / (dx * ey - dy * ex) * dx, y1 + ((x2 - x1) * ey - (y2 - y1) * ex) / (dx * ey - dy * ex) * dy FROM cr
      WHERE abs(dx * ey - dy * ex) > 1e-9 AND ((x2 - x1) * ey - (y2 - y1) * ex) / (dx * ey - dy * ex) BETWEEN 0 AND 1 AND ((x2 - x1) * dy - (y2 - y1) * dx) / (dx * ey - dy * ex) BETWEEN 0 AND 1),
  md AS (SELECT *, qx - avg(qx) OVER w AS vx, qy - avg(qy) OVER w AS vy FROM pt WINDOW w AS (PARTITION BY frame_id, class, better, worse)),
  tn AS (SELECT *, coalesce(lead(vx) OVER w, first_value(vx) OVER w) AS nx, coalesce(lead(vy) OVER w, first_value(vy) OVER w) AS ny FROM md WINDOW w AS (PARTITION BY frame_id, class, better, worse ORDER BY atan2(vy, vx), vx, vy)),
  ar AS (SELECT frame_id, class, better, worse, any_value(areas) AS areas, CASE WHEN count(*) >= 3 THEN abs(sum(vx * ny - vy * nx)) / 2 ELSE 0 END AS shared FROM tn GROUP BY 1, 2, 3, 4),
  ed AS (SELECT frame_id, class, better, worse FROM ar WHERE areas - shared > 0 AND shared > (0.2::DOUBLE + 1e-9::DOUBLE) * (areas - shared))"""
_REGION = "x_mm BETWEEN -25000 AND 55000 AND y_mm BETWEEN -20000 AND 20000 AND z_mm BETWEEN -2200 AND 2500"
_SUMMED = f"WITH {P}, {leaves_sql()}"
ORACLE = {
    "bev_nms": f"""WITH RECURSIVE {_NMS}, {greedy_sql('ed', 'frame_id, class')},
      kp AS (SELECT b2.frame_id, b2.class, box_id, row_number() OVER (PARTITION BY b2.frame_id, b2.class ORDER BY r) AS k FROM b2 ANTI JOIN gone ON gone.frame_id = b2.frame_id AND gone.class = b2.class AND gone.worse = b2.r)
      SELECT frame_id, class, box_id FROM kp WHERE k <= 83""",
    "bev_components": f"""WITH RECURSIVE {SMALL}, r AS (SELECT *, floor(x_mm / 350.0::DOUBLE)::BIGINT AS cx, floor(y_mm / 350.0::DOUBLE)::BIGINT AS cy FROM p WHERE {_REGION}), c AS (SELECT DISTINCT frame_id, cx, cy FROM r),
      reach AS (SELECT frame_id, cx, cy, cy AS ry, cx AS rx FROM c UNION SELECT c.frame_id, c.cx, c.cy, ry, rx FROM reach JOIN c ON c.frame_id = reach.frame_id AND abs(c.cx - reach.cx) <= 1 AND abs(c.cy - reach.cy) <= 1),
      top AS (SELECT frame_id, cx, cy, min((ry, rx)) AS root FROM reach GROUP BY 1, 2, 3), num AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY root) - 1 AS label FROM top)
      SELECT r.frame_id, r.point_idx, num.label FROM r JOIN num USING (frame_id, cx, cy)""",
    "porosity": f"""WITH {P}, c AS (SELECT frame_id, (x_mm + 8000) // 1000 * 8 + (y_mm + 4000) // 1000 AS label, count(*) AS n, max(z_mm) - min(z_mm) AS dz, sum(i_pct) AS i,
        (count(*) * sum(x_mm * x_mm) - sum(x_mm) * sum(x_mm))::DOUBLE / count(*) ** 2 / 1e6 + (count(*) * sum(y_mm * y_mm) - sum(y_mm) * sum(y_mm))::DOUBLE / count(*) ** 2 / 1e6 AS spread,
        (count(*) * sum(z_mm * z_mm) - sum(z_mm) * sum(z_mm))::DOUBLE / count(*) ** 2 / 1e6 AS vz FROM p GROUP BY 1, 2),
      e AS (SELECT *, CASE WHEN n < 3 THEN dz BETWEEN 150 AND 1300 WHEN NOT dz BETWEEN 150 AND 1300 OR i >= 75 * n THEN false WHEN i <= 60 * n THEN true ELSE spread > 0.02 AND vz > 0.005 END AS is_porous FROM c)
      SELECT frame_id, label, n, dz, is_porous, CASE WHEN is_porous THEN 20 ELSE 255 END AS cost FROM e""",
    "pillar_stats": f"""WITH {P}, a AS (SELECT *, floor((x_mm + 51200) / 200.0::DOUBLE)::BIGINT AS px, floor((y_mm + 51200) / 200.0::DOUBLE)::BIGINT AS py FROM p WHERE x_mm BETWEEN -51200 AND 51199 AND y_mm BETWEEN -51200 AND 51199 AND z_mm BETWEEN -5000 AND 3000),
      b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY frame_id, py, px ORDER BY point_idx) <= 20), c AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY py, px) AS k FROM b)
      SELECT frame_id, point_idx, px, py, round(avg(x_mm) OVER w * 10)::BIGINT AS mean_x, round(avg(z_mm) OVER w * 10)::BIGINT AS mean_z, ((x_mm - (px * 200 + 100.0::DOUBLE - 51200)) * 2)::BIGINT AS from_x2 FROM c WHERE k <= 30000 WINDOW w AS (PARTITION BY frame_id, py, px)""",
    "terrain_blend": f"""WITH RECURSIVE {P}, o AS (SELECT frame_id % 2 AS sensor_id, round_even(x_mm / 100.0::DOUBLE, 0)::BIGINT AS kx, round_even(y_mm / 100.0::DOUBLE, 0)::BIGINT AS ky, frame_id, min(z_mm) / 1000.0::DOUBLE AS z FROM p GROUP BY 1, 2, 3, 4),
      q AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, kx, ky ORDER BY frame_id) AS k, count(*) OVER (PARTITION BY sensor_id, kx, ky) AS n FROM o),
      f AS (SELECT sensor_id, kx, ky, n, k, z, 0.005::DOUBLE AS p FROM q WHERE k = 1 UNION ALL
            SELECT f.sensor_id, f.kx, f.ky, f.n, q.k, f.z + f.p / (f.p + 0.0025::DOUBLE) * (q.z - f.z), (1 - f.p / (f.p + 0.0025::DOUBLE)) * f.p + 0.002::DOUBLE FROM f JOIN q ON q.sensor_id = f.sensor_id AND q.kx = f.kx AND q.ky = f.ky AND q.k = f.k + 1)
      SELECT sensor_id, kx, ky, n, round(z * 1e5)::BIGINT AS z, round(p * 1e7)::BIGINT AS p FROM f WHERE k = n""",
    "quadrant_counts": f"""WITH {P} SELECT frame_id, count(*) FILTER ((y_mm >= 0 AND x_mm > 0) OR (x_mm = 0 AND y_mm = 0)) AS q0, count(*) FILTER ((y_mm > 0 AND x_mm <= 0) OR (y_mm = 0 AND x_mm < 0)) AS q1,
      count(*) FILTER (y_mm < 0 AND x_mm < 0) AS q2, count(*) FILTER (y_mm < 0 AND x_mm >= 0) AS q3 FROM p GROUP BY 1""",
    "quadrant_health": f"""WITH RECURSIVE {P}, c AS (SELECT frame_id, frame_id // 8 AS sensor, count(*) AS n, count(*) FILTER ((y_mm >= 0 AND x_mm > 0) OR (x_mm = 0 AND y_mm = 0)) AS a, count(*) FILTER ((y_mm > 0 AND x_mm <= 0) OR (y_mm = 0 AND x_mm < 0)) AS b FROM p GROUP BY 1),
      k AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY frame_id) AS i FROM c),
      f AS (SELECT sensor, i, frame_id, a, b, n > 80 AS on_, CASE WHEN n > 80 THEN a::DOUBLE ELSE 0 END AS ea, CASE WHEN n > 80 THEN b::DOUBLE ELSE 0 END AS eb FROM k WHERE i = 1 UNION ALL
            SELECT k.sensor, k.i, k.frame_id, k.a, k.b, on_ OR k.n > 80, CASE WHEN on_ THEN 0.92::DOUBLE * ea + 0.08::DOUBLE * k.a WHEN k.n > 80 THEN k.a ELSE 0 END, CASE WHEN on_ THEN 0.92::DOUBLE * eb + 0.08::DOUBLE * k.b WHEN k.n > 80 THEN k.b ELSE 0 END FROM f JOIN k ON k.sensor = f.sensor AND k.i = f.i + 1),
      g AS (SELECT *, on_ AND ea >= 80 AND a < 0.15 * ea AS wa, on_ AND eb >= 80 AND b < 0.15 * eb AS wb FROM f)
      SELECT frame_id, wa OR wb AS is_degraded, concat_ws(',', CASE WHEN wa THEN 'FRONT_RIGHT' END, CASE WHEN wb THEN 'FRONT_LEFT' END) AS quadrants, round(ea * 1e4)::BIGINT AS front_right, round(eb * 1e4)::BIGINT AS front_left FROM g""",
    "degraded_inflation": f"""{_SUMMED}, cc AS (SELECT *, -40000 + (gx + 0.5::DOUBLE) * size_mm AS x, -35000 + (gy + 0.5::DOUBLE) * size_mm AS y FROM ev),
      ff AS (SELECT frame_id, CASE WHEN (frame_id % 2 = 1 AND x > 0 AND y >= 0) OR (frame_id % 2 = 0 AND x <= 0 AND y > 0) THEN greatest(cost, 180) ELSE cost END AS cost, size_mm, gx, gy FROM cc) SELECT frame_id, size_mm, gx, gy, cost FROM ff""",
    "payload_cells_capped": f"""{_SUMMED}, a AS (SELECT *, cost = 0 AS free, count(*) FILTER (cost = 0) OVER w AS nf, count(*) FILTER (cost <> 0) OVER w AS nh FROM ev WINDOW w AS (PARTITION BY frame_id)),
      b AS (SELECT *, least(nh, greatest(0, 60 - least(nf, 30))) AS high FROM a), cc AS (SELECT *, CASE WHEN nf + nh <= 60 THEN 60 WHEN free THEN greatest(0, 60 - high) ELSE high END AS m, CASE WHEN free THEN nf ELSE nh END AS c,
      row_number() OVER (PARTITION BY frame_id, free ORDER BY size_mm, gy, gx) - 1 AS r FROM b)
      SELECT frame_id, size_mm, gx, gy, cost FROM cc WHERE c <= m OR (m = 1 AND r = 0) OR (m > 1 AND EXISTS (SELECT 1 FROM range(0, 60) t(i) WHERE i < m AND floor(i * (c - 1) / (m - 1)::DOUBLE) = r))""",
    "served_leaves": f"""{_SUMMED}, a AS (SELECT frame_id, size_mm, gx, gy, CASE WHEN cost <> 100 AND mean_z BETWEEN -2200 AND -1250 AND dz <= 180 AND z_max <= -1150 THEN 0 ELSE cost END AS cost FROM ev)
      SELECT frame_id, size_mm, gx, gy, cost, CASE WHEN cost <= 50 THEN 'safe' WHEN cost <= 180 THEN 'caution' ELSE 'lethal' END AS band, CASE WHEN cost <= 50 THEN 'green' WHEN cost <= 180 THEN 'yellow' ELSE 'red' END AS color FROM a""",
    "raw_points_stride": f"""WITH {P}, a AS (SELECT *, greatest(count(*) OVER (PARTITION BY frame_id) // 200, 1) AS s, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS r FROM p)
      SELECT frame_id, (count(*) * 3)::INTEGER AS size, arg_min(x_mm, r) AS x0, arg_max(z_mm, r) AS z1, sum(x_mm + y_mm + z_mm)::BIGINT AS total FROM a WHERE r % s = 0 GROUP BY 1""",
    "frame_summary": f"""{_SUMMED} SELECT frame_id, count(*) AS cells, count(*) FILTER (cost <= 50) AS safe, count(*) FILTER (cost > 50 AND cost <= 180) AS caution, count(*) FILTER (cost > 180) AS lethal, count(*) FILTER (cost < 50) AS strictly_safe,
      min(z_min) AS z_min, max(z_max) AS z_max, round(count(*) FILTER (cost <= 50) / count(*)::DOUBLE * 1e6)::BIGINT AS safe_ratio FROM ev GROUP BY 1""",
    "visible_cells": f"""{_SUMMED} SELECT frame_id, count(*) AS cells, sum(round(0.66::DOUBLE * (1 - least(greatest((mean_z / 1000 + 2) / 3.5::DOUBLE, 0), 1)) * 1e6)::BIGINT)::BIGINT AS hue FROM ev WHERE z_min BETWEEN -2000 AND 0 GROUP BY 1""",
    "sweep_box": f"WITH {P} SELECT frame_id, min(x_mm) + max(x_mm) AS centre2_x, max(x_mm) - min(x_mm) AS size_x, min(y_mm) + max(y_mm) AS centre2_y, max(y_mm) - min(y_mm) AS size_y, min(z_mm) + max(z_mm) AS centre2_z, max(z_mm) - min(z_mm) AS size_z FROM p GROUP BY 1",
    "stage_p95": "SELECT event_type, count(value) AS n, round(avg(value) * 1e6)::BIGINT AS mean, round(min(value) * 1e6)::BIGINT AS least, round(max(value) * 1e6)::BIGINT AS greatest, round(quantile_cont(value, 0.95) * 1e6)::BIGINT AS p95 FROM events GROUP BY 1",
    "latest_state": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "ring_buffer_100": "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "ema_latency": """WITH k AS (SELECT event_type, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
      SELECT event_type, round(sum(value * CASE WHEN i = 1 THEN power(0.8::DOUBLE, n - 1) ELSE 0.2::DOUBLE * power(0.8::DOUBLE, n - i) END) * 1e4)::BIGINT AS ema FROM k GROUP BY 1""",
    "history_means": "SELECT event_type, round(avg(value) * 1e6)::BIGINT AS mean_value, round(max(value) * 1e6)::BIGINT AS max_value FROM events GROUP BY 1",
    "replay_delays": """WITH r AS (SELECT user_id, event_id AS frame, floor(epoch_us(ts) / 1000.0::DOUBLE)::BIGINT - 1704067200000 AS e FROM events)
      SELECT user_id, frame, greatest(16.0::DOUBLE, (lead(e) OVER w - e) / 2.0::DOUBLE) AS delay_ms FROM r WINDOW w AS (PARTITION BY user_id ORDER BY e, frame)""",
    "recording_check": """WITH r AS (SELECT user_id, event_id AS frame, floor(epoch_us(ts) / 1000.0::DOUBLE)::BIGINT - 1704067200000 AS e FROM events), b AS (SELECT *, e < lag(e) OVER (PARTITION BY user_id ORDER BY frame) AS back FROM r)
      SELECT user_id, count(*) AS frames, count(*) FILTER (back) AS back, count(*) FILTER (NOT e BETWEEN 0 AND 86400000) AS outside, count(*) BETWEEN 1 AND 600 AND count(*) FILTER (back) = 0 AND count(*) FILTER (NOT e BETWEEN 0 AND 86400000) = 0 AS ok FROM b GROUP BY 1""",
    "throttled_1hz": """WITH RECURSIVE k AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT user_id, event_id, t, i, true AS taken, t AS last FROM k WHERE i = 1 UNION ALL SELECT k.user_id, k.event_id, k.t, k.i, k.t >= f.last + 86400, CASE WHEN k.t >= f.last + 86400 THEN k.t ELSE f.last END FROM f JOIN k ON k.user_id = f.user_id AND k.i = f.i + 1)
      SELECT user_id, event_id FROM f WHERE taken""",
    "stale_gaps": "WITH g AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS s FROM events) SELECT user_id, round(s * 1000)::BIGINT AS ms FROM g WHERE s > 259200",
    "health_rollup": "SELECT count(*) AS n, round(avg(value) * 1e6)::BIGINT AS mean, round(max(value) * 1e6)::BIGINT AS greatest, epoch_ms(date_trunc('day', ts)) AS start_ms FROM events GROUP BY 4",
    "hazard_rollup": "SELECT event_type, user_id, count(*) AS n, round(max(value) * 1e6)::BIGINT AS worst FROM events GROUP BY 1, 2",
    "timestamp_forms": "SELECT event_id, round(epoch_us(ts) / 1e6 * 1000)::BIGINT AS ms, floor(epoch_us(ts) / 1e6)::BIGINT AS sec FROM events",
}


def _pipeline(s, d):
    from gridloom.plans.pipeline import process

    return process(points(s, d)).statistics


QUERIES["process_frames"] = _pipeline


def _state(s, d):
    e = _events(s, d)
    part = lambda kind: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("at"), F.round(F.col("value") * 1e6).cast("bigint").alias("value"))
    return tm.state(part("view"), part("click"), part("error"), "user_id", "at")


def _pixels(s, d):
    p = ground.spherical(points(s, d).withColumns({"x_mm": F.col("x_mm") * 7, "y_mm": F.col("y_mm") * 7}))
    seen = ground.range_image(points(s, d).withColumns({"x_mm": F.col("x_mm") * 7, "y_mm": F.col("y_mm") * 7})).where("u % 3 = 0").select("frame_id", "v", "u", F.lit(3).alias("label"))
    return tm.labels_of_pixels(p, seen).groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("points"))


def _arrays(s, d):
    i = F.col("event_id")
    v = F.array(*[c.cast("double") for c in (i % 140 - 70, i % 90 - 45, F.lit(0), i % 5, F.lit(2), F.lit(1), F.lit(0))])
    return tm.detections(_events(s, d).select((i % 10).alias("frame_id"), F.when(i % 7 == 0, F.slice(v, 1, 5)).otherwise(v).alias("v"))).groupBy("frame_id").agg(F.count(F.lit(1)).alias("boxes"), F.sum("x").alias("sum_x"))


QUERIES |= {
    "merged_state": _state,
    "pixel_labels": _pixels,
    "detections_from_arrays": _arrays,
    "band_percent": lambda s, d: tm.shares(cells.band_counts(_leaves(s, d)), "safe", "caution", "lethal").select("frame_id", _micro("safe_percent"), _micro("caution_percent"), _micro("lethal_percent")),
}
ORACLE |= {
    "merged_state": """WITH e AS (SELECT user_id, event_type, event_id AS k, round(value * 1e6)::BIGINT AS v FROM events WHERE event_type IN ('view', 'click', 'error'))
      SELECT user_id, arg_max(v, k) FILTER (event_type = 'view') AS pose, max(k) FILTER (event_type = 'view') AS pose_at, arg_max(v, k) FILTER (event_type = 'click') AS tracks, max(k) FILTER (event_type = 'click') AS tracks_at,
      arg_max(v, k) FILTER (event_type = 'error') AS bounds, max(k) FILTER (event_type = 'error') AS bounds_at FROM e GROUP BY 1""",
    "detections_from_arrays": """SELECT event_id % 10 AS frame_id, count(*) AS boxes, sum((event_id % 140 - 70)::DOUBLE) AS sum_x FROM events WHERE event_id % 7 <> 0 AND event_id % 5 > 0
      AND event_id % 140 - 70 BETWEEN -60 AND 60 AND event_id % 90 - 45 BETWEEN -40 AND 40 GROUP BY 1""",
    "band_percent": f"""{_SUMMED} SELECT frame_id, round(100.0::DOUBLE * count(*) FILTER (cost <= 50) / count(*) * 1e6)::BIGINT AS safe_percent, round(100.0::DOUBLE * count(*) FILTER (cost > 50 AND cost <= 180) / count(*) * 1e6)::BIGINT AS caution_percent,
      round(100.0::DOUBLE * count(*) FILTER (cost > 180) / count(*) * 1e6)::BIGINT AS lethal_percent FROM ev GROUP BY 1""",
}


def _whole(s, d):
    """Documents of points(), leaves and tracks(), with no other objects. Points are told from the ground once, and written."""
    from gridloom.operators import hazards
    from gridloom.operators.spatial import centres

    split = ground.split(points(s, d))
    split = Tables(split, "documents").save(split, "points")
    own, leaves, moving = split.drop("is_ground"), cells.evaluate(cells.leaves(split.drop("is_ground"))), tracks(s, d, split)
    found = cluster.summaries(cluster.bev_components(cluster.region(split.where("NOT is_ground"))), least=3)
    none = s.createDataFrame([], "frame_id bigint, kind string")
    state = s.createDataFrame([], "frame_id bigint, is_degraded boolean, quadrants string")
    statistics = tm.frame_statistics(split, leaves, moving, none, none, none, state)
    objects = tm.sent_objects(moving, hazards.cones(moving), cluster.merged_summaries(found))
    return tm.documents(centres(leaves), objects, statistics, own, 100_000, 300)


def _document_cells(s, d):
    """Cells of the parsed documents, by field, in hundredths."""
    cell = _whole(s, d).select("frame_id", F.explode(F.from_json("document", tm.DOCUMENT)["cells"]).alias("c")).select("frame_id", "c.*")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").alias(c)
    return cell.select("frame_id", *[cents(c) for c in ("x", "y", "z_min", "z_max", "size", "delta_z")], "cost", "semantic_cost", "observed", "pts", F.round(F.col("slope") * 10).cast("bigint").alias("slope"))


def _document_objects(s, d):
    own = _whole(s, d).select("frame_id", F.explode(F.from_json("document", tm.DOCUMENT)["dynamic_objects"]).alias("o")).select("frame_id", "o.*")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").alias(c)
    return own.where("NOT stationary").select("frame_id", "id", "class", *[cents(c) for c in ("x", "y", "vx", "vy")], F.size("hazard_cones").alias("cones"), F.size("bbox").alias("bbox"), F.round(F.element_at("dimensions", 1) * 100).cast("bigint").alias("length"))


def _document_statistics(s, d):
    """Statistics of the parsed documents, and the length and sum of their points in millimetres."""
    names = ("point_count", "cell_count", "active_cells", "safe_cells", "caution_cells", "hazard_cells", "coarse_cells", "fine_cells", "active_tracks", "dynamic_tracks", "parked_cars", "thin_hazards")
    schema = f"system_status string, system_stats struct<{', '.join(f'{c}: bigint' for c in names)}, mapping_accuracy: double, mapping_memory_target_status: string>, raw_points array<double>"
    f = _whole(s, d).select("frame_id", F.from_json("document", schema).alias("f")).select("frame_id", "f.*")
    total = F.aggregate(F.transform("raw_points", lambda v: F.round(v * 1000).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return f.select("frame_id", "system_status", *[f"system_stats.{c}" for c in names], F.round(F.col("system_stats.mapping_accuracy") * 10).cast("bigint").alias("accuracy10"), F.col("system_stats.mapping_memory_target_status").alias("memory"), F.size("raw_points").alias("raw"), total.alias("raw_total"))


QUERIES |= {"document_cells": _document_cells, "document_objects": _document_objects, "document_statistics": _document_statistics}
_CENTS = lambda c: f"round_even({c} / 10.0::DOUBLE, 0)::BIGINT"
ORACLE |= {
    "document_cells": f"""{_SUMMED}, a AS (SELECT *, -40000 + (gx + 0.5::DOUBLE) * size_mm AS x_mm, -35000 + (gy + 0.5::DOUBLE) * size_mm AS y_mm FROM ev),
      b AS (SELECT *, CASE WHEN cost = 100 THEN 100 WHEN mean_z BETWEEN -2200 AND -1250 AND dz <= 180 AND z_max <= -1150 THEN 0
            ELSE greatest(CASE WHEN cost > 0 THEN cost WHEN dz > 250 OR z_max > -1150 THEN 255 ELSE 0 END, cost, 0) END AS sent FROM a)
      SELECT frame_id, {_CENTS('x_mm')} AS x, {_CENTS('y_mm')} AS y, {_CENTS('z_min')} AS z_min, {_CENTS('z_max')} AS z_max, {_CENTS('size_mm')} AS size, {_CENTS('dz')} AS delta_z, sent::INTEGER AS cost, sent::INTEGER AS semantic_cost,
        true AS observed, n AS pts, round(round_even(CASE WHEN dz > 10 THEN degrees(atan2(dz::DOUBLE, size_mm::DOUBLE)) ELSE 0 END, 1) * 10)::BIGINT AS slope FROM b""",
    "document_objects": f"""WITH {P}, {TRACKS} SELECT frame_id, track_id::BIGINT AS id, 'vehicle' AS class, round(round_even(x, 2) * 100)::BIGINT AS x, round(round_even(y, 2) * 100)::BIGINT AS y, round(round_even(vx, 2) * 100)::BIGINT AS vx,
      round(round_even(vy, 2) * 100)::BIGINT AS vy, CASE WHEN is_dynamic THEN 3 ELSE 0 END AS cones, 6 AS bbox, round(length * 100)::BIGINT AS length FROM t WHERE is_dynamic OR sqrt(vx * vx + vy * vy) >= 0.15""",
}

_SENT = f"""a AS (SELECT *, cost <> 100 AND mean_z BETWEEN -2200 AND -1250 AND dz <= 180 AND z_max <= -1150 AS road FROM ev), sv AS (SELECT * REPLACE (CASE WHEN road THEN 0 ELSE cost END AS cost) FROM a)"""
_CAPPED = lambda most: f"""{_SENT}, ca AS (SELECT *, cost = 0 AS free, count(*) FILTER (cost = 0) OVER w AS nf, count(*) FILTER (cost <> 0) OVER w AS nh FROM sv WINDOW w AS (PARTITION BY frame_id)),
      cb AS (SELECT *, least(nh, greatest(0, {most} - least(nf, {most // 2}))) AS high FROM ca), cd AS (SELECT *, CASE WHEN nf + nh <= {most} THEN {most} WHEN free THEN greatest(0, {most} - high) ELSE high END AS m, CASE WHEN free THEN nf ELSE nh END AS c,
      row_number() OVER (PARTITION BY frame_id, free ORDER BY size_mm, gy, gx) - 1 AS r FROM cb),
      cp AS (SELECT * FROM cd WHERE c <= m OR (m = 1 AND r = 0) OR (m > 1 AND EXISTS (SELECT 1 FROM range(0, {most}) t(i) WHERE i < m AND floor(i * (c - 1) / (m - 1)::DOUBLE) = r)))"""  # noqa: E731
#: The components of obstacle cells, their summaries and objects.
_CLUSTERS = f"""{terrain_queries._GROUND}, rg AS (SELECT *, floor(x_mm / 350.0::DOUBLE)::BIGINT AS cx, floor(y_mm / 350.0::DOUBLE)::BIGINT AS cy FROM gs WHERE NOT is_ground AND {_REGION}), cc AS (SELECT DISTINCT frame_id, cx, cy FROM rg),
      reach AS (SELECT frame_id, cx, cy, cy AS ry, cx AS rx FROM cc UNION SELECT cc.frame_id, cc.cx, cc.cy, ry, rx FROM reach JOIN cc ON cc.frame_id = reach.frame_id AND abs(cc.cx - reach.cx) <= 1 AND abs(cc.cy - reach.cy) <= 1),
      tp AS (SELECT frame_id, cx, cy, min((ry, rx)) AS root FROM reach GROUP BY 1, 2, 3), nu AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY root) - 1 AS label FROM tp),
      s0 AS (SELECT frame_id, label, count(*) AS n, sum(i_pct)::BIGINT AS i_sum, min(x_mm) AS x_lo, max(x_mm) AS x_hi, sum(x_mm)::BIGINT AS x_sum, min(y_mm) AS y_lo, max(y_mm) AS y_hi, sum(y_mm)::BIGINT AS y_sum,
        min(z_mm) AS z_lo, max(z_mm) AS z_hi, sum(z_mm)::BIGINT AS z_sum FROM rg JOIN nu USING (frame_id, cx, cy) GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 1500 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, label) <= 40),
      s1 AS (SELECT *, x_hi - x_lo AS l, y_hi - y_lo AS w, z_hi - z_lo AS h FROM s0 WHERE x_hi - x_lo <= 12000 AND y_hi - y_lo <= 8000),
      sm AS (SELECT *, CASE WHEN l BETWEEN 3000 AND 5500 AND w BETWEEN 1500 AND 2400 AND h BETWEEN 1200 AND 2200 THEN 'parked_car' WHEN h > 1200 AND l < 1200 AND w < 1200 THEN 'pedestrian' WHEN l > 1800 OR w > 1400 THEN 'vehicle' ELSE 'obstacle' END AS kind FROM s1)"""
_GAP = lambda k: f"greatest(a.{k}_lo - b.{k}_hi, b.{k}_lo - a.{k}_hi, 0)"
_SPAN = lambda k: f"greatest(a.{k}_hi, b.{k}_hi) - least(a.{k}_lo, b.{k}_lo)"
ORACLE |= {
    "cluster_summary": f"WITH RECURSIVE {P}, {_CLUSTERS} SELECT frame_id, n, i_sum, x_lo, x_hi, y_lo, y_hi, z_lo, z_hi, x_sum, y_sum, z_sum, kind FROM sm",
    "cluster_merge": f"""WITH RECURSIVE {P}, {_CLUSTERS},
      gp AS (SELECT a.frame_id, a.label AS lo, b.label AS hi, {_GAP('x')} * {_GAP('x')} + {_GAP('y')} * {_GAP('y')} AS d2, {_GAP('z')} AS gz, a.kind = 'vehicle' OR b.kind = 'vehicle' AS veh, {_SPAN('x')} > 1800 OR {_SPAN('y')} > 1400 AS long
        FROM sm a JOIN sm b ON a.frame_id = b.frame_id AND a.label < b.label),
      lk AS (SELECT frame_id, lo, hi FROM gp WHERE gz <= 1000 AND ((veh AND d2 <= 1000000) OR (d2 = 0 AND gz < 600) OR (d2 <= 360000 AND long))),
      bw AS (SELECT frame_id, lo AS x, hi AS y FROM lk UNION ALL SELECT frame_id, hi, lo FROM lk),
      rt AS (SELECT frame_id, label, label AS root FROM sm UNION SELECT rt.frame_id, bw.y, rt.root FROM rt JOIN bw ON bw.frame_id = rt.frame_id AND bw.x = rt.label),
      og AS (SELECT frame_id, label, min(root) AS g FROM rt GROUP BY 1, 2),
      mg AS (SELECT frame_id, g AS "group", count(*) AS parts, sum(n)::BIGINT AS n, sum(i_sum)::BIGINT AS i_sum, bool_or(kind = 'parked_car') AS car, bool_or(kind = 'vehicle') AS veh, min(kind) AS own, min(x_lo) AS x_lo, max(x_hi) AS x_hi, sum(x_sum)::BIGINT AS x_sum,
        min(y_lo) AS y_lo, max(y_hi) AS y_hi, sum(y_sum)::BIGINT AS y_sum, min(z_lo) AS z_lo, max(z_hi) AS z_hi, sum(z_sum)::BIGINT AS z_sum FROM sm JOIN og USING (frame_id, label) GROUP BY 1, 2)
      SELECT * EXCLUDE (car, veh, own), CASE WHEN parts = 1 THEN own WHEN car OR (x_hi - x_lo BETWEEN 3000 AND 5500 AND y_hi - y_lo BETWEEN 1500 AND 2400 AND z_hi - z_lo BETWEEN 1200 AND 2200) THEN 'parked_car'
        WHEN veh OR x_hi - x_lo > 1800 OR y_hi - y_lo > 1400 THEN 'vehicle' WHEN z_hi - z_lo > 1200 AND x_hi - x_lo < 1200 AND y_hi - y_lo < 1200 THEN 'pedestrian' ELSE 'obstacle' END AS kind FROM mg""",
    "telemetry_frame": f"""{_SUMMED}, {TRACKS}, {_CAPPED(50)},
      ce AS (SELECT frame_id, count(*) AS n, count(*) FILTER (cost > 180) AS lethal, string_agg(printf('{{"size_mm":%d,"gy":%d,"gx":%d,"z":%s,"cost":%d,"color":"%s"}}', size_mm, gy, gx, (round_even(mean_z, 0) / 1000)::VARCHAR, cost,
        CASE WHEN cost <= 50 THEN 'green' WHEN cost <= 180 THEN 'yellow' ELSE 'red' END), ',' ORDER BY size_mm, gy, gx) AS cells FROM cp GROUP BY 1),
      ob AS (SELECT frame_id, string_agg(printf('{{"track_id":%d,"x":%s,"y":%s,"vx":%s,"vy":%s}}', track_id, round_even(x, 2)::VARCHAR, round_even(y, 2)::VARCHAR, round_even(vx, 2)::VARCHAR, round_even(vy, 2)::VARCHAR), ',' ORDER BY track_id) AS objects FROM t WHERE is_dynamic GROUP BY 1)
      SELECT frame_id, '{{"frame_id":' || frame_id || ',"cells":[' || cells || '],"dynamic_objects":[' || coalesce(objects, '') || '],"system_stats":{{"cells":' || n || ',"lethal":' || lethal || '}}}}' AS frame FROM ce LEFT JOIN ob USING (frame_id)""",
    "frame_validation": f"""{_SUMMED}, {_CAPPED(200)}, fv AS (SELECT frame_id, bool_or(cost = 0) AS broken FROM cp GROUP BY 1)
      SELECT ok, count(*) AS frames FROM (SELECT true AS ok FROM fv UNION ALL SELECT NOT broken FROM fv) GROUP BY 1""",
    "document_statistics": f"""{_SUMMED}, {TRACKS}, b AS (SELECT frame_id, count(*) AS c, count(*) FILTER (cost <= 50) AS safe, count(*) FILTER (cost > 50 AND cost <= 180) AS caution, count(*) FILTER (cost > 180) AS lethal, count(*) FILTER (size_mm = 500) AS coarse, count(*) FILTER (size_mm = 125) AS fine FROM ev GROUP BY 1),
      k AS (SELECT frame_id, count(*) AS tracks, count(*) FILTER (is_dynamic) AS moving FROM t GROUP BY 1), rw AS (SELECT *, greatest(count(*) OVER (PARTITION BY frame_id) // 300, 1) AS st, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS r FROM p),
      w AS (SELECT frame_id, count(*) AS n, (count(*) FILTER (r % st = 0) * 3)::INTEGER AS raw, sum(x_mm + y_mm + z_mm) FILTER (r % st = 0)::BIGINT AS raw_total FROM rw GROUP BY 1)
      SELECT w.frame_id, 'NOMINAL' AS system_status, w.n AS point_count, b.c AS cell_count, b.c AS active_cells, safe AS safe_cells, caution AS caution_cells, lethal AS hazard_cells, coarse AS coarse_cells, fine AS fine_cells, tracks AS active_tracks, moving AS dynamic_tracks,
        0::BIGINT AS parked_cars, 0::BIGINT AS thin_hazards, round(round(safe * 100.0::DOUBLE / b.c, 1) * 10)::BIGINT AS accuracy10, CASE WHEN (b.c * 256 + 262144) / 1048576.0::DOUBLE < 15 THEN 'PASS' ELSE 'FAIL' END AS memory, raw, raw_total
      FROM w JOIN b USING (frame_id) JOIN k USING (frame_id)""",
}
