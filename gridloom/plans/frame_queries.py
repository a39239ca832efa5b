"""Queries over single points, tracks and viewer rules, and the statistics of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import cells, cluster, ground, hazards, health, spatial, telemetry as tm, track
from gridloom.plans.cell_queries import leaves_sql
from gridloom.plans.common import SMALL, TRACKS, WIDE, P, points, small, tracks, wide
from gridloom.plans.pipeline import Tables
from gridloom.plans.terrain_queries import _GROUND, _IMAGE, _RAYS


def _micro(c, scale=1e6):
    return F.round(F.col(c) * scale).cast("bigint").alias(c)


def _leaves(s, d):
    return cells.evaluate(cells.leaves(points(s, d)))


def _columns(s, d):
    t = tracks(s, d).drop("is_dynamic").withColumn("hits", (F.col("frame_id") % 5 + 1).cast("int")).withColumn("pv", F.col("track_id") * 0.7 + 0.05)
    return track.derived(t).select("frame_id", "track_id", *[_micro(c) for c in ("speed", "heading", "velocity_rmse")], "is_confirmed", "is_dynamic")


def _restored(s, d):
    l = spatial.centres(_leaves(s, d))
    key = lambda c: F.rint(F.col(c) / 100).cast("bigint")
    memory = points(s, d).groupBy("frame_id", key("x_mm").alias("kx"), key("y_mm").alias("ky")).agg((F.min("z_mm") / 1000.0).alias("z"))
    blind = points(s, d).select("frame_id").distinct().select("frame_id", F.when(F.col("frame_id") % 2 == 0, "FRONT_LEFT,REAR_LEFT").otherwise("FRONT_RIGHT").alias("quadrants"))
    return health.restored(l, memory, blind).select("frame_id", "size_mm", "gx", "gy", F.round(F.col("mean_z") * 100).cast("bigint").alias("mean_z"))


def _tiles(s, d):
    l = _leaves(s, d).withColumn("semantic_cost", F.when(F.col("gx") % 3 == 0, F.lit(200)).when(F.col("gx") % 3 == 1, F.lit(90)))
    l = l.withColumn("cost", F.when(F.col("gy") % 11 == 0, -1).otherwise(F.col("cost")))
    both = tm.viewer_tiles(l).withColumn("semantic", F.lit(False)).unionByName(tm.viewer_tiles(l, True).withColumn("semantic", F.lit(True)))
    return both.select("frame_id", "semantic", "size_mm", "gx", "gy", "effective_cost", "tile_height", "scale", F.round(F.col("floor") * 1000).cast("bigint").alias("floor_mm"))


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


def _logged(s, d):
    i = F.col("event_id")
    e = _events(s, d).select((i * 0.5).alias("timestamp"), i.alias("track_id"), F.col("event_type").alias("object_class"), (i % 7).alias("pos_x"), (i % 5).alias("pos_y"), (i % 4 * 3).alias("vel_x"), (i % 4 * 4).alias("vel_y"), F.lit("unused").alias("extra"))
    return tm.log_rows(e, "dynamic_tracks_history").select("timestamp", "track_id", "object_class", "pos_x", "pos_y", "vel_x", "vel_y", "speed", _micro("heading"))


def _objects(s, d):
    i = F.col("event_id")
    three = lambda k: F.array(*[((i + n) % k).cast("double") for n in range(3)])
    e = _events(s, d).select("event_id", F.when(i % 3 > 0, three(9)).alias("position"), (i % 4).alias("x"), F.when(i % 2 == 0, three(5)).alias("velocity"), F.when(i % 5 == 0, F.lit(7.0)).alias("vx"), F.when(i % 7 == 0, (i % 360).cast("double")).alias("heading_deg"), F.when(i % 4 == 0, "vehicle").when(i % 4 == 1, "person").alias("class"), F.when(i % 6 == 0, three(4)).when(i % 6 == 1, F.array(F.lit(1.0))).alias("dimensions"), F.when(i % 8 == 0, False).alias("is_dynamic"))
    return tm.normalised(e).select("event_id", "x", "y", "z", "vx", "vy", _micro("speed"), _micro("heading"), F.get("dimensions", F.lit(1)).alias("side"), "is_dynamic")


def _groups(s, d):
    i = F.col("event_id") % 9
    names = F.array(*map(F.lit, ["Car", "school BUS", "Human", "pedestrian_a", "guide dog", "cattle", "cyclist", "", "Van"]))
    e = _events(s, d).select("event_id", F.when(F.col("event_id") % 10 > 0, F.element_at(names, (i + 1).cast("int"))).alias("name"))
    length, width = tm.footprint(F.when(F.col("event_id") % 2 == 0, F.lit(3.0)), F.when(F.col("event_id") % 3 == 0, F.lit(0.0)), F.col("name"))
    return e.select("event_id", tm.class_group(F.col("name")).alias("kind"), length.alias("length"), width.alias("width"))


def _statistics(s, d):
    p = ground.split(points(s, d))
    thin = points(s, d).where("point_idx % 50 = 0").select("frame_id")
    objects = tracks(s, d).select("frame_id", F.when(F.col("track_id") == 1, "parked_car").otherwise("vehicle").alias("kind"))
    state = points(s, d).select("frame_id").distinct().select("frame_id", (F.col("frame_id") % 3 == 0).alias("is_degraded"), F.when(F.col("frame_id") % 3 == 0, "FRONT_LEFT").alias("quadrants"))
    out = tm.frame_statistics(p, _leaves(s, d), tracks(s, d), thin, hazards.dropoffs(p.where("is_ground")), objects, state)
    return out.select(*[c for c in out.columns if c not in ("ground_inlier_ratio", "refinement_ratio", "saved_percent")], _micro("ground_inlier_ratio"), _micro("refinement_ratio"), _micro("saved_percent"))


def _recording(s, d):
    return _events(s, d).select("user_id", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("elapsed_ms"))


def _serialised(s, d):
    l = spatial.centres(_leaves(s, d)).withColumn("semantic_cost", F.when(F.col("gx") % 3 == 0, F.lit(200)).when(F.col("gx") % 3 == 1, F.lit(30)))
    l = l.withColumn("cost", F.when(F.col("gy") % 11 == 0, -1).when(F.col("gy") % 11 == 1, 100).otherwise(F.col("cost")))
    out = tm.serialised(l).select("frame_id", "cell.*")
    cm = [F.round(F.col(c) * 100).cast("bigint").alias(c) for c in ("x", "y", "z", "z_min", "z_max", "size", "delta_z")]
    return out.select("frame_id", *cm, "cost", "semantic_cost", "observed", "pts")


def _completed(s, d):
    i = F.col("event_id")
    given = lambda k, v: F.when(i % k == 0, v)
    e = _events(s, d).select("event_id", given(2, i % 100).alias("cell_count"), given(3, i % 50).alias("active_cells"), (i % 20).alias("n_cells"), given(5, i).alias("point_count"), given(7, F.lit(4)).alias("coarse_cells"), given(11, F.lit(2)).alias("fine_cells"),
        F.when(i % 13 == 0, F.lit(0.5)).when(i % 13 == 1, F.lit(float("nan"))).alias("refinement_ratio"), given(4, F.lit(9)).alias("active_tracks"), (i % 6).alias("n_objects"), F.lit(None).cast("bigint").alias("dynamic_tracks"), (i % 3).alias("n_dynamic"))
    return tm.completed(e).select("event_id", "cell_count", "point_count", "coarse_cells", "fine_cells", _micro("refinement_ratio"), "active_tracks", "dynamic_tracks")


QUERIES = {
    "serialised_leaves": _serialised,
    "completed_statistics": _completed,
    "point_cells": lambda s, d: cells.cell_of_point(wide(s, d)).select("frame_id", "point_idx", "zone", "size_mm", F.round(F.col("cx") * 1e4).cast("bigint").alias("cx"), F.round(F.col("cy") * 1e4).cast("bigint").alias("cy"), "cell_id"),
    "track_columns": _columns,
    "terrain_restore": _restored,
    "threat_candidates": lambda s, d: ground.candidates(points(s, d).withColumn("h", F.col("z_mm") + 1600), "h").select("frame_id", "point_idx", "i_pct", "slot", "place"),
    "brightness": lambda s, d: ground.brightness(points(s, d).withColumn("intensity", F.when(F.col("point_idx") % 13 > 0, F.col("i_pct") * F.when(F.col("frame_id") % 2 == 0, 0.01).otherwise(3.0)))).select("frame_id", "point_idx", _micro("brightness")),
    "viewer_tiles": _tiles,
    "object_table": lambda s, d: tm.object_table(tracks(s, d).withColumn("vy", F.when(F.col("track_id") < 2, F.col("vy"))), 2),
    "track_layers": lambda s, d: tm.layer(tracks(s, d), "static").select("frame_id", "track_id", F.lit("static").alias("layer")).unionByName(tm.layer(tracks(s, d), "dynamic").select("frame_id", "track_id", F.lit("dynamic").alias("layer"))),
    "log_tracks": _logged,
    "normalised_objects": _objects,
    "class_footprints": _groups,
    "session_seconds": lambda s, d: tm.session_seconds(_recording(s, d), "user_id").select("user_id", F.round(F.col("seconds") * 1000).cast("bigint").alias("ms")),
    "reconnect_delays": lambda s, d: _events(s, d).select("event_id", tm.reconnect_delays(F.col("event_id") % 6).alias("seconds")),
    "frame_statistics": _statistics,
    "cell_colours": lambda s, d: _leaves(s, d).withColumn("cost", F.when(F.col("gx") % 17 == 0, -1).otherwise(F.col("cost"))).select("frame_id", "size_mm", "gx", "gy", cells.colour(F.col("cost"), F.col("mean_z")).alias("colour")),
    "pillar_channels": lambda s, d: cluster.pillars(points(s, d)).select("frame_id", "point_idx", *[F.round(F.col(c) * 10).cast("bigint").alias(c) for c in ("off_x", "off_y", "off_z", "from_y", "from_z")]),
    "geometric_objects": lambda s, d: cluster.geometric(small(s, d), 150, 2000, 3).select("frame_id", "label", "n", "x_lo", "x_hi", "y_lo", "y_hi", "z_lo", "z_hi", "x_centre2", "x_side", "kind"),
    "tracker_candidates": lambda s, d: _candidates(s, d),
}


def _candidates(s, d):
    found = cluster.geometric(small(s, d), 150, 2000, 3)
    found = Tables(found).save(found, "found")  # read three times below
    porous = found.select("frame_id", "label", (F.col("n") % 2 == 0).alias("is_porous"))
    boxes = found.select("frame_id").distinct().select("frame_id", (F.col("frame_id") % 10 * 1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(1.0).alias("vx"), F.lit(None).cast("double").alias("vy"), F.lit(4.0).alias("length"), F.lit(2.0).alias("width"), F.lit(1.5).alias("height"))
    return cluster.candidates(found, porous, boxes).select("frame_id", "det_id", "source", "x", "y", "length", "width", "height", "vx", "kind")


def dbscan_sql(source: str, eps: int, least: int) -> str:
    """CTEs up to db (frame_id, point_idx, label) over a table of points with frame_id, point_idx and coordinates."""
    return f"""np AS (SELECT a.frame_id, a.point_idx AS i, b.point_idx AS j FROM {source} a JOIN {source} b ON a.frame_id = b.frame_id AND (a.x_mm - b.x_mm) ** 2 + (a.y_mm - b.y_mm) ** 2 + (a.z_mm - b.z_mm) ** 2 <= {eps} * {eps}),
co AS (SELECT frame_id, i FROM np GROUP BY 1, 2 HAVING count(*) >= {least}),
cl AS (SELECT np.* FROM np SEMI JOIN co ON co.frame_id = np.frame_id AND co.i = np.i SEMI JOIN co c2 ON c2.frame_id = np.frame_id AND c2.i = np.j),
rc AS (SELECT frame_id, i, i AS r FROM co UNION SELECT cl.frame_id, cl.j, rc.r FROM rc JOIN cl ON cl.frame_id = rc.frame_id AND cl.i = rc.i),
rt AS (SELECT frame_id, i, min(r) AS root FROM rc GROUP BY 1, 2), nm AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY root) - 1 AS label FROM rt),
bd AS (SELECT np.frame_id, np.i, min(nm.label) AS label FROM np JOIN nm ON nm.frame_id = np.frame_id AND nm.i = np.j ANTI JOIN co ON co.frame_id = np.frame_id AND co.i = np.i GROUP BY 1, 2),
db AS (SELECT s.frame_id, s.point_idx, coalesce(nm.label, bd.label, -1) AS label FROM {source} s LEFT JOIN nm ON nm.frame_id = s.frame_id AND nm.i = s.point_idx LEFT JOIN bd ON bd.frame_id = s.frame_id AND bd.i = s.point_idx)"""


_PI = "3.141592653589793::DOUBLE"
_M = lambda e: f"round(({e}) * 1e6)::BIGINT"
_GEOMETRIC = f"""vx AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY frame_id, floor(x_mm / 150.0::DOUBLE), floor(y_mm / 150.0::DOUBLE), floor(z_mm / 150.0::DOUBLE) ORDER BY point_idx) = 1), {dbscan_sql('vx', 2000, 3)},
go AS (SELECT frame_id, label, count(*) AS n, min(x_mm) AS x_lo, max(x_mm) AS x_hi, min(y_mm) AS y_lo, max(y_mm) AS y_hi, min(z_mm) AS z_lo, max(z_mm) AS z_hi FROM db JOIN vx USING (frame_id, point_idx) WHERE label >= 0 GROUP BY 1, 2 HAVING count(*) >= 3)"""
_EFFECTIVE = """CASE WHEN c = -1 THEN -1 WHEN mean_z BETWEEN -2200 AND -1250 AND dz <= 180 AND z_max <= -1150 THEN 0 WHEN semantic THEN coalesce(sc, c, 0) ELSE coalesce(c, sc, 0) END"""
_THREE = lambda k: f"[((event_id + 0) % {k})::DOUBLE, ((event_id + 1) % {k})::DOUBLE, ((event_id + 2) % {k})::DOUBLE]"

ORACLE = {
    "point_cells": f"""WITH {WIDE}, a AS (SELECT *, x_mm * x_mm + y_mm * y_mm AS d2 FROM p), b AS (SELECT *, CASE WHEN d2 < 100000000 THEN 1 WHEN d2 < 625000000 THEN 2 WHEN d2 < 2500000000 THEN 3 WHEN d2 <= 10000000000 THEN 4 ELSE 5 END AS zone FROM a),
      c AS (SELECT *, CASE zone WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 250 ELSE 500 END AS size_mm FROM b), e AS (SELECT *, (floor(x_mm / size_mm::DOUBLE) + 0.5::DOUBLE) * size_mm / 1000.0::DOUBLE AS x, (floor(y_mm / size_mm::DOUBLE) + 0.5::DOUBLE) * size_mm / 1000.0::DOUBLE AS y, size_mm / 2000.0::DOUBLE AS h FROM c),
      f AS (SELECT *, sqrt(greatest(abs(x) - h, 0) ** 2 + greatest(abs(y) - h, 0) ** 2) AS rn, sqrt((abs(x) + h) ** 2 + (abs(y) + h) ** 2) AS rf FROM e),
      g AS (SELECT *, CASE WHEN rn < 10 AND rf > 10 THEN CASE WHEN zone = 1 THEN (10 - 1e-4) / rf ELSE (10 + 1e-4) / rn END WHEN rn < 25 AND rf > 25 THEN CASE WHEN zone = 2 THEN (25 - 1e-4) / rf ELSE (25 + 1e-4) / rn END
            WHEN rn < 50 AND rf > 50 THEN CASE WHEN zone = 3 THEN (50 - 1e-4) / rf ELSE (50 + 1e-4) / rn END ELSE 1 END AS s FROM f)
      SELECT frame_id, point_idx, zone, size_mm, round(x * s * 1e4)::BIGINT AS cx, round(y * s * 1e4)::BIGINT AS cy, printf('z%d_%.2fm_%+09.4f_%+09.4f', zone, size_mm / 1000.0::DOUBLE, x * s, y * s) AS cell_id FROM g""",
    "track_columns": f"""WITH {P}, {TRACKS}, a AS (SELECT *, sqrt(vx * vx + vy * vy) AS sp, (frame_id % 5 + 1)::INTEGER AS hits, track_id * 0.7::DOUBLE + 0.05::DOUBLE AS pv FROM t)
      SELECT frame_id, track_id, {_M('sp')} AS speed, {_M('atan2(vy, vx)')} AS heading, {_M('least(greatest(sqrt(pv / hits) * 0.25::DOUBLE, 0.04::DOUBLE), 1.2::DOUBLE)')} AS velocity_rmse, hits >= 3 AS is_confirmed, hits >= 3 AND sp >= 0.25 AS is_dynamic FROM a""",
    "terrain_restore": f"""WITH {P}, {leaves_sql()}, m AS (SELECT frame_id, round_even(x_mm / 100.0::DOUBLE, 0)::BIGINT AS kx, round_even(y_mm / 100.0::DOUBLE, 0)::BIGINT AS ky, min(z_mm) / 1000.0::DOUBLE AS z FROM p GROUP BY 1, 2, 3),
      l AS (SELECT *, -40000 + (gx + 0.5::DOUBLE) * size_mm AS x, -35000 + (gy + 0.5::DOUBLE) * size_mm AS y FROM ev), qq AS (SELECT *, CASE WHEN (y >= 0 AND x > 0) OR (x = 0 AND y = 0) THEN 0 WHEN (y > 0 AND x <= 0) OR (y = 0 AND x < 0) THEN 1 WHEN y < 0 AND x < 0 THEN 2 ELSE 3 END AS quadrant FROM l)
      SELECT qq.frame_id, size_mm, gx, gy, round(coalesce(CASE WHEN (qq.frame_id % 2 = 0 AND quadrant IN (1, 2)) OR (qq.frame_id % 2 = 1 AND quadrant = 0) THEN m.z * 1000 END, mean_z) * 100)::BIGINT AS mean_z
      FROM qq LEFT JOIN m ON m.frame_id = qq.frame_id AND m.kx = round_even(x / 100.0::DOUBLE, 0)::BIGINT AND m.ky = round_even(y / 100.0::DOUBLE, 0)::BIGINT""",
    "threat_candidates": f"""WITH {P}, a AS (SELECT frame_id, point_idx, i_pct FROM p WHERE z_mm + 1600 BETWEEN 10 AND 80 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY i_pct DESC, point_idx) <= 120),
      b AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS r, count(*) OVER (PARTITION BY frame_id) AS n FROM a)
      SELECT frame_id, point_idx, i_pct, CASE WHEN r < n - n % 5 THEN (r // 5)::INTEGER END AS slot, CASE WHEN r < n - n % 5 THEN (r % 5)::INTEGER END AS place FROM b""",
    "brightness": f"""WITH {P}, a AS (SELECT *, CASE WHEN point_idx % 13 > 0 THEN i_pct * CASE WHEN frame_id % 2 = 0 THEN 0.01::DOUBLE ELSE 3.0::DOUBLE END END AS v FROM p)
      SELECT frame_id, point_idx, {_M('coalesce(least(greatest(v / CASE WHEN max(v) OVER (PARTITION BY frame_id) > 1 THEN 255.0::DOUBLE ELSE 1 END, 0), 1), 0.2::DOUBLE)')} AS brightness FROM a""",
    "viewer_tiles": f"""WITH {P}, {leaves_sql()}, a AS (SELECT ev.*, CASE WHEN gy % 11 = 0 THEN -1 ELSE cost END AS c, CASE gx % 3 WHEN 0 THEN 200 WHEN 1 THEN 90 END AS sc, semantic FROM ev, (VALUES (false), (true)) v(semantic)), e AS (SELECT *, {_EFFECTIVE}::INTEGER AS effective_cost FROM a)
      SELECT frame_id, semantic, size_mm, gx, gy, effective_cost, (CASE WHEN effective_cost < 0 THEN 0.01 WHEN effective_cost > 180 THEN 0.2 WHEN effective_cost > 50 THEN 0.1 ELSE 0.04 END)::DOUBLE AS tile_height,
        (CASE WHEN effective_cost < 0 THEN 0.96 WHEN effective_cost > 50 THEN 0.98 ELSE 1.02 END)::DOUBLE AS scale, CASE WHEN effective_cost >= 0 AND z_min < -1000 THEN z_min ELSE -1680 END::BIGINT AS floor_mm FROM e""",
    "object_table": f"""WITH {P}, {TRACKS}, a AS (SELECT *, CASE WHEN track_id < 2 THEN vy END AS wy, row_number() OVER (PARTITION BY frame_id ORDER BY track_id)::INTEGER AS row FROM t), b AS (SELECT *, coalesce(sqrt(vx * vx + wy * wy), 0) AS sp FROM a)
      SELECT frame_id, row, track_id, printf('%.2f, %.2f', round(x, 2), round(y, 2)) AS position, printf('%.2f, %.2f', round(vx, 2), round(coalesce(wy, 0), 2)) AS velocity,
        CASE WHEN sp > 0 THEN printf('%.2f m/s', round(sp, 2)) ELSE '0.00 m/s (Stationary)' END AS speed, printf('%.1f', coalesce(degrees(atan2(wy, vx)), 0)) AS heading FROM b WHERE row <= 2""",
    "track_layers": f"WITH {P}, {TRACKS} SELECT frame_id, track_id, CASE WHEN is_dynamic THEN 'dynamic' ELSE 'static' END AS layer FROM t",
    "log_tracks": f"""SELECT event_id * 0.5::DOUBLE AS timestamp, event_id AS track_id, event_type AS object_class, (event_id % 7)::DOUBLE AS pos_x, (event_id % 5)::DOUBLE AS pos_y, (event_id % 4 * 3)::DOUBLE AS vel_x, (event_id % 4 * 4)::DOUBLE AS vel_y,
      (event_id % 4 * 5)::DOUBLE AS speed, {_M('atan2((event_id % 4 * 4)::DOUBLE, (event_id % 4 * 3)::DOUBLE)')} AS heading FROM events""",
    "normalised_objects": f"""WITH a AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN {_THREE(9)} END AS p, CASE WHEN event_id % 2 = 0 THEN {_THREE(5)} END AS v, CASE WHEN event_id % 6 = 0 THEN {_THREE(4)} END AS dm FROM events),
      b AS (SELECT *, coalesce(p[1], event_id % 4)::DOUBLE AS x, coalesce(p[2], 0)::DOUBLE AS y, coalesce(p[3], 0)::DOUBLE AS z, coalesce(v[1], CASE WHEN event_id % 5 = 0 THEN 7 END, 0)::DOUBLE AS vx, coalesce(v[2], 0)::DOUBLE AS vy FROM a),
      c AS (SELECT *, sqrt(vx * vx + vy * vy) AS sp FROM b)
      SELECT event_id, x, y, z, vx, vy, {_M('sp')} AS speed, {_M('coalesce(radians(CASE WHEN event_id % 7 = 0 THEN (event_id % 360)::DOUBLE END), atan2(vy, vx))')} AS heading, coalesce(dm[2], CASE WHEN event_id % 4 = 0 THEN 4.2 ELSE 0.6 END)::DOUBLE AS side,
        CASE WHEN event_id % 8 = 0 THEN false ELSE sp > 0.05 END AS is_dynamic FROM c""",
    "class_footprints": """WITH a AS (SELECT event_id, CASE WHEN event_id % 10 > 0 THEN ['Car', 'school BUS', 'Human', 'pedestrian_a', 'guide dog', 'cattle', 'cyclist', '', 'Van'][event_id % 9 + 1] END AS name FROM events),
      b AS (SELECT event_id, CASE WHEN regexp_matches(name, '(?i)vehicle|car|truck|bus') THEN 'vehicle' WHEN regexp_matches(name, '(?i)pedestrian|person|human') THEN 'pedestrian' WHEN regexp_matches(name, '(?i)animal|dog|cow|cattle') THEN 'animal' ELSE 'obstacle' END AS kind FROM a)
      SELECT event_id, kind, CASE WHEN event_id % 2 = 0 THEN 3.0 ELSE CASE kind WHEN 'vehicle' THEN 4.2 WHEN 'animal' THEN 1.2 WHEN 'pedestrian' THEN 0.6 ELSE 0.9 END END::DOUBLE AS length, CASE kind WHEN 'vehicle' THEN 1.9 WHEN 'animal' THEN 0.7 WHEN 'pedestrian' THEN 0.6 ELSE 0.9 END::DOUBLE AS width FROM b""",
    "session_seconds": "SELECT user_id, max(floor(epoch_us(ts) / 1000.0::DOUBLE)::BIGINT) - min(floor(epoch_us(ts) / 1000.0::DOUBLE)::BIGINT) AS ms FROM events GROUP BY 1",
    "reconnect_delays": "SELECT event_id, least(power(2.0::DOUBLE, event_id % 6), 8)::DOUBLE AS seconds FROM events",
    "frame_statistics": f"""WITH {P}, {TRACKS}, {_GROUND}, {_RAYS}, {leaves_sql()}, a AS (SELECT frame_id, count(*) AS point_count, count(*) FILTER (is_ground) AS ground_points, count(*) FILTER (NOT is_ground) AS obstacle_points FROM gs GROUP BY 1),
      l AS (SELECT frame_id, count(*) AS cell_count, count(*) FILTER (cost <= 50) AS safe_cells, count(*) FILTER (cost > 50 AND cost <= 180) AS caution_cells, count(*) FILTER (cost > 180) AS hazard_cells, count(*) FILTER (size_mm = 500) AS coarse_cells, count(*) FILTER (size_mm = 125) AS fine_cells FROM ev GROUP BY 1),
      tr AS (SELECT frame_id, count(*) AS active_tracks, count(*) FILTER (is_dynamic) AS dynamic_tracks, count(*) FILTER (track_id = 1) AS parked_cars FROM t GROUP BY 1), th AS (SELECT frame_id, count(*) AS thin_hazards FROM p WHERE point_idx % 50 = 0 GROUP BY 1), dr AS (SELECT frame_id, count(*) AS negative_obstacles FROM drops GROUP BY 1)
      SELECT frame_id, point_count, ground_points, obstacle_points, coalesce(cell_count, 0) AS cell_count, coalesce(safe_cells, 0) AS safe_cells, coalesce(caution_cells, 0) AS caution_cells, coalesce(hazard_cells, 0) AS hazard_cells, coalesce(coarse_cells, 0) AS coarse_cells, coalesce(fine_cells, 0) AS fine_cells,
        coalesce(active_tracks, 0) AS active_tracks, coalesce(dynamic_tracks, 0) AS dynamic_tracks, coalesce(parked_cars, 0) AS parked_cars, coalesce(thin_hazards, 0) AS thin_hazards, coalesce(negative_obstacles, 0) AS negative_obstacles,
        cell_count * 256 + 262144 AS leaf_bytes, CASE WHEN cell_count IS NOT NULL THEN 134400000 END AS uniform_bytes, round(100.0::DOUBLE * (134400000 - (cell_count * 256 + 262144)) / 134400000 * 1e6)::BIGINT AS saved_percent,
        CASE WHEN frame_id % 3 = 0 THEN 'DEGRADED' ELSE 'NOMINAL' END AS system_status, CASE WHEN frame_id % 3 = 0 THEN 'FRONT_LEFT' ELSE '' END AS degraded_quadrants,
        {_M('ground_points / point_count::DOUBLE')} AS ground_inlier_ratio, {_M('coalesce(fine_cells / cell_count::DOUBLE, 0)')} AS refinement_ratio
      FROM a LEFT JOIN l USING (frame_id) LEFT JOIN tr USING (frame_id) LEFT JOIN th USING (frame_id) LEFT JOIN dr USING (frame_id)""",
    "geometric_objects": f"""WITH RECURSIVE {SMALL}, {_GEOMETRIC} SELECT frame_id, label, n, x_lo, x_hi, y_lo, y_hi, z_lo, z_hi, x_lo + x_hi AS x_centre2, greatest(x_hi - x_lo, 200) AS x_side, 'obstacle' AS kind FROM go""",
    "serialised_leaves": f"""WITH {P}, {leaves_sql()}, a AS (SELECT *, CASE WHEN gx % 3 = 0 THEN 200 WHEN gx % 3 = 1 THEN 30 END AS sc, CASE gy % 11 WHEN 0 THEN -1 WHEN 1 THEN 100 ELSE cost END AS c, -40000 + (gx + 0.5::DOUBLE) * size_mm AS x0, -35000 + (gy + 0.5::DOUBLE) * size_mm AS y0 FROM ev),
      b AS (SELECT *, coalesce(sc, c) AS s, CASE WHEN c > 0 THEN c WHEN dz > 250 OR z_max > -1150 THEN 255 ELSE 0 END AS own, c <> -1 AS observed FROM a),
      e AS (SELECT *, CASE WHEN c = -1 THEN -1 WHEN c = 100 OR s = 100 THEN 100 WHEN mean_z BETWEEN -2200 AND -1250 AND dz <= 180 AND z_max <= -1150 THEN 0 ELSE greatest(own, s, 0) END::INTEGER AS k FROM b)
      SELECT frame_id, round_even(x0 / 10, 0)::BIGINT AS x, round_even(y0 / 10, 0)::BIGINT AS y, CASE WHEN observed THEN round_even(mean_z / 10, 0)::BIGINT END AS z, CASE WHEN observed THEN round_even(z_min / 10.0::DOUBLE, 0)::BIGINT END AS z_min, CASE WHEN observed THEN round_even(z_max / 10.0::DOUBLE, 0)::BIGINT END AS z_max,
        round_even(size_mm / 10.0::DOUBLE, 0)::BIGINT AS size, CASE WHEN observed THEN round_even(dz / 10.0::DOUBLE, 0)::BIGINT END AS delta_z, k AS cost, k AS semantic_cost, observed, CASE WHEN observed THEN n ELSE 0 END AS pts FROM e""",
    "completed_statistics": """WITH a AS (SELECT event_id, event_id % 20 AS nc, coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 100 END, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END, event_id % 20) AS cell_count FROM events),
      b AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN event_id ELSE cell_count * 12 END AS point_count, CASE WHEN event_id % 7 = 0 THEN 4 ELSE floor(cell_count * 0.7::DOUBLE + 0.5::DOUBLE)::BIGINT END AS coarse_cells FROM a),
      c AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 2 ELSE greatest(0, cell_count - coarse_cells) END AS fine_cells FROM b)
      SELECT event_id, cell_count, point_count, coarse_cells, fine_cells, round(CASE WHEN event_id % 13 = 0 THEN 0.5::DOUBLE WHEN cell_count = 0 THEN 0 ELSE fine_cells / cell_count::DOUBLE END * 1e6)::BIGINT AS refinement_ratio,
        CASE WHEN event_id % 4 = 0 THEN 9 ELSE event_id % 6 END AS active_tracks, event_id % 3 AS dynamic_tracks FROM c""",
    "cell_colours": f"""WITH {P}, {leaves_sql()}, a AS (SELECT *, CASE WHEN gx % 17 = 0 THEN -1 ELSE cost END AS c FROM ev)
      SELECT frame_id, size_mm, gx, gy, CASE WHEN c = -1 THEN 'grey' WHEN (mean_z > -1150 AND c <= 50) OR c > 180 THEN 'red' WHEN c <= 50 THEN 'green' ELSE 'yellow' END AS colour FROM a""",
    "pillar_channels": f"""WITH {P}, a AS (SELECT *, floor((x_mm + 51200) / 200.0::DOUBLE)::BIGINT AS px, floor((y_mm + 51200) / 200.0::DOUBLE)::BIGINT AS py FROM p WHERE x_mm BETWEEN -51200 AND 51199 AND y_mm BETWEEN -51200 AND 51199 AND z_mm BETWEEN -5000 AND 3000),
      b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY frame_id, py, px ORDER BY point_idx) <= 20)
      SELECT frame_id, point_idx, round((x_mm - avg(x_mm) OVER w) * 10)::BIGINT AS off_x, round((y_mm - avg(y_mm) OVER w) * 10)::BIGINT AS off_y, round((z_mm - avg(z_mm) OVER w) * 10)::BIGINT AS off_z,
        ((y_mm - (py * 200 + 100 - 51200)) * 10)::BIGINT AS from_y, ((z_mm + 1000) * 10)::BIGINT AS from_z FROM b WINDOW w AS (PARTITION BY frame_id, py, px)""",
    "dbscan_small": f"WITH RECURSIVE {SMALL}, {dbscan_sql('p', 2000, 3)} SELECT frame_id, point_idx, label FROM db",
    "pixel_labels": f"""WITH {WIDE}, {_IMAGE('')}, pt AS (SELECT *, CASE WHEN r > 0.1 AND u BETWEEN 0 AND 1023 AND v BETWEEN 0 AND 63 THEN true ELSE false END AS ok FROM i2),
      im AS (SELECT DISTINCT frame_id, u, v FROM pt WHERE ok AND u % 3 = 0)
      SELECT pt.frame_id, CASE WHEN im.u IS NOT NULL THEN 3 WHEN z_mm >= 1000 THEN 2 WHEN z_mm > 150 THEN 1 ELSE 0 END AS label, count(*) AS points FROM pt LEFT JOIN im ON ok AND im.frame_id = pt.frame_id AND im.u = pt.u AND im.v = pt.v GROUP BY 1, 2""",
    "tracker_candidates": f"""WITH RECURSIVE {SMALL}, {_GEOMETRIC}, u AS (SELECT frame_id, 'geometric' AS source, label AS o, (x_lo + x_hi) / 2000.0::DOUBLE AS x, (y_lo + y_hi) / 2000.0::DOUBLE AS y, (x_hi - x_lo) / 1000.0::DOUBLE AS length, (y_hi - y_lo) / 1000.0::DOUBLE AS width, (z_hi - z_lo) / 1000.0::DOUBLE AS height, NULL::DOUBLE AS vx, 'obstacle' AS kind FROM go WHERE n % 2 = 1
        UNION ALL SELECT DISTINCT frame_id, 'model', 0, (frame_id % 10)::DOUBLE, 2.0, 4.0, 2.0, 1.5, 1.0, 'vehicle' FROM go)
      SELECT frame_id, (row_number() OVER (PARTITION BY frame_id ORDER BY source, o, x, y) - 1)::INTEGER AS det_id, source, x, y, length, width, height, vx, kind FROM u""",
}
