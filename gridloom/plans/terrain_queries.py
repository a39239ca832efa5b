"""Queries over ground, hazards and the joins of leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import cells, ground, hazards, points as pt, spatial
from gridloom.plans.cell_queries import leaves_sql
from gridloom.plans.common import BOXES, TRACKS, WIDE, P, boxes, points, tracks, wide


def _micro(c, scale=1e6):
    return F.round(F.col(c) * scale).cast("bigint").alias(c)


def _planes(s, d):
    return ground.fit_planes(ground.plane_sums(ground.split(points(s, d)).where("is_ground")))


def _labels(s, d):
    return points(s, d).withColumn("label", ground.height_label(F.col("z_mm") + 1600))


def _circles(s, d):
    return boxes(s, d).select("frame_id", ((F.col("x_lo") + F.col("x_hi")) / 2).alias("x"), ((F.col("y_lo") + F.col("y_hi")) / 2).alias("y"), (F.col("track_id") * 500 + 700).alias("radius"), F.when(F.col("track_id") == 0, 255).otherwise(120).alias("cost"))


def _leaves(s, d):
    return cells.evaluate(cells.leaves(points(s, d)))


def _rows(df):
    return df.select("frame_id", "size_mm", "gx", "gy", "cost")


def _coarse_means(s, d):
    return cells.statistics(points(s, d), 500).withColumn("z_um", F.round(F.col("sum_z") * 1000 / F.col("n")).cast("bigint")).select("frame_id", "gx", "gy", "z_um")


def _residual(s, d):
    p = ground.residual_to_plane(points(s, d), _planes(s, d))
    return p.groupBy("frame_id").agg(F.count_if(F.abs("residual") < 0.05).alias("on_plane"), F.count_if(F.col("residual") > 0.3).alias("above"))


def _evaluated_drops(s, d):
    drops = hazards.dropoffs(ground.split(wide(s, d)).where("is_ground"))
    return _rows(spatial.stamp_dropoffs(spatial.centres(cells.evaluate(cells.leaves(wide(s, d)))), drops))


_SHOW = ["frame_id", "point_idx", "x_mm", "y_mm", "z_mm", "i_pct"]
QUERIES = {
    "ground_seed_table": lambda s, d: ground.seeds(wide(s, d)),
    "ground_split": lambda s, d: ground.split(wide(s, d)).select("frame_id", "point_idx", "is_ground"),
    "plane_covariance": lambda s, d: ground.plane_sums(points(s, d)),
    "plane_fit": lambda s, d: _planes(s, d).select("frame_id", *[_micro(c) for c in "abcd"]),
    "plane_residuals": _residual,
    "ground_residual": lambda s, d: ground.residual_to_cell(points(s, d)).select("frame_id", "point_idx", "residual_mm"),
    "threat_mask_fallback": lambda s, d: ground.low_profile(points(s, d)).select("frame_id", "point_idx", "is_threat"),
    "thin_hazards": lambda s, d: ground.thin_hazards(points(s, d).withColumn("h", F.col("z_mm") + 1600), "h").select("frame_id", "gx", "gy", "first", "n", "sum_x", "sum_y", "sum_z", "x_lo", "x_hi", "y_lo", "y_hi", _micro("p"), _micro("radius", 2)),
    "height_labels": lambda s, d: _labels(s, d).select("frame_id", "point_idx", "label"),
    "label_partition": lambda s, d: ground.label_counts(_labels(s, d)),
    "point_windows": lambda s, d: ground.windows(points(s, d)).select("frame_id", "w", F.array_join(F.transform("heights", lambda z: z.cast("string")), ",").alias("heights")),
    "point_windows_strided": lambda s, d: ground.windows(points(s, d), 512, 128).groupBy("frame_id", "w").agg(F.first(F.array_join(F.transform("heights", lambda z: z.cast("string")), ",")).alias("heights")),
    "range_image": lambda s, d: ground.range_image(wide(s, d)).select("frame_id", "v", "u", "point_idx", _micro("r", 1e4)),
    "range_image_mirrored": lambda s, d: ground.range_image(wide(s, d), mirror=True).select("frame_id", "v", "u", "point_idx"),
    "trench_rays": lambda s, d: hazards.dropoffs(ground.split(wide(s, d)).where("is_ground")),
    "rollout_cones": lambda s, d: hazards.cones(tracks(s, d)).select("frame_id", "track_id", "t", *[_micro(c) for c in ("cx", "cy", "semi_major", "semi_minor", "heading")], F.transform("polygon", lambda v: F.round(v["x"] * 1e4).cast("bigint")).alias("px")).withColumn("px", F.aggregate("px", F.lit(0).cast("bigint"), lambda a, x: a + x)),
    "rollout_top5": lambda s, d: hazards.nearest_hazards(tracks(s, d)).select("frame_id", "rank", "track_id", "t", _micro("x"), _micro("y"), _micro("radius"), "cost"),
    "hazard_stamp": lambda s, d: _rows(spatial.stamp(spatial.centres(_leaves(s, d)), _circles(s, d))),
    "dropoff_stamp": _evaluated_drops,
    "obstacle_occupancy": lambda s, d: _rows(spatial.occupancy(_leaves(s, d), points(s, d))),
    "vegetation_scale": lambda s, d: _rows(spatial.vegetation(_leaves(s, d), _labels(s, d))),
    "trench_3x3_median": lambda s, d: spatial.local_drops(_coarse_means(s, d)).select("frame_id", "gx", "gy", "z_um", F.round(F.col("baseline") * 2).cast("bigint").alias("baseline2"), F.round(F.col("drop") * 2).cast("bigint").alias("drop2")),
    "point_cost_containment": lambda s, d: _rows(spatial.costs_of_points(_leaves(s, d), points(s, d))),
    "excluded_points_grid": lambda s, d: _rows(cells.evaluate(cells.leaves(pt.outside_boxes(points(s, d), boxes(s, d))))),
}

_PI = "3.141592653589793::DOUBLE"
_REACH = "69462.219947249::DOUBLE"
_POLAR = f"""o0 AS (SELECT *, x_mm::DOUBLE AS xd, y_mm::DOUBLE AS yd FROM p),
o AS (SELECT frame_id, point_idx, x_mm, y_mm, z_mm, i_pct, least(floor(sqrt(xd * xd + yd * yd) / sqrt(4825000000.0::DOUBLE) * 16), 15)::INTEGER AS ring, least(floor((atan2(yd, xd) + {_PI}) / (2 * {_PI}) * 32), 31)::INTEGER AS sector FROM o0)"""
_GROUND = f"""{_POLAR}, g AS (SELECT *, coalesce(min(CASE WHEN z_mm BETWEEN -2400 AND -1250 THEN z_mm END) OVER (PARTITION BY frame_id, ring, sector), -1600) AS seed FROM o),
gs AS (SELECT *, CASE WHEN x_mm * x_mm + y_mm * y_mm < 1000000 THEN z_mm <= -1550 ELSE z_mm <= -1250 AND z_mm - seed BETWEEN -50 AND 180 END AS is_ground FROM g)"""
_RAYS = f"""r0 AS (SELECT *, sqrt(x_mm::DOUBLE * x_mm + y_mm::DOUBLE * y_mm) AS r, least(greatest(floor((atan2(y_mm::DOUBLE, x_mm::DOUBLE) + {_PI}) / (2 * {_PI} / 64)), 0), 63) AS ray FROM gs WHERE is_ground),
r1 AS (SELECT *, count(*) OVER (PARTITION BY frame_id) AS n, lead(r) OVER w - r AS dr, z_mm - lead(z_mm) OVER w AS drop_mm FROM r0 WINDOW w AS (PARTITION BY frame_id, ray ORDER BY r, point_idx)),
drops AS (SELECT frame_id, point_idx, x_mm, y_mm, z_mm, drop_mm FROM r1 WHERE n >= 50 AND dr >= 400 AND drop_mm >= 150)"""
_CENTRED = "lc AS (SELECT *, -40000 + (gx + 0.5::DOUBLE) * size_mm AS x, -35000 + (gy + 0.5::DOUBLE) * size_mm AS y FROM ev)"
_SUMMED = "SELECT frame_id, size_mm, gx, gy, cost::INTEGER AS cost FROM fin"
_LABEL = "CASE WHEN z_mm + 1600 >= 1000 THEN 2 WHEN z_mm + 1600 > 150 THEN 1 ELSE 0 END"
_IMAGE = lambda sign: f"""i0 AS (SELECT *, x_mm / 1000.0::DOUBLE AS x, y_mm / 1000.0::DOUBLE AS y, z_mm / 1000.0::DOUBLE AS z FROM p), i1 AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM i0),
i2 AS (SELECT *, floor(0.5::DOUBLE * (1 - ({sign}atan2(y, x)) / {_PI}) * 1024) AS u, floor((1 - (degrees(asin(z / greatest(r, 1e-9))) + 25) / 28.0::DOUBLE) * 64) AS v FROM i1)"""  # noqa: E731
_AHEAD = "a AS (SELECT *, x + vx * h AS cx, y + vy * h AS cy FROM t, (VALUES (1.0::DOUBLE), (2), (3)) v(h) WHERE is_dynamic)"
_M = lambda e, s="1e6": f"round(({e}) * {s})::BIGINT"
_VERTICES = " + ".join(f"round((cx + sa * cos({i} * (2 * {_PI} / 16)) * cos(hd) - sb * sin({i} * (2 * {_PI} / 16)) * sin(hd)) * 1e4)::BIGINT" for i in range(16))

ORACLE = {
    "ground_seed_table": f"WITH {WIDE}, {_POLAR} SELECT frame_id, ring, sector, min(z_mm) AS seed FROM o WHERE z_mm BETWEEN -2400 AND -1250 GROUP BY 1, 2, 3",
    "ground_split": f"WITH {WIDE}, {_GROUND} SELECT frame_id, point_idx, is_ground FROM gs",
    "plane_covariance": f"""WITH {P}, s AS (SELECT *, greatest(count(*) OVER (PARTITION BY frame_id) // 300, 1) AS st, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS r FROM p)
      SELECT frame_id, count(*) AS n, sum(x_mm)::BIGINT AS sx, sum(y_mm)::BIGINT AS sy, sum(z_mm)::BIGINT AS sz, sum(x_mm * x_mm)::BIGINT AS sxx, sum(x_mm * y_mm)::BIGINT AS sxy, sum(x_mm * z_mm)::BIGINT AS sxz,
      sum(y_mm * y_mm)::BIGINT AS syy, sum(y_mm * z_mm)::BIGINT AS syz, sum(z_mm * z_mm)::BIGINT AS szz FROM s WHERE r % st = 0 GROUP BY 1""",
    "ground_residual": f"WITH {P} SELECT frame_id, point_idx, least(greatest(z_mm - min(z_mm) OVER (PARTITION BY frame_id, floor(x_mm / 1000.0::DOUBLE), floor(y_mm / 1000.0::DOUBLE)), -300), 1200) AS residual_mm FROM p",
    "threat_mask_fallback": f"""WITH {P}, r AS (SELECT *, z_mm - min(z_mm) OVER (PARTITION BY frame_id, floor(x_mm / 1000.0::DOUBLE), floor(y_mm / 1000.0::DOUBLE)) AS res, min(i_pct) OVER (PARTITION BY frame_id) AS lo, max(i_pct) OVER (PARTITION BY frame_id) AS hi FROM p)
      SELECT frame_id, point_idx, res > 15 AND res < 50 AND hi > lo AND (i_pct - lo) * 10 > (hi - lo) * 7 AS is_threat FROM r""",
    "thin_hazards": f"""WITH {P}, h AS (SELECT *, z_mm + 1600 AS h FROM p WHERE z_mm + 1600 BETWEEN 10 AND 80), q AS (SELECT *, 1 / (1 + exp(-(h / 1000.0::DOUBLE * 5.5::DOUBLE / 0.55::DOUBLE * 1.5::DOUBLE + least(i_pct / 100.0::DOUBLE, 1) / 0.25::DOUBLE * 1.2::DOUBLE - 2.5::DOUBLE))) AS p FROM h),
      g AS (SELECT frame_id, floor(x_mm / 350.0::DOUBLE)::BIGINT AS gx, floor(y_mm / 350.0::DOUBLE)::BIGINT AS gy, min(point_idx) AS first, count(*) AS n, sum(x_mm)::BIGINT AS sum_x, sum(y_mm)::BIGINT AS sum_y, sum(z_mm)::BIGINT AS sum_z,
            min(x_mm) AS x_lo, max(x_mm) AS x_hi, min(y_mm) AS y_lo, max(y_mm) AS y_hi, max(p) AS p FROM q WHERE p >= 0.75 GROUP BY 1, 2, 3 HAVING count(*) >= 5)
      SELECT * REPLACE ({_M('p')} AS p), greatest(x_hi - x_lo, y_hi - y_lo) + 200 AS radius FROM g QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY first) <= 20""",
    "height_labels": f"WITH {P} SELECT frame_id, point_idx, {_LABEL} AS label FROM p",
    "label_partition": f"WITH {P}, l AS (SELECT *, {_LABEL} AS label FROM p) SELECT frame_id, count(*) FILTER (label = 0) AS ground, count(*) FILTER (label = 1) AS vegetation, count(*) FILTER (label = 2) AS rigid, count(*) FILTER (label = 3) AS dynamic, count(*) FILTER (label >= 2) AS obstacle FROM l GROUP BY 1",
    "point_windows": f"""WITH {P}, w AS (SELECT frame_id, point_idx // 512 AS w, point_idx % 512 AS i, z_mm FROM p), n AS (SELECT DISTINCT frame_id, w FROM w)
      SELECT frame_id, w, string_agg(coalesce(z_mm, 0)::VARCHAR, ',' ORDER BY i) AS heights FROM (SELECT n.frame_id, n.w, r.i FROM n, range(512) r(i)) LEFT JOIN w USING (frame_id, w, i) GROUP BY 1, 2""",
    "point_windows_strided": f"""WITH {P}, w AS (SELECT frame_id, k AS w, point_idx - k * 128 AS i, z_mm FROM (SELECT *, unnest(range(greatest(0, ceil((point_idx - 511) / 128.0::DOUBLE)::BIGINT), point_idx // 128 + 1)) AS k FROM p)), n AS (SELECT DISTINCT frame_id, w FROM w)
      SELECT frame_id, w, string_agg(coalesce(z_mm, 0)::VARCHAR, ',' ORDER BY i) AS heights FROM (SELECT n.frame_id, n.w, r.i FROM n, range(512) r(i)) LEFT JOIN w USING (frame_id, w, i) GROUP BY 1, 2""",
    "range_image": f"WITH {WIDE}, {_IMAGE('')} SELECT frame_id, v::INTEGER AS v, u::INTEGER AS u, point_idx, {_M('r', '1e4')} AS r FROM i2 WHERE r > 0.1 AND u BETWEEN 0 AND 1023 AND v BETWEEN 0 AND 63 QUALIFY row_number() OVER (PARTITION BY frame_id, v, u ORDER BY r, point_idx) = 1",
    "range_image_mirrored": f"WITH {WIDE}, {_IMAGE('-')} SELECT frame_id, v::INTEGER AS v, u::INTEGER AS u, point_idx FROM (SELECT * REPLACE (least(greatest(u, 0), 1023) AS u) FROM i2) WHERE r > 0.5 AND r < 80 AND v BETWEEN 0 AND 63 QUALIFY row_number() OVER (PARTITION BY frame_id, v, u ORDER BY r, point_idx) = 1",
    "trench_rays": f"WITH {WIDE}, {_GROUND}, {_RAYS} SELECT * FROM drops",
    "rollout_cones": f"""WITH {P}, {TRACKS}, {_AHEAD}, c AS (SELECT *, greatest(length, 0.5) / 2 + 0.12::DOUBLE * sqrt(vx * vx + vy * vy) * h + 0.15::DOUBLE * h AS sa, greatest(width, 0.5) / 2 + 0.08::DOUBLE * h + 0.1::DOUBLE AS sb, atan2(vy, vx) AS hd FROM a)
      SELECT frame_id, track_id, h AS t, {_M('cx')} AS cx, {_M('cy')} AS cy, {_M('sa')} AS semi_major, {_M('sb')} AS semi_minor, {_M('hd')} AS heading, {_VERTICES} AS px FROM c""",
    "rollout_top5": f"""WITH {P}, {TRACKS}, {_AHEAD}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY cx * cx + cy * cy, track_id, h)::INTEGER AS rank FROM a)
      SELECT frame_id, rank, track_id, h AS t, {_M('cx')} AS x, {_M('cy')} AS y, {_M('greatest(width, 0.5) / 2 + 0.08::DOUBLE * h + 0.05::DOUBLE')} AS radius, CASE WHEN h <= 1 THEN 255 WHEN h <= 2 THEN 180 ELSE 120 END AS cost FROM k WHERE rank <= 5""",
    "hazard_stamp": f"""WITH {P}, {BOXES}, {leaves_sql()}, {_CENTRED}, hz AS (SELECT frame_id, (x_lo + x_hi) / 2.0::DOUBLE AS hx, (y_lo + y_hi) / 2.0::DOUBLE AS hy, track_id * 500 + 700 AS r, CASE WHEN track_id = 0 THEN 255 ELSE 120 END AS hc FROM b),
      fin AS (SELECT lc.* REPLACE (greatest(cost, coalesce((SELECT max(hc) FROM hz WHERE hz.frame_id = lc.frame_id AND (hx - x) ** 2 + (hy - y) ** 2 <= r * r), 0)) AS cost) FROM lc) {_SUMMED}""",
    "dropoff_stamp": f"""WITH {WIDE}, {_GROUND}, {_RAYS}, {leaves_sql()}, {_CENTRED},
      fin AS (SELECT lc.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM drops d WHERE d.frame_id = lc.frame_id AND (d.x_mm - x) ** 2 + (d.y_mm - y) ** 2 <= 360000) THEN 255 ELSE cost END AS cost) FROM lc) {_SUMMED}""",
    "obstacle_occupancy": f"""WITH {P}, {leaves_sql()}, ob AS (SELECT frame_id, floor((x_mm + 40000) / 250.0::DOUBLE) AS bx, floor((y_mm + 35000) / 250.0::DOUBLE) AS byy, z_mm FROM p WHERE z_mm > -1300),
      hit AS (SELECT l.frame_id, l.gx, l.gy, l.size_mm, count(*) AS on_, max(ob.z_mm) AS oz FROM ev l JOIN ob ON ob.frame_id = l.frame_id AND bx BETWEEN floor((l.gx * l.size_mm + 0.1) / 250) AND floor(((l.gx + 1) * l.size_mm - 0.1) / 250)
              AND byy BETWEEN floor((l.gy * l.size_mm + 0.1) / 250) AND floor(((l.gy + 1) * l.size_mm - 0.1) / 250) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
      j AS (SELECT ev.* REPLACE (greatest(z_max, coalesce(oz, z_max)) AS z_max), on_, oz FROM ev LEFT JOIN hit USING (frame_id, gx, gy, size_mm)),
      j2 AS (SELECT * REPLACE (CASE WHEN oz IS NOT NULL THEN greatest(dz, z_max - z_min) ELSE dz END AS dz) FROM j),
      fin AS (SELECT * REPLACE (CASE WHEN mean_z BETWEEN -2200 AND -1250 AND dz <= 180 AND z_max <= -1150 THEN 0 WHEN on_ IS NOT NULL AND (NOT (cost = 0 AND mean_z BETWEEN -2150 AND -1350 AND dz <= 150) OR on_ >= 5) THEN 255 ELSE cost END AS cost) FROM j2) {_SUMMED}""",
    "vegetation_scale": f"""WITH {P}, {leaves_sql()}, m AS (SELECT frame_id, floor((x_mm + 40000) / 500.0::DOUBLE) AS kx, floor((y_mm + 35000) / 500.0::DOUBLE) AS ky, max({_LABEL}) AS label FROM p WHERE {_LABEL} > 0 GROUP BY 1, 2, 3),
      fin AS (SELECT e.* REPLACE (CASE WHEN label = 2 THEN 255 WHEN label = 1 AND NOT (dz > 120 AND (mean_z > -1200 OR z_max > -1200)) THEN least(cost, 20) ELSE cost END AS cost)
        FROM ev e LEFT JOIN m ON m.frame_id = e.frame_id AND kx = floor((gx + 0.5::DOUBLE) * size_mm / 500) AND ky = floor((gy + 0.5::DOUBLE) * size_mm / 500)) {_SUMMED}""",
    "trench_3x3_median": f"""WITH {P}, c AS (SELECT frame_id, floor(x_mm / 500.0::DOUBLE)::BIGINT AS gx, floor(y_mm / 500.0::DOUBLE)::BIGINT AS gy, round(sum(z_mm) * 1000 / count(*)::DOUBLE)::BIGINT AS z_um FROM p GROUP BY 1, 2, 3),
      n AS (SELECT a.frame_id, a.gx, a.gy, a.z_um, count(*) AS k, median(b.z_um) AS m FROM c a JOIN c b ON a.frame_id = b.frame_id AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY 1, 2, 3, 4)
      SELECT frame_id, gx, gy, z_um, round(m * 2)::BIGINT AS baseline2, round((m - z_um) * 2)::BIGINT AS drop2 FROM n WHERE k >= 3""",
    "point_cost_containment": f"""WITH {P}, {leaves_sql()}, {_CENTRED},
      on_ AS (SELECT frame_id, 500 AS size_mm, floor((x_mm + a + 40000) / 500.0::DOUBLE)::BIGINT AS gx, floor((y_mm + b + 35000) / 500.0::DOUBLE)::BIGINT AS gy FROM p, (VALUES (0), (-1)) va(a), (VALUES (0), (-1)) vb(b)
              UNION SELECT frame_id, 125, floor((x_mm + a + 40000) / 125.0::DOUBLE)::BIGINT, floor((y_mm + b + 35000) / 125.0::DOUBLE)::BIGINT FROM p, (VALUES (0), (-1)) va(a), (VALUES (0), (-1)) vb(b)),
      fin AS (SELECT lc.* REPLACE (CASE WHEN on_.frame_id IS NOT NULL THEN greatest(cost, 255) ELSE cost END AS cost) FROM lc LEFT JOIN on_ USING (frame_id, size_mm, gx, gy)) {_SUMMED}""",
}
ORACLE["excluded_points_grid"] = f"""WITH p0 AS (SELECT * FROM ({P[len("p AS ("):-1]})), {BOXES.replace("FROM p)", "FROM p0)")},
  p AS (SELECT * FROM p0 WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.frame_id = p0.frame_id AND x_mm BETWEEN x_lo - 200 AND x_hi + 200 AND y_mm BETWEEN y_lo - 200 AND y_hi + 200 AND z_mm BETWEEN z_lo - 200 AND z_hi + 200)), {leaves_sql()}
  SELECT frame_id, size_mm, gx, gy, cost FROM ev"""
