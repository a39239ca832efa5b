"""Queries over elevation cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.config import Bounds
from gridloom.operators import cells as op
from gridloom.plans.common import IN_BOX, WIDE, P, points, wide, greedy_sql

NEAR = Bounds(-8000, 8000, -4000, 4000)


def _micro(c):
    return F.round(F.col(c) * 1e6).cast("bigint").alias(c)


def _leaves(s, d):
    return op.leaves(points(s, d))


def _shown(df):
    return df.select("frame_id", "size_mm", "gx", "gy", "z_min", "z_max", "dz", "n", F.round(F.col("mean_z") * 1000).cast("bigint").alias("mean_um"), "cost")


def _coarse(s, d):
    return op.classify(op.coarse(op.within_bounds(points(s, d)).withColumn("cost", F.lit(0))))


def _multi(s, d):
    c = op.statistics(points(s, d), 500)
    return c.select("frame_id", "gx", "gy", op.multifactor_cost(F.col("dz"), F.col("slope"), F.col("variance"), F.lit(10.0), F.lit(5.0)).alias("cost"))


def _point_costs(s, d):
    return op.evaluate(op.leaves(points(s, d).withColumn("cost", F.when(F.col("point_idx") % 211 == 0, 255).when(F.col("point_idx") % 97 == 0, 120).otherwise(0)))).groupBy("frame_id", "size_mm", "cost").agg(F.count(F.lit(1)).alias("cells"))


QUERIES = {
    "band_counts_by_frame": lambda s, d: op.band_counts(op.evaluate(_leaves(s, d))),
    "uniform_cells": lambda s, d: op.uniform(points(s, d)),
    "cell_stats": lambda s, d: op.statistics(points(s, d), 500).select("frame_id", "gx", "gy", "z_min", "z_max", "dz", "n", "sum_z", _micro("variance"), _micro("slope")),
    "coarse_cells": lambda s, d: _coarse(s, d).select("frame_id", "gx", "gy", "z_min", "z_max", "n", "sum_z", "n_obstacle", "n_ground", "kind"),
    "fine_cells": lambda s, d: _shown(_leaves(s, d).where("size_mm = 125")),
    "adaptive_leaves": lambda s, d: _shown(_leaves(s, d)),
    "evaluate_costs": lambda s, d: _shown(op.evaluate(_leaves(s, d))),
    "point_cost_leaves": _point_costs,
    "cost_bands": lambda s, d: op.evaluate(_leaves(s, d)).groupBy(op.band(F.col("cost")).alias("band")).agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("points")),
    "quad_split_levels": lambda s, d: op.split_levels(points(s, d)),
    "foveated_cells": lambda s, d: op.foveated(wide(s, d)).select("frame_id", "zone", "size_mm", "ix", "iy", "z_min", "z_max", "dz", "n", "sum_z", _micro("variance"), "cost"),
    "foveated_snapped": lambda s, d: op.snapped(op.foveated(wide(s, d))).select("frame_id", "zone", "ix", "iy", F.round(F.col("x") * 1e4).cast("bigint").alias("x"), F.round(F.col("y") * 1e4).cast("bigint").alias("y"), "cell_id"),
    "foveated_resolved": lambda s, d: op.resolve_overlaps(op.snapped(op.foveated(wide(s, d)))).groupBy("frame_id", "zone").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("points")),
    "zone_counts": lambda s, d: op.foveated(wide(s, d)).groupBy("frame_id", "zone").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("points")),
    "unobserved_cells": lambda s, d: op.unobserved(op.uniform(points(s, d), 500).withColumn("gx", F.col("gx") + 16).withColumn("gy", F.col("gy") + 8), NEAR, 500),
    "multifactor_cost": _multi,
    "memory_model": lambda s, d: op.memory_model(op.band_counts(_leaves(s, d)).select("frame_id", "leaves")).select("frame_id", "leaves", "leaf_bytes", "uniform_bytes", _micro("saved_percent")),
}

_SLOPE = lambda size, above=10: f"CASE WHEN dz > {above} THEN degrees(atan2(dz::DOUBLE, {size}::DOUBLE)) ELSE 0 END"
_DRIVE = "mean_z BETWEEN -2200 AND -1250 AND dz <= 180 AND z_max <= -1150"
_EVALUATED = f"""CASE WHEN cost = 100 THEN 100 WHEN {_DRIVE} THEN 0 WHEN cost >= 255 THEN cost
  WHEN (mean_z > -1200 AND n >= 3) OR dz > 250 OR mean_z < -2150 OR slope >= 38 THEN 255
  WHEN dz > 150 OR mean_z > -1350 OR slope > 20 THEN floor(51 + least(greatest(CASE WHEN dz > 150 THEN (dz - 150) / 100.0::DOUBLE ELSE 0 END,
       CASE WHEN mean_z > -1350 THEN (mean_z + 1350) / 150.0::DOUBLE ELSE 0 END, CASE WHEN slope > 20 THEN (slope - 20) / 18.0::DOUBLE ELSE 0 END, 0), 1) * 129)
  ELSE floor(slope * 2.5::DOUBLE) END::INTEGER"""


def leaves_sql(cost: str = "0") -> str:
    """CTEs up to leaf (evaluated: ev) over p, with a cost for each point."""
    return f"""q AS (SELECT *, {cost} AS pc, least(floor((x_mm + 40000) / 500.0::DOUBLE), 199)::BIGINT AS cx, least(floor((y_mm + 35000) / 500.0::DOUBLE), 139)::BIGINT AS cy FROM p WHERE {IN_BOX}),
c0 AS (SELECT frame_id, cx AS gx, cy AS gy, min(z_mm) AS z_min, max(z_mm) AS z_max, count(*) AS n, sum(z_mm)::BIGINT AS sum_z, count(*) FILTER (z_mm > -1200 OR pc >= 181) AS n_obstacle,
       count(*) FILTER (z_mm BETWEEN -2100 AND -1350) AS n_ground, max(pc) AS point_cost FROM q GROUP BY 1, 2, 3),
c1 AS (SELECT *, z_max - z_min AS dz, sum_z / n::DOUBLE AS mean_z, sum_z >= -2150 * n AND sum_z <= -1350 * n AND z_max - z_min <= 200 AS flat FROM c0),
c AS (SELECT *, CASE WHEN n < 3 THEN 'sparse' WHEN NOT flat AND (n_obstacle >= 2 OR point_cost >= 181) THEN 'solid'
       WHEN NOT flat AND (dz > 180 OR z_max > -1200 OR point_cost > 50) THEN 'fine' ELSE 'coarse' END AS kind FROM c1),
f AS (SELECT q.frame_id, least(floor((x_mm + 40000) / 125.0::DOUBLE), 799)::BIGINT AS gx, least(floor((y_mm + 35000) / 125.0::DOUBLE), 559)::BIGINT AS gy, min(z_mm) AS z_min, max(z_mm) AS z_max, count(*) AS n, max(pc) AS point_cost
      FROM q JOIN c ON c.kind = 'fine' AND q.frame_id = c.frame_id AND q.cx = c.gx AND q.cy = c.gy GROUP BY 1, 2, 3),
l0 AS (SELECT frame_id, 500 AS size_mm, gx, gy, z_min, z_max, dz, n, mean_z, point_cost FROM c WHERE kind IN ('coarse', 'solid')
       UNION ALL SELECT frame_id, 125, gx, gy, z_min, z_max, z_max - z_min, n, (z_min + z_max) / 2.0::DOUBLE, point_cost FROM f),
l1 AS (SELECT *, {_SLOPE('size_mm')} AS slope FROM l0),
leaf AS (SELECT *, CASE WHEN {_DRIVE} THEN 0 WHEN ((dz > 250 OR z_max > -1150) AND n >= 3) OR point_cost >= 181 THEN 255 WHEN point_cost > 0 THEN point_cost
         WHEN dz > 150 OR mean_z > -1350 OR slope > 20 THEN 100 ELSE 0 END::INTEGER AS cost FROM l1),
ev AS (SELECT * REPLACE ({_EVALUATED} AS cost) FROM leaf)"""


_SHOWN = "frame_id, size_mm, gx, gy, z_min, z_max, dz, n, round(mean_z * 1000)::BIGINT AS mean_um, cost"
_BAND = "CASE WHEN cost <= 50 THEN 'safe' WHEN cost <= 180 THEN 'caution' ELSE 'lethal' END"
_COUNTS = f"""SELECT frame_id, count(*) AS leaves, count(*) FILTER ({_BAND} = 'safe') AS safe, count(*) FILTER ({_BAND} = 'caution') AS caution, count(*) FILTER ({_BAND} = 'lethal') AS lethal,
count(*) FILTER (size_mm = 500) AS coarse, count(*) FILTER (size_mm = 125) AS fine FROM ev GROUP BY 1"""
_FOV = f"""z0 AS (SELECT *, x_mm * x_mm + y_mm * y_mm AS d2 FROM p WHERE x_mm BETWEEN -100000 AND 100000 AND y_mm BETWEEN -50000 AND 50000),
z1 AS (SELECT *, CASE WHEN d2 < 100000000 THEN 1 WHEN d2 < 625000000 THEN 2 WHEN d2 < 2500000000 THEN 3 WHEN d2 <= 10000000000 THEN 4 END AS zone FROM z0),
z2 AS (SELECT *, CASE zone WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 250 ELSE 500 END AS size_mm FROM z1 WHERE zone IS NOT NULL),
fov AS (SELECT frame_id, zone, size_mm, floor(x_mm / size_mm::DOUBLE)::BIGINT AS ix, floor(y_mm / size_mm::DOUBLE)::BIGINT AS iy, min(z_mm) AS z_min, max(z_mm) AS z_max, max(z_mm) - min(z_mm) AS dz, count(*) AS n,
        sum(z_mm)::BIGINT AS sum_z, (count(*) * sum(z_mm * z_mm) - sum(z_mm) * sum(z_mm))::DOUBLE / (count(*) * count(*))::DOUBLE / 1e6 AS variance FROM z2 GROUP BY 1, 2, 3, 4, 5)"""
_STATS = f"""c0 AS (SELECT frame_id, floor(x_mm / 500.0::DOUBLE)::BIGINT AS gx, floor(y_mm / 500.0::DOUBLE)::BIGINT AS gy, min(z_mm) AS z_min, max(z_mm) AS z_max, max(z_mm) - min(z_mm) AS dz, count(*) AS n, sum(z_mm)::BIGINT AS sum_z,
  (count(*) * sum(z_mm * z_mm) - sum(z_mm) * sum(z_mm))::DOUBLE / (count(*) * count(*))::DOUBLE / 1e6 AS variance FROM p GROUP BY 1, 2, 3),
st AS (SELECT *, {_SLOPE(500, 9)} AS slope FROM c0)"""
_LEVEL = lambda k, src: f"""k{k} AS (SELECT *, floor((x_mm + 40000) * 2 / {1000 >> k}.0::DOUBLE)::BIGINT AS gx, floor((y_mm + 35000) * 2 / {1000 >> k}.0::DOUBLE)::BIGINT AS gy FROM {src}),
s{k} AS (SELECT frame_id, gx, gy, min(z_mm) AS z_min, max(z_mm) AS z_max, count(*) AS n, count(*) >= 3 AND max(z_mm) - min(z_mm) > 180 AS split, count(*) FILTER (z_mm > -1200) >= 3 AS high FROM k{k} GROUP BY 1, 2, 3),
p{k + 1} AS (SELECT frame_id, x_mm, y_mm, z_mm FROM k{k} SEMI JOIN (SELECT * FROM s{k} WHERE split {'AND NOT high' if k == 0 else ''}) USING (frame_id, gx, gy))"""  # noqa: E731

_SNAP = """a AS (SELECT frame_id, zone, ix, iy, size_mm / 2000.0::DOUBLE AS h, (ix + 0.5::DOUBLE) * size_mm / 1000.0::DOUBLE AS x, (iy + 0.5::DOUBLE) * size_mm / 1000.0::DOUBLE AS y, size_mm, n FROM fov),
      b AS (SELECT *, sqrt(x * x + y * y) AS dist, sqrt(greatest(abs(x) - h, 0) ** 2 + greatest(abs(y) - h, 0) ** 2) AS rn, sqrt((abs(x) + h) ** 2 + (abs(y) + h) ** 2) AS rf FROM a),
      c AS (SELECT *, CASE WHEN NOT ((rn < 10 AND rf > 10) OR (rn < 25 AND rf > 25) OR (rn < 50 AND rf > 50)) THEN 0
            WHEN zone = 1 AND rf >= 10 THEN -(rf - 10 + 1e-4) WHEN zone = 2 AND rn < 10 THEN 10 - rn + 1e-4 WHEN zone = 2 AND rf >= 25 THEN -(rf - 25 + 1e-4)
            WHEN zone = 3 AND rn < 25 THEN 25 - rn + 1e-4 WHEN zone = 3 AND rf >= 50 THEN -(rf - 50 + 1e-4) WHEN zone = 4 AND rn < 50 THEN 50 - rn + 1e-4 ELSE 0 END AS shift FROM b),
      e AS (SELECT *, x * (1 + shift / dist) AS x2, y * (1 + shift / dist) AS y2 FROM c)"""

ORACLE = {
    "band_counts_by_frame": f"WITH {P}, {leaves_sql()} {_COUNTS}",
    "uniform_cells": f"WITH {P} SELECT frame_id, floor(x_mm / 50.0::DOUBLE)::BIGINT AS gx, floor(y_mm / 50.0::DOUBLE)::BIGINT AS gy, min(z_mm) AS z_min, max(z_mm) AS z_max, count(*) AS n, sum(z_mm)::BIGINT AS sum_z FROM p GROUP BY 1, 2, 3",
    "cell_stats": f"WITH {P}, {_STATS} SELECT * REPLACE (round(variance * 1e6)::BIGINT AS variance, round(slope * 1e6)::BIGINT AS slope) FROM st",
    "coarse_cells": f"WITH {P}, {leaves_sql()} SELECT frame_id, gx, gy, z_min, z_max, n, sum_z, n_obstacle, n_ground, kind FROM c",
    "fine_cells": f"WITH {P}, {leaves_sql()} SELECT {_SHOWN} FROM leaf WHERE size_mm = 125",
    "adaptive_leaves": f"WITH {P}, {leaves_sql()} SELECT {_SHOWN} FROM leaf",
    "evaluate_costs": f"WITH {P}, {leaves_sql()} SELECT {_SHOWN} FROM ev",
    "point_cost_leaves": f"WITH {P}, {leaves_sql('CASE WHEN point_idx % 211 = 0 THEN 255 WHEN point_idx % 97 = 0 THEN 120 ELSE 0 END')} SELECT frame_id, size_mm, cost, count(*) AS cells FROM ev GROUP BY 1, 2, 3",
    "cost_bands": f"WITH {P}, {leaves_sql()} SELECT {_BAND} AS band, count(*) AS leaves, sum(n)::BIGINT AS points FROM ev GROUP BY 1",
    "quad_split_levels": f"""WITH {P}, p0 AS (SELECT frame_id, x_mm, y_mm, z_mm FROM p WHERE {IN_BOX}), {_LEVEL(0, 'p0')}, {_LEVEL(1, 'p1')}, {_LEVEL(2, 'p2')}, {_LEVEL(3, 'p3')}
      SELECT frame_id, 0 AS depth, gx, gy, z_min, z_max, n, CASE WHEN split THEN 255 ELSE -1 END AS cost FROM s0 WHERE NOT split OR high
      UNION ALL SELECT frame_id, 1, gx, gy, z_min, z_max, n, -1 FROM s1 WHERE NOT split UNION ALL SELECT frame_id, 2, gx, gy, z_min, z_max, n, -1 FROM s2 WHERE NOT split
      UNION ALL SELECT frame_id, 3, gx, gy, z_min, z_max, n, -1 FROM s3""",
    "foveated_cells": f"WITH {WIDE}, {_FOV} SELECT * REPLACE (round(variance * 1e6)::BIGINT AS variance), CASE WHEN dz > 250 OR z_max > -1150 THEN 255 WHEN dz > 150 THEN 100 ELSE 0 END AS cost FROM fov",
    "foveated_snapped": f"""WITH {WIDE}, {_FOV}, {_SNAP}
      SELECT frame_id, zone, ix, iy, round(x2 * 1e4)::BIGINT AS x, round(y2 * 1e4)::BIGINT AS y, printf('z%d_%.2fm_%+09.4f_%+09.4f', zone, size_mm / 1000.0::DOUBLE, x2, y2) AS cell_id FROM e""",
    "foveated_resolved": f"""WITH RECURSIVE {WIDE}, {_FOV}, {_SNAP},
      o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY zone, size_mm, printf('z%d_%.2fm_%+09.4f_%+09.4f', zone, size_mm / 1000.0::DOUBLE, x2, y2), x2, y2) AS nth, floor((x2 * 1000 - size_mm / 2.0::DOUBLE + 1) / 50)::BIGINT AS x_lo,
            floor((x2 * 1000 + size_mm / 2.0::DOUBLE - 1) / 50)::BIGINT AS x_hi, floor((y2 * 1000 - size_mm / 2.0::DOUBLE + 1) / 50)::BIGINT AS y_lo, floor((y2 * 1000 + size_mm / 2.0::DOUBLE - 1) / 50)::BIGINT AS y_hi FROM e),
      ed AS (SELECT l.frame_id, l.nth AS better, r.nth AS worse FROM o l JOIN o r ON l.frame_id = r.frame_id AND l.nth < r.nth AND l.x_lo <= r.x_hi AND r.x_lo <= l.x_hi AND l.y_lo <= r.y_hi AND r.y_lo <= l.y_hi),
      {greedy_sql('ed', 'frame_id')}
      SELECT frame_id, zone, count(*) AS cells, sum(n)::BIGINT AS points FROM o ANTI JOIN gone ON gone.frame_id = o.frame_id AND gone.worse = o.nth GROUP BY 1, 2""",
    "zone_counts": f"WITH {WIDE}, {_FOV} SELECT frame_id, zone, count(*) AS cells, sum(n)::BIGINT AS points FROM fov GROUP BY 1, 2",
    "unobserved_cells": f"""WITH {P}, u AS (SELECT DISTINCT frame_id, floor(x_mm / 500.0::DOUBLE)::BIGINT + 16 AS gx, floor(y_mm / 500.0::DOUBLE)::BIGINT + 8 AS gy FROM p)
      SELECT frame_id, gx, gy, -1 AS cost FROM (SELECT DISTINCT frame_id FROM p), range(32) a(gx), range(16) b(gy) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.frame_id = p.frame_id AND u.gx = a.gx AND u.gy = b.gy)""",
    "multifactor_cost": f"WITH {P}, {_STATS} SELECT frame_id, gx, gy, floor(least(greatest(dz / 1000.0::DOUBLE / 0.2::DOUBLE * 80.0::DOUBLE + slope / 25.0::DOUBLE * 60.0::DOUBLE + variance / 0.05::DOUBLE * 40.0::DOUBLE + 10 + 5, 0), 255))::INTEGER AS cost FROM st",
    "memory_model": f"""WITH {P}, {leaves_sql()} SELECT frame_id, count(*) AS leaves, count(*) * 256 + 262144 AS leaf_bytes, 134400000 AS uniform_bytes,
      round(100.0::DOUBLE * (134400000 - (count(*) * 256 + 262144)) / 134400000 * 1e6)::BIGINT AS saved_percent FROM leaf GROUP BY 1""",
}
ORACLE["unobserved_cells"] = ORACLE["unobserved_cells"].replace("FROM (SELECT DISTINCT frame_id FROM p),", "FROM (SELECT DISTINCT frame_id FROM p) p,")
