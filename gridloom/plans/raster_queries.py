"""Queries over rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import cells, raster
from gridloom.plans.cell_queries import leaves_sql
from gridloom.plans.common import BOXES, P, boxes, points


def _leaves(s, d):
    return cells.evaluate(cells.leaves(points(s, d)))


def _table(s, d):
    return raster.cell_table(_leaves(s, d))


def _hazards(s, d):
    return boxes(s, d).select("frame_id", F.expr("(x_lo + x_hi) div 2").alias("x"), F.expr("(y_lo + y_hi) div 2").alias("y"), F.lit(700).alias("radius"), F.when(F.col("track_id") == 0, 255).otherwise(120).alias("cost"), F.col("track_id").alias("rank"))


def _times(s, d):
    return points(s, d).select("frame_id").distinct().select("frame_id", (F.col("frame_id") * 0.25 + 1000).alias("t"))


QUERIES = {
    "raster_cells": lambda s, d: _table(s, d),
    "closing_bridge": lambda s, d: raster.bridged(_table(s, d)),
    "closing_forward": lambda s, d: raster.closed(_table(s, d).where("ground").select(*raster.KEY), 6, 3),
    "gap_width": lambda s, d: raster.gaps(_table(s, d), raster.bridged(_table(s, d))),
    "inpaint_classes": lambda s, d: raster.inpainted(_table(s, d)),
    "beam_gap_fill": lambda s, d: raster.beam_gaps(_leaves(s, d)).withColumn("z_um", (F.col("z_um") * 2).cast("bigint")),
    "clearance_coarsen": lambda s, d: raster.coarsened(_leaves(s, d)).select("frame_id", "size_mm", "gx", "gy", "z_min", "z_max", "dz", "n", "cost"),
    "occupancy_grid": lambda s, d: raster.occupancy_grid(_leaves(s, d), _hazards(s, d)),
    "occupancy_message": lambda s, d: raster.grid_message(raster.occupancy_grid(_leaves(s, d)), time=_times(s, d)).select("frame_id", F.col("header.stamp.sec").alias("sec"), F.col("header.stamp.nanosec").alias("nanosec"), F.col("info.origin_x").alias("origin_x"), F.col("info.resolution").alias("resolution"), "width", "height", F.md5(F.array_join(F.transform("data", lambda v: v.cast("string")), ",").cast("binary")).alias("data_md5")),
    "beam_gap_fill_capped": lambda s, d: raster.beam_gaps(_leaves(s, d), 20).withColumn("z_um", (F.col("z_um") * 2).cast("bigint")),
}

_TABLE = """rc0 AS (SELECT frame_id, CASE WHEN size_mm = 125 THEN gx // 4 ELSE gx END AS gx, CASE WHEN size_mm = 125 THEN gy // 4 ELSE gy END AS gy, size_mm, gx AS ox, gy AS oy,
  cost <= 50 AND mean_z BETWEEN -2100 AND -1350 AND dz <= 180 AS g, round(mean_z * 1000)::BIGINT AS z FROM ev),
rc AS (SELECT frame_id, gx, gy, bool_or(g) AS ground, arg_max(z, (-size_mm, oy, ox)) FILTER (g) AS z_um FROM rc0 GROUP BY 1, 2, 3), gr AS (SELECT frame_id, gx, gy, z_um FROM rc WHERE ground)"""


def _closed(name: str, rx: int, ry: int) -> str:
    """CTEs of the closing of gr by whole boxes."""
    n = (2 * rx + 1) * (2 * ry + 1)
    return f"""{name}d AS (SELECT DISTINCT frame_id, gx + a AS gx, gy + b AS gy FROM gr, range(-{rx}, {rx + 1}) ra(a), range(-{ry}, {ry + 1}) rb(b) WHERE gx + a BETWEEN 0 AND 199 AND gy + b BETWEEN 0 AND 139),
{name} AS (SELECT frame_id, gx + a AS gx, gy + b AS gy FROM {name}d, range(-{rx}, {rx + 1}) ra(a), range(-{ry}, {ry + 1}) rb(b) GROUP BY 1, 2, 3 HAVING count(*) = {n})"""


_BRIDGE = f"""{_closed('k1', 1, 1)}, {_closed('k2', 6, 3)}, {_closed('k3', 3, 4)}, {_closed('k4', 2, 2)},
br AS (SELECT * FROM (SELECT * FROM k1 UNION SELECT * FROM k2 UNION SELECT * FROM k3 UNION (SELECT * FROM k1d INTERSECT SELECT * FROM k4)) ANTI JOIN rc USING (frame_id, gx, gy))"""
_GAPS = """gp0 AS (SELECT br.frame_id, br.gx, br.gy, (SELECT max(gx) FROM gr WHERE gr.frame_id = br.frame_id AND gr.gy = br.gy AND gr.gx < br.gx) AS x0, (SELECT min(gx) FROM gr WHERE gr.frame_id = br.frame_id AND gr.gy = br.gy AND gr.gx > br.gx) AS x1,
  (SELECT max(gy) FROM gr WHERE gr.frame_id = br.frame_id AND gr.gx = br.gx AND gr.gy < br.gy) AS y0, (SELECT min(gy) FROM gr WHERE gr.frame_id = br.frame_id AND gr.gx = br.gx AND gr.gy > br.gy) AS y1 FROM br),
gp AS (SELECT g.frame_id, g.gx, g.gy, x1 - x0 - 1 AS w_gx, CASE WHEN x0 + x1 IS NOT NULL THEN a.z_um END AS lo_gx, CASE WHEN x0 + x1 IS NOT NULL THEN b.z_um END AS hi_gx, y1 - y0 - 1 AS w_gy, CASE WHEN y0 + y1 IS NOT NULL THEN c.z_um END AS lo_gy, CASE WHEN y0 + y1 IS NOT NULL THEN e.z_um END AS hi_gy
  FROM gp0 g LEFT JOIN gr a ON a.frame_id = g.frame_id AND a.gy = g.gy AND a.gx = x0 LEFT JOIN gr b ON b.frame_id = g.frame_id AND b.gy = g.gy AND b.gx = x1
  LEFT JOIN gr c ON c.frame_id = g.frame_id AND c.gx = g.gx AND c.gy = y0 LEFT JOIN gr e ON e.frame_id = g.frame_id AND e.gx = g.gx AND e.gy = y1)"""
_PAINT = """ip0 AS (SELECT gp.*, least(coalesce(w_gx, 999), coalesce(w_gy, 999)) AS w, coalesce(w_gx, 999) <= coalesce(w_gy, 999) AND w_gx IS NOT NULL AS by_x,
  (SELECT avg(z_um) FROM gr WHERE gr.frame_id = gp.frame_id AND abs(gr.gx - gp.gx) <= 4 AND abs(gr.gy - gp.gy) <= 2) AS raw0, nb.k, nb.lo AS nlo, nb.hi AS nhi FROM gp
  LEFT JOIN (SELECT br.frame_id, br.gx, br.gy, count(*) AS k, min(z_um) AS lo, max(z_um) AS hi FROM br JOIN gr ON br.frame_id = gr.frame_id AND abs(br.gx - gr.gx) <= 1 AND abs(br.gy - gr.gy) <= 1 GROUP BY 1, 2, 3) nb USING (frame_id, gx, gy)),
ip1 AS (SELECT *, coalesce(raw0, 0) AS raw, CASE WHEN by_x THEN lo_gx WHEN w_gy IS NOT NULL THEN lo_gy ELSE -1600000 END AS za, CASE WHEN by_x THEN hi_gx WHEN w_gy IS NOT NULL THEN hi_gy ELSE -1600000 END AS zb, coalesce(k, 0) >= 2 AS two FROM ip0),
ip2 AS (SELECT *, abs(za - zb) AS dz1, CASE WHEN two THEN nhi - nlo ELSE abs(za - zb) END AS eff, CASE WHEN two THEN nlo ELSE least(za, zb) END AS low FROM ip1),
ip AS (SELECT frame_id, gx, gy, CASE WHEN eff >= 200000 OR (dz1 > 150000 AND w <= 2) OR low < -2000000 OR raw < -2000000 THEN 255 WHEN w > 4 AND NOT two THEN NULL WHEN w > 2 THEN 100 WHEN eff <= 60000 THEN 0 ELSE 100 END AS cost, w,
  round(CASE WHEN raw BETWEEN -2100000 AND -1350000 THEN raw ELSE -1600000 END)::BIGINT AS z_um FROM ip2)"""
_FLAT = "mean_z BETWEEN -2000 AND -1350 AND dz <= 150"
_COARSEN = f"""co0 AS (SELECT *, {_FLAT} AS flat, NOT ({_FLAT}) AND (cost > 180 OR mean_z > -1200 OR dz > 250) AS obs FROM ev),
co AS (SELECT * REPLACE (CASE WHEN flat THEN 0 WHEN obs AND size_mm = 500 THEN 255 ELSE cost END AS cost), size_mm = 500 AND (flat OR (NOT obs AND (cost <= 50 OR (mean_z BETWEEN -2100 AND -1350 AND dz <= 150)))) AS ground FROM co0),
cg AS (SELECT * FROM co WHERE ground),
cn AS (SELECT a.frame_id, a.gx, a.gy, count(*) AS k, count(*) FILTER (a.gx = b.gx OR a.gy = b.gy) AS s FROM cg a JOIN cg b ON a.frame_id = b.frame_id AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY 1, 2, 3),
ce AS (SELECT cg.*, k = (3 - (gx IN (0, 199))::INTEGER) * (3 - (gy IN (0, 139))::INTEGER) AS wide, s = 5 - (gx IN (0, 199))::INTEGER - (gy IN (0, 139))::INTEGER AND k < (3 - (gx IN (0, 199))::INTEGER) * (3 - (gy IN (0, 139))::INTEGER) AS pinch FROM cg JOIN cn USING (frame_id, gx, gy)),
cl AS (SELECT DISTINCT frame_id, CASE WHEN size_mm = 125 THEN gx // 8 ELSE gx // 2 END AS bx, CASE WHEN size_mm = 125 THEN gy // 8 ELSE gy // 2 END AS byy FROM co WHERE cost > 180),
cb AS (SELECT frame_id, gx // 2 AS bx, gy // 2 AS byy, count(*) FILTER (wide) AS nw, bool_or(pinch) AS pinched, min(z_min) AS z_min, max(z_max) AS z_max, sum(n)::BIGINT AS n FROM ce GROUP BY 1, 2, 3),
cm AS (SELECT * FROM cb WHERE nw = 4 OR (nw = 3 AND NOT pinched AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.frame_id = cb.frame_id AND cl.bx = cb.bx AND cl.byy = cb.byy)))"""
_CUT = lambda e: f"trunc(({e}) / 100.0::DOUBLE)::INTEGER"
_PIXELS = f"""pr AS (SELECT frame_id, {_CUT('-40000 + gx * size_mm + 20000')} AS c0, {_CUT('-40000 + (gx + 1) * size_mm + 20000')} AS c1, {_CUT('-35000 + gy * size_mm + 20000')} AS r0, {_CUT('-35000 + (gy + 1) * size_mm + 20000')} AS r1,
  CASE WHEN cost <= 50 THEN 0 WHEN cost <= 180 THEN 50 ELSE 100 END AS v, 0 AS layer, -size_mm AS o1, gy AS o2, gx AS o3 FROM ev %s),
px AS (SELECT frame_id, r AS row, c AS col, arg_max(v, (layer, o1, o2, o3)) AS value FROM (SELECT *, unnest(range(greatest(c0, 0), least(c1, 399) + 1)) AS c FROM pr) q, range(0, 400) rr(r) WHERE r BETWEEN r0 AND r1 GROUP BY 1, 2, 3)"""
_HAZ = f"""UNION ALL SELECT frame_id, {_CUT('hx - 700 + 20000')}, {_CUT('hx + 700 + 20000')}, {_CUT('hy - 700 + 20000')}, {_CUT('hy + 700 + 20000')}, CASE WHEN track_id = 0 THEN 100 ELSE 50 END, 1, track_id, 0, 0
  FROM (SELECT *, (x_lo + x_hi) // 2 AS hx, (y_lo + y_hi) // 2 AS hy FROM b)"""
_HEAD = f"WITH {P}, {leaves_sql()}"

ORACLE = {
    "raster_cells": f"{_HEAD}, {_TABLE} SELECT * FROM rc",
    "closing_bridge": f"{_HEAD}, {_TABLE}, {_BRIDGE} SELECT * FROM br",
    "closing_forward": f"{_HEAD}, {_TABLE}, {_closed('k2', 6, 3)} SELECT * FROM k2",
    "gap_width": f"{_HEAD}, {_TABLE}, {_BRIDGE}, {_GAPS} SELECT * FROM gp",
    "inpaint_classes": f"{_HEAD}, {_TABLE}, {_BRIDGE}, {_GAPS}, {_PAINT} SELECT * FROM ip WHERE cost IS NOT NULL",
    "beam_gap_fill": f"""{_HEAD}, w AS (SELECT frame_id, gx, gy, dz < 50 AS flat, round(mean_z * 1000)::BIGINT AS z FROM ev WHERE size_mm = 500 AND cost <= 50),
      h AS (SELECT a.frame_id, a.gx, a.gy + 1 AS gy, a.z + b.z AS z, 0 AS k FROM w a JOIN w b ON a.frame_id = b.frame_id AND a.gx = b.gx AND b.gy = a.gy + 2 AND a.flat AND b.flat AND abs(a.z - b.z) < 100000
            UNION ALL SELECT a.frame_id, a.gx + 1, a.gy, a.z + b.z, 1 FROM w a JOIN w b ON a.frame_id = b.frame_id AND a.gy = b.gy AND b.gx = a.gx + 2 AND a.flat AND b.flat AND abs(a.z - b.z) < 100000)
      SELECT frame_id, gx, gy, arg_min(z, k) AS z_um FROM h ANTI JOIN w USING (frame_id, gx, gy) GROUP BY 1, 2, 3""",
    "clearance_coarsen": f"""{_HEAD}, {_COARSEN} SELECT frame_id, size_mm, gx, gy, z_min, z_max, dz, n, cost FROM co WHERE NOT ground
      UNION ALL SELECT frame_id, 1000, bx, byy, z_min, z_max, greatest(z_max - z_min, 20), n, 0 FROM cm
      UNION ALL SELECT frame_id, CASE WHEN pinch THEN 750 ELSE 500 END, gx, gy, z_min, z_max, dz, n, CASE WHEN pinch THEN 100 WHEN wide THEN 0 ELSE cost END FROM ce WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.frame_id = ce.frame_id AND cm.bx = ce.gx // 2 AND cm.byy = ce.gy // 2)""",
    "occupancy_grid": f"{_HEAD}, {BOXES}, {_PIXELS % _HAZ} SELECT frame_id, row::INTEGER AS row, col::INTEGER AS col, value FROM px",
    "occupancy_message": f"""{_HEAD}, {_PIXELS % ''}, fr AS (SELECT DISTINCT frame_id FROM px), every AS (SELECT fr.frame_id, r.row, cc.col FROM fr, range(400) r(row), range(400) cc(col))
      SELECT frame_id, floor(frame_id * 0.25::DOUBLE + 1000)::BIGINT AS sec, ((frame_id * 0.25::DOUBLE - floor(frame_id * 0.25::DOUBLE)) * 1000000000)::BIGINT AS nanosec, -20.0::DOUBLE AS origin_x, 0.1::DOUBLE AS resolution, 400 AS width, 400 AS height,
        md5(string_agg(coalesce(value, -1)::VARCHAR, ',' ORDER BY row, col)) AS data_md5 FROM every LEFT JOIN px USING (frame_id, row, col) GROUP BY frame_id""",
}
ORACLE["beam_gap_fill_capped"] = f"SELECT * FROM ({ORACLE['beam_gap_fill']}) QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY gy, gx) <= 20"
