"""Queries over points."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import points as op
from gridloom.plans.common import BOXES, IN_BOX, SMALL, WIDE, P, boxes, points, small, wide

_V = lambda size: ", ".join(f"floor({c} / {size}.0::DOUBLE)::BIGINT" for c in ("x_mm", "y_mm", "z_mm"))
_COLS = "frame_id, point_idx, x_mm, y_mm, z_mm, i_pct"
_SIZED = "s AS (SELECT *, count(*) OVER (PARTITION BY frame_id) AS n FROM p)"


def _detections(s, d):
    return boxes(s, d).select("frame_id", (F.col("x_lo") * 8).alias("x_mm"), F.col("y_lo").alias("y_mm"), F.col("z_lo").alias("z_mm"))


QUERIES = {
    "bounds_filter": lambda s, d: op.columns(op.within_bounds(wide(s, d))),
    "decimate_dense": lambda s, d: op.columns(op.decimate(points(s, d), 700, 2)),
    "decimate_third": lambda s, d: op.columns(op.decimate(points(s, d), 3000, 3)),
    "voxel_decimate": lambda s, d: op.columns(op.first_per_voxel(points(s, d))),
    "speckle_strip_voxel": lambda s, d: op.columns(op.dense_voxels(points(s, d), 800, 4)),
    "speckle_strip_ball": lambda s, d: op.columns(op.strip_speckle(small(s, d), 2000, 3)),
    "dust_filter_large": lambda s, d: op.columns(op.dust_large(wide(s, d))),
    "dust_filter_small": lambda s, d: op.columns(op.dust_small(small(s, d), 5)),
    "dynamic_exclusion": lambda s, d: op.columns(op.outside_boxes(points(s, d), boxes(s, d), 200)),
    "dynamic_filter_wide_margin": lambda s, d: op.outside_boxes(points(s, d), boxes(s, d), 250).groupBy("frame_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("z_mm").alias("sum_z")),
    "radial_envelope": lambda s, d: op.columns(op.radial(wide(s, d), 50_000)),
    "detector_range": lambda s, d: op.detector_range(_detections(s, d)),
    "decimate_files": lambda s, d: _strided(s, d),
}


def _strided(s, d):
    from gridloom.sources.sweeps import decimate_files

    return decimate_files(points(s, d))


ORACLE = {
    "bounds_filter": f"WITH {WIDE} SELECT {_COLS} FROM p WHERE {IN_BOX}",
    "decimate_dense": f"WITH {P}, {_SIZED}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) AS k FROM s) SELECT {_COLS} FROM r WHERE n <= 700 OR k % 2 = 1",
    "decimate_third": f"WITH {P}, {_SIZED}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) AS k FROM s) SELECT {_COLS} FROM r WHERE n <= 3000 OR k % 3 = 1",
    "voxel_decimate": f"WITH {P} SELECT {_COLS} FROM p QUALIFY row_number() OVER (PARTITION BY frame_id, {_V(150)} ORDER BY point_idx) = 1",
    "speckle_strip_voxel": f"WITH {P} SELECT {_COLS} FROM p QUALIFY count(*) OVER (PARTITION BY frame_id, {_V(800)}) >= 4",
    "speckle_strip_ball": f"""WITH {SMALL}, {_SIZED} SELECT {_COLS} FROM s a WHERE n <= 300 AND 3 <= (SELECT count(*) FROM p b WHERE b.frame_id = a.frame_id
        AND (a.x_mm - b.x_mm) ** 2 + (a.y_mm - b.y_mm) ** 2 + (a.z_mm - b.z_mm) ** 2 <= 4000000)
        UNION ALL SELECT {_COLS} FROM (SELECT * FROM s WHERE n > 300 QUALIFY count(*) OVER (PARTITION BY frame_id, {_V(2000)}) >= 3)""",
    "dust_filter_large": f"""WITH {WIDE}, a AS (SELECT *, x_mm * x_mm + y_mm * y_mm <= 3025000000 AS near FROM p),
        b AS (SELECT *, near AND count(*) OVER (PARTITION BY frame_id, near, {_V(800)}) >= 4 AS dense,
              least(greatest(floor((x_mm + 25000) / 2000.0::DOUBLE), 0), 39) AS gx, least(greatest(floor((y_mm + 20000) / 2000.0::DOUBLE), 0), 19) AS gy FROM a),
        c AS (SELECT *, dense AND z_mm - min(z_mm) OVER (PARTITION BY frame_id, dense, gx, gy) > 220 AS air FROM b),
        e AS (SELECT *, air AND count(*) OVER (PARTITION BY frame_id, air, {_V(500)}) >= 4 AS solid, count(*) FILTER (near) OVER (PARTITION BY frame_id) AS n1,
              count(*) FILTER (dense) OVER (PARTITION BY frame_id) AS n2, count(*) FILTER (air) OVER (PARTITION BY frame_id) AS n3 FROM c)
        SELECT {_COLS} FROM e WHERE n1 <= 15 OR n2 <= 15 OR NOT near OR (dense AND NOT air) OR (solid AND n3 >= 4)""",
    "dust_filter_small": f"""WITH {SMALL}, i AS (SELECT * FROM p WHERE x_mm * x_mm + y_mm * y_mm <= 3025000000),
        d AS (SELECT a.frame_id, a.point_idx, b.point_idx AS o, (a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm) + (a.z_mm - b.z_mm) * (a.z_mm - b.z_mm) AS d2
              FROM i a JOIN i b ON a.frame_id = b.frame_id AND a.point_idx <> b.point_idx),
        k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY frame_id, point_idx ORDER BY d2, o) <= 5),
        m AS (SELECT frame_id, point_idx, sum(round(sqrt(d2) * 1000)::BIGINT)::BIGINT AS um FROM k GROUP BY ALL),
        c AS (SELECT frame_id, sum(um) / count(*)::DOUBLE AS mu, greatest(sum(um::DOUBLE * um) / count(*) - (sum(um) / count(*)::DOUBLE) ** 2, 0) AS v FROM m GROUP BY 1 HAVING count(*) > 5)
        SELECT {_COLS} FROM p ANTI JOIN (SELECT frame_id, point_idx FROM m JOIN c USING (frame_id) WHERE v > 0.000025 AND um > mu + 2 * sqrt(v)) g USING (frame_id, point_idx)""",
    "dynamic_exclusion": f"""WITH {P}, {BOXES} SELECT {_COLS} FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.frame_id = p.frame_id AND x_mm BETWEEN x_lo - 200 AND x_hi + 200
        AND y_mm BETWEEN y_lo - 200 AND y_hi + 200 AND z_mm BETWEEN z_lo - 200 AND z_hi + 200)""",
    "dynamic_filter_wide_margin": f"""WITH {P}, {BOXES} SELECT frame_id, count(*) AS kept, sum(z_mm)::BIGINT AS sum_z FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.frame_id = p.frame_id
        AND x_mm BETWEEN x_lo - 250 AND x_hi + 250 AND y_mm BETWEEN y_lo - 250 AND y_hi + 250 AND z_mm BETWEEN z_lo - 250 AND z_hi + 250) GROUP BY 1""",
    "radial_envelope": f"WITH {WIDE} SELECT {_COLS} FROM p WHERE x_mm * x_mm + y_mm * y_mm <= 2500000000",
    "detector_range": f"""WITH {P}, {BOXES}, e AS (SELECT frame_id, x_lo * 8 BETWEEN -51200 AND 51200 AND y_lo BETWEEN -51200 AND 51200 AND z_lo BETWEEN -5000 AND 3000 AS ok FROM b)
        SELECT frame_id, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS discarded FROM e GROUP BY 1""",
    "decimate_files": f"WITH {P} SELECT frame_id, point_idx // 2 AS point_idx, x_mm, y_mm, z_mm, i_pct FROM p WHERE point_idx % 2 = 0",
}
