"""SQL functions, as expressions that Catalyst inlines, and a table function for grid rays."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gridloom.operators.health import bresenham

#: Name and parameters to result and expression.
EXPRESSIONS = {
    "zone_of(x_mm BIGINT, y_mm BIGINT) RETURNS INT": "CASE WHEN x_mm * x_mm + y_mm * y_mm < 100000000 THEN 1 WHEN x_mm * x_mm + y_mm * y_mm < 625000000 THEN 2 WHEN x_mm * x_mm + y_mm * y_mm < 2500000000 THEN 3 WHEN x_mm * x_mm + y_mm * y_mm <= 10000000000 THEN 4 ELSE 5 END",
    "zone_resolution(zone INT) RETURNS INT": "CASE zone WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 250 WHEN 4 THEN 500 END",
    "cost_band(cost INT) RETURNS STRING": "CASE WHEN cost <= 50 THEN 'safe' WHEN cost <= 180 THEN 'caution' ELSE 'lethal' END",
    "cell_id(zone INT, size_mm INT, x DOUBLE, y DOUBLE) RETURNS STRING": "format_string('z%d_%sm_%+09.4f_%+09.4f', zone, format_string('%.2f', size_mm / 1000.0D), x, y)",
    "cell_of(v BIGINT, size BIGINT) RETURNS BIGINT": "(v - pmod(v, size)) div size",
    "slope_degrees(dz DOUBLE, size DOUBLE) RETURNS DOUBLE": "CASE WHEN dz < 10 THEN 0.0D ELSE degrees(atan2(dz, size)) END",
    "plane_distance(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE) RETURNS DOUBLE": "(a * x + b * y + c * z + d) / sqrt(a * a + b * b + c * c)",
    "footprint_near(x DOUBLE, y DOUBLE, size DOUBLE) RETURNS DOUBLE": "sqrt(power(greatest(abs(x) - size / 2, 0), 2) + power(greatest(abs(y) - size / 2, 0), 2))",
    "footprint_far(x DOUBLE, y DOUBLE, size DOUBLE) RETURNS DOUBLE": "sqrt(power(abs(x) + size / 2, 2) + power(abs(y) + size / 2, 2))",
    "bev_iou(x1 DOUBLE, y1 DOUBLE, l1 DOUBLE, w1 DOUBLE, x2 DOUBLE, y2 DOUBLE, l2 DOUBLE, w2 DOUBLE) RETURNS DOUBLE": """coalesce(greatest(least(x1 + l1 / 2, x2 + l2 / 2) - greatest(x1 - l1 / 2, x2 - l2 / 2), 0) * greatest(least(y1 + w1 / 2, y2 + w2 / 2) - greatest(y1 - w1 / 2, y2 - w2 / 2), 0)
        / nullif(l1 * w1 + l2 * w2 - greatest(least(x1 + l1 / 2, x2 + l2 / 2) - greatest(x1 - l1 / 2, x2 - l2 / 2), 0) * greatest(least(y1 + w1 / 2, y2 + w2 / 2) - greatest(y1 - w1 / 2, y2 - w2 / 2), 0), 0), 0)""",
}


@udtf(returnType="step: int, x: int, y: int")
class Bresenham:
    """Cells from the origin to (x1, y1), at most 60."""

    def eval(self, x1: int, y1: int):
        for n, (x, y) in enumerate(bresenham(x1, y1)):
            yield n, x, y


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session and returns their names."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("bresenham", Bresenham)
    return [head.split("(")[0] for head in EXPRESSIONS] + ["bresenham"]
