"""Points derived from relational tables, the same in Spark and in SQL, and a procedural sweep generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Orders of one block of frames: frames hold about as many points however large the table is.
BLOCK = 20_000


def from_lineitem(spark: SparkSession, sf_dir: str, stretch: int = 1, frames: int = 8) -> DataFrame:
    """A point for most rows of lineitem, over patches of flat, stepped, raised, sunken and rough ground.

    stretch multiplies x and y; frames is the number of frames for each BLOCK of orders.
    """
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o, p, s, n, q = "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cast(l_quantity as bigint)"
    k = t.withColumn("k", F.expr(f"{o}*131 + {p}*1009 + {s}*7 + {n}*3 + {q}*11")).withColumn("frame_id", F.expr(f"({o} div {BLOCK}) * {frames} + {o} % {frames}"))
    k = k.withColumn("x", F.expr(f"(k*7919 + {p}*31) % 16000 - 8000")).withColumn("y", F.expr(f"(k*6151 + {o}*389) % 8000 - 4000"))
    k = k.withColumn("patch", F.expr("(((x + 8000) div 1000) * 7 + ((y + 4000) div 1000) * 13 + frame_id * 3) % 20"))
    # one generated row for each: filters on coordinates stop here, where the optimizer would else write all of the above into each
    k = k.select(*t.columns, F.inline(F.array(F.struct("k", "frame_id", "x", "y", "patch"))))
    flat = F.expr("-1600 + k % 41 - 20")
    shape = {11: "-1600 + k % 200", 12: "-1500 + k % 2500", 13: "-2200 + k % 30", 14: "-1600 + if(k % 97 = 0, 600, k % 30)", 15: "-1600 + k % 260", 17: "-1600 + if(k % 5 = 0, 40, 0)", 18: "1500L", 19: "-1300 + k % 40"}
    z = flat
    for patch, expr in shape.items():
        z = F.when(F.col("patch") == patch, F.expr(expr)).otherwise(z)
    k = k.where("patch <> 16 AND (patch <> 18 OR k % 10 = 0)").withColumn("z", z)
    order = Window.partitionBy("frame_id").orderBy(*sorted(c for c in t.columns))
    return k.select(
        "frame_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("point_idx"),
        (F.col("x") * stretch).alias("x_mm"),
        (F.col("y") * stretch).alias("y_mm"),
        F.col("z").cast("bigint").alias("z_mm"),
        F.round(F.col("l_discount") * 1000).cast("bigint").alias("i_pct"),
    )


def sql(stretch: int = 1, frames: int = 8) -> str:
    """The same as a DuckDB query."""
    return f"""
SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) - 1 AS point_idx,
       x * {stretch} AS x_mm, y * {stretch} AS y_mm,
       CASE patch WHEN 11 THEN -1600 + k % 200 WHEN 12 THEN -1500 + k % 2500 WHEN 13 THEN -2200 + k % 30
                  WHEN 14 THEN -1600 + CASE WHEN k % 97 = 0 THEN 600 ELSE k % 30 END WHEN 15 THEN -1600 + k % 260
                  WHEN 17 THEN -1600 + CASE WHEN k % 5 = 0 THEN 40 ELSE 0 END WHEN 18 THEN 1500 WHEN 19 THEN -1300 + k % 40
                  ELSE -1600 + k % 41 - 20 END AS z_mm,
       round(l_discount * 1000)::BIGINT AS i_pct
FROM (SELECT *, (((x + 8000) // 1000) * 7 + ((y + 4000) // 1000) * 13 + frame_id * 3) % 20 AS patch
      FROM (SELECT *, (k * 7919 + l_partkey * 31) % 16000 - 8000 AS x, (k * 6151 + l_orderkey * 389) % 8000 - 4000 AS y
            FROM (SELECT *, l_orderkey * 131 + l_partkey * 1009 + l_suppkey * 7 + l_linenumber * 3 + l_quantity::BIGINT * 11 AS k,
                         (l_orderkey // {BLOCK}) * {frames} + l_orderkey % {frames} AS frame_id FROM lineitem)))
WHERE patch <> 16 AND (patch <> 18 OR k % 10 = 0)
"""


def sweep_points(rows: DataFrame, seed, ahead, *more: str) -> DataFrame:
    """The coordinates of a made-up sweep for rows of frame_id and point_idx (0 to 8599), with the columns `more`.

    6000 points of road, 1500 of kerb, 800 of a vehicle with its centre `ahead` (millimetres) and 300 of a pole; seed and
    point_idx are hashed in place of random draws.
    """
    i = F.col("point_idx")

    def draw(salt: int, lo: int, hi: int):
        return F.lit(lo) + F.pmod(F.xxhash64(seed, i, F.lit(salt)), F.lit(hi - lo + 1))

    def part(road, kerb, vehicle, pole):
        return F.when(i < 6000, road).when(i < 7500, kerb).when(i < 8300, vehicle).otherwise(pole).cast("bigint")

    side = F.when(i % 2 == 0, 1).otherwise(-1)
    return rows.select(
        "frame_id",
        *more,
        "point_idx",
        part(draw(1, -15_000, 35_000), draw(1, -15_000, 35_000), ahead.cast("bigint") + draw(1, -2100, 2100), draw(1, 13_900, 14_100)).alias("x_mm"),
        part(draw(2, -4000, 4000), side * draw(2, 4000, 7500), 1800 + draw(2, -900, 900), draw(2, -5300, -5100)).alias("y_mm"),
        part(draw(3, -1615, -1585), draw(3, -1518, -1482), -900 + draw(3, -700, 700), draw(3, -1500, 1800)).alias("z_mm"),
        part(draw(4, 15, 35), draw(4, 20, 40), draw(4, 70, 90), draw(4, 40, 60)).alias("i_pct"),
    )


def procedural(spark: SparkSession, frames: int, dt_ms: int = 40) -> DataFrame:
    """Sweeps of 8600 points each by integer hashing, with a vehicle that goes 3.5 m a second."""
    base = spark.range(0, frames * 8600, 1, max(1, min(frames, 200))).select(F.expr("id div 8600").alias("frame_id"), (F.col("id") % 8600).alias("point_idx"))
    return sweep_points(base, F.col("frame_id"), F.lit(5000) + (F.col("frame_id") * dt_ms * 35).cast("bigint") / 10)


def decimate_files(points: DataFrame, stride: int = 2) -> DataFrame:
    """Every stride-th point of each frame, renumbered."""
    return points.where(F.col("point_idx") % stride == 0).withColumn("point_idx", F.expr(f"point_idx div {stride}"))
