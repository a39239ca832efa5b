from pyspark.sql import functions as F

from gridloom.plans import object_queries as oq
from gridloom.plans.common import points

SMALL, DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_every_event_is_used(spark):
    n = spark.read.parquet(f"{DIR}/events.parquet").count()
    seen, boxes = oq.detections(spark, DIR), oq._boxes(spark, DIR)
    assert seen.count() == seen.select("sensor_id", "frame_id", "det_id").distinct().count() == 3 * n
    assert boxes.select("box_id").distinct().count() == n
    assert boxes.groupBy("frame_id").count().agg(F.max("count")).first()[0] == 100


def test_velocity_error_of_every_sensor(spark):
    got = oq.QUERIES["velocity_rmse"](spark, SMALL).toPandas()
    assert set(got.sensor_id) == set(range(16)) and not got.duplicated(["sensor_id", "frame_id"]).any()
    assert (got.tracks == 3).all() and len(got) == 1000 - 2 * 16  # a track is reported from its third frame


def test_pillars_have_all_their_points(spark):
    got = oq.QUERIES["pillar_stats"](spark, SMALL).toPandas()
    p = points(spark, SMALL).toPandas()
    p = p[p.x_mm.between(-51200, 51199) & p.y_mm.between(-51200, 51199) & p.z_mm.between(-5000, 3000)]
    p = p.assign(px=(p.x_mm + 51200) // 200, py=(p.y_mm + 51200) // 200).sort_values("point_idx")
    own = ["frame_id", "px", "py"]
    assert p[own].drop_duplicates().groupby("frame_id").size().between(151, 30_000).any()
    p = p[p.groupby(own).cumcount() < 20]
    assert sorted(got[["frame_id", "point_idx", "px", "py"]].itertuples(index=False)) == sorted(p[["frame_id", "point_idx", "px", "py"]].itertuples(index=False))
