import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import cluster, health
from gridloom.plans import pipeline, registry
from gridloom.sources import sweeps


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_footprints_are_not_broadcast(spark):
    """They compress so well that a relation of 168 MB went through a driver whose broadcasts were to stay under 256 KB."""
    leaves = spark.range(400).select(F.expr("id % 20").alias("frame_id"), F.expr("(id div 20) * 0.5").alias("x"), F.lit(0.0).alias("y"), F.lit(10).alias("dz"), F.lit(-1600.0).alias("mean_z"), F.lit(-1590).alias("z_max"), F.lit(1.0).alias("slope"), F.lit(200).alias("cost"))
    tracks = spark.range(20).select(F.col("id").alias("frame_id"), F.lit(0).alias("track_id"), F.expr("5.0 + id * 0.5").alias("x"), F.lit(0.5).alias("y"), F.lit(4.0).alias("length"), F.lit(2.0).alias("width"))
    made = health.cleared(leaves, tracks)
    assert len(made.collect()) == 400
    assert "BroadcastHashJoin" not in plan(made) and plan(made).count("SortMergeJoin") >= 4


def test_plans_of_the_frame_path_are_short(spark, monkeypatch):
    """What the driver holds of a frame path: no plan, written or returned, has all operators in it."""
    lengths = []
    save = pipeline.Tables.save

    def watched(self, df, name):
        lengths.append(len(plan(df)))
        return save(self, df, name)

    monkeypatch.setattr(pipeline.Tables, "save", watched)
    made = pipeline.process(sweeps.procedural(spark, 3, 100), sensor=F.lit(0).cast("bigint"))
    assert made.statistics.count() == 3
    assert max([*lengths, len(plan(made.statistics))]) < 200_000


def test_density_clusters_of_many_frames_at_once():
    """Frames that stand together are labelled as each is alone, against comparing all points; a frame alone costs a call."""
    rng = np.random.default_rng(5)
    for eps, least in ((5.0, 1), (12.0, 3), (25.0, 6)):
        frames = np.sort(rng.integers(0, 40, 900))
        xyz = rng.integers(-50, 50, (900, 3)).astype(float)
        xyz[::97] = np.nan
        got = cluster.dbscan_labels(xyz, eps, least, frames)
        for f in np.unique(frames):
            own = xyz[frames == f]
            near = ((own[:, None] - own[None]) ** 2).sum(2) <= eps * eps
            core = near.sum(1) >= least
            reach = near & core[:, None] & core[None]
            for _ in own:
                reach = reach | (reach @ reach)
            first = [int(np.flatnonzero(r)[0]) if r.any() else -1 for r in reach]
            names = {r: k for k, r in enumerate(sorted(set(first) - {-1}))}
            want = [names[first[i]] if core[i] else min((names[first[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(own))]
            assert got[frames == f].tolist() == want


def test_frames_across_batches(spark):
    """Frames of more rows than an Arrow batch, and a null one, are whole."""
    rows = [(f, i, 100 * (i % 50), 0, 0, 7) for f in (None, 0, 1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "frame_id long, point_idx long, x_mm long, y_mm long, z_mm long, i_pct long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = cluster.dbscan(df, 150, 3).groupBy("frame_id", "label").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r.frame_id), r.label, r["count"]) for r in got) == [("0", 0, 50), ("1", 0, 50), ("2", 0, 50), ("None", 0, 50)]


def test_candidates_cluster_once(spark):
    """tracker_candidates reads its clusters three times and makes them once, for many frames a call."""
    made = registry.queries()["tracker_candidates"](spark, "/root/testdata/sf0.001")
    text = made._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in text and text.count("MapInArrow") == 0
