"""The frame pipeline end to end: points to leaves with cost, tracks, hazards, rasters, statistics and a JSON frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.models import Model
from gridloom.operators import cells, cluster, ground, hazards, health, points as pt, raster, segment, spatial, telemetry, track
from gridloom.tables import Tables


@dataclass(frozen=True)
class Frame:
    """What the pipeline yields, each keyed by frame_id; lazy until read."""

    points: DataFrame
    leaves: DataFrame
    thin: DataFrame
    drops: DataFrame
    clusters: DataFrame
    porous: DataFrame
    tracks: DataFrame
    health: DataFrame
    raster: DataFrame
    statistics: DataFrame
    bands: DataFrame
    documents: DataFrame
    whole_documents: DataFrame


def _boxes(tracks: DataFrame) -> DataFrame:
    """Boxes of each frame's moving tracks for the next frame, in millimetres."""
    half = lambda c: (F.col(c) * 500).cast("bigint")
    mm = lambda c: (F.col(c) * 1000).cast("bigint")
    return tracks.where("is_dynamic").select((F.col("frame_id") + 1).alias("frame_id"), (mm("x") - half("length")).alias("x_lo"), (mm("x") + half("length")).alias("x_hi"), (mm("y") - half("width")).alias("y_lo"), (mm("y") + half("width")).alias("y_hi"), F.lit(-2500).alias("z_lo"), F.lit(3000).alias("z_hi"))


def process(
    points: DataFrame, tracks: DataFrame | None = None, boxes: DataFrame | None = None, labels: DataFrame | None = None, memory: DataFrame | None = None,
    sensor: Column | None = None, most_cells: int = 10_000, coarsen: bool = True, segmentation: Model | None = None, threats: Model | None = None,
) -> Frame:
    """Bounds, decimation, dust by frame size, ground split, thin hazards, clusters, tracking, exclusion of last frame's
    tracks, grid, inpainting, coarsening, drop-offs, cost, occupancy, vegetation, forecasts, ghosts, blind sectors, raster,
    statistics and the document.

    terrain_cost keeps what the terrain alone gives and hazard_cost what hazards add; cost is the greater of both.
    tracks: frame_id, track_id, x, y, vx, vy, length, width, is_dynamic (metres); made from the frames' own rigid clusters and
    boxes (a detector's, metres) if not given, a sensor at a time (sensor: Column, 64 successive frames unless given).
    labels: frame_id, point_idx, label; where there are none, by the segmentation model if it is READY, and else by height.
    threats: a model of slots for thin hazards, which come from height and intensity unless it is READY. memory: frame_id, kx, ky, z, remembered heights.
    """
    tables = Tables(points)
    sensor = F.expr("frame_id div 64") if sensor is None else sensor
    near = tables.save(pt.decimate(pt.within_bounds(points), 65_000, 2), "near")
    split = tables.save(ground.split(pt.dust(near)), "points")
    low, high = split.where("is_ground"), split.where("NOT is_ground")
    planes = ground.fit_planes(ground.plane_sums(low))
    rises = ground.residual_to_plane(low, planes).withColumn("h", F.rint(F.col("residual") * 1000).cast("bigint"))
    if threats is not None and threats.predict is not None:
        rises = rises.join(ground.slot_threats(ground.candidates(rises, "h"), threats, "h"), ["frame_id", "point_idx"], "left")
    thin = tables.save(ground.thin_hazards(rises, "h"), "thin")

    found = tables.save(cluster.clustered(pt.decimate(high.drop("is_ground"), 3000, 3)), "clustered")
    objects, porous = cluster.merged_summaries(cluster.summaries(found)), cluster.porosity(found)
    if tracks is None:
        given = boxes if boxes is not None else points.sparkSession.createDataFrame([], "frame_id bigint, x double, y double, vx double, vy double, length double, width double, height double")
        seen = cluster.candidates(cluster.summaries(found), porous, given)
        empty = split.select("frame_id").distinct().join(seen.select("frame_id").distinct(), "frame_id", "left_anti")
        frames = seen.unionByName(empty, allowMissingColumns=True).withColumn("sensor_id", sensor)
        tracks = tables.save(track.derived(track.track(frames)).drop("sensor_id"), "tracks")

    still = pt.outside_boxes(split.drop("is_ground"), _boxes(tracks))
    leaves = tables.save(cells.leaves(still), "leaves")
    painted = raster.inpainted(tables.save(raster.cell_table(cells.evaluate(leaves)), "table"))
    z = (F.col("z_um") / 1000).cast("double")
    filled = painted.select("frame_id", F.lit(500).alias("size_mm"), "gx", "gy", F.floor(z).cast("bigint").alias("z_min"), F.ceil(z).cast("bigint").alias("z_max"), F.lit(0).cast("bigint").alias("dz"), F.lit(0).cast("bigint").alias("n"), z.alias("mean_z"), F.lit(0.0).alias("slope"), F.col("cost").cast("int").alias("cost"), F.lit(True).alias("inpainted"))
    leaves = cells.evaluate(leaves).withColumn("inpainted", F.lit(False)).unionByName(tables.save(filled, "filled"))
    leaves = spatial.occupancy(leaves, high)
    own = segment.segmented(split, segmentation).drop("label_source") if segmentation is not None else split.withColumn("label", ground.height_label(F.col("z_mm")))
    if labels is not None:
        given = labels.select("frame_id", "point_idx", F.col("label").alias("_label"))
        own = own.join(given, ["frame_id", "point_idx"], "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")
    leaves = tables.save(spatial.vegetation(leaves, own), "marked")
    drops = tables.save(hazards.dropoffs(low), "drops")
    ahead = hazards.nearest_hazards(tracks)
    circles = (
        thin.select("frame_id", (F.col("sum_x") / F.col("n")).alias("x"), (F.col("sum_y") / F.col("n")).alias("y"), F.col("radius").cast("double").alias("radius"), "cost")
        .unionByName(drops.select("frame_id", F.col("x_mm").cast("double").alias("x"), F.col("y_mm").cast("double").alias("y"), F.lit(600.0).alias("radius"), F.lit(255).alias("cost")))
        .unionByName(ahead.select("frame_id", (F.col("x") * 1000).alias("x"), (F.col("y") * 1000).alias("y"), (F.col("radius") * 1000).alias("radius"), "cost"))
    )
    leaves = spatial.centres(leaves.withColumn("terrain_cost", F.col("cost")))
    moving = tracks.where("is_dynamic")
    metres = leaves.withColumn("x", F.col("x_mm") / 1000).withColumn("y", F.col("y_mm") / 1000)
    leaves = tables.save(health.cleared(metres, moving).drop("x", "y"), "cleared")
    leaves = spatial.stamp(leaves, circles)
    state = tables.save(health.quadrant_health(health.quadrant_counts(split).withColumn("sensor_id", sensor), "sensor_id").drop("sensor_id"), "health")
    blind = state.where("is_degraded").select("frame_id", "quadrants")
    leaves = health.inflated(leaves, blind)
    leaves = tables.save(health.restored(leaves, memory, blind) if memory is not None else leaves, "costed")

    fixed = ahead.select("frame_id", (F.col("x") * 1000).alias("x"), (F.col("y") * 1000).alias("y"), (F.col("radius") * 1000).alias("radius"), "cost", "rank")
    statistics = telemetry.frame_statistics(split, leaves, tracks, thin, drops, objects, state)
    shown = raster.coarsened(leaves) if coarsen else leaves
    return Frame(split, leaves, thin, drops, objects, porous, tracks, state, raster.occupancy_grid(leaves, fixed), statistics, cells.band_counts(leaves), telemetry.frames(shown, tracks, most_cells), telemetry.documents(leaves, telemetry.sent_objects(tracks, hazards.cones(tracks), objects), statistics, split, most_cells))
