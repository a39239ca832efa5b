"""Segmentation of range images by a pluggable network: pixels to a dense tensor, labels back to points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.models import Model
from gridloom.operators.ground import height_label, range_image, spherical
from gridloom.operators.telemetry import labels_of_pixels

#: The image, and the channels of a pixel in order (metres, and intensity from 0 to 1).
ROWS, COLUMNS = 64, 1024
CHANNELS = ("r", "x", "y", "z", "i")


def tensor(v: np.ndarray, u: np.ndarray, values: np.ndarray, rows: int = ROWS, columns: int = COLUMNS) -> np.ndarray:
    """1 x channels x rows x columns of float32 with a pixel's values (n x channels) where there is one, and zeros."""
    out = np.zeros((1, values.shape[1], rows, columns), np.float32)
    out[0, :, v, u] = values
    return out


def labels_of(scores: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """rows x columns of labels, from scores by class (1 x classes x rows x columns) or from labels as they are."""
    scores = np.asarray(scores)
    if scores.size == rows * columns:
        return scores.reshape(rows, columns).astype(np.int32)
    if scores.shape[-2:] != (rows, columns):
        raise ValueError(f"a model of {rows} x {columns} pixels answered with {scores.shape}")
    return scores.reshape(-1, rows, columns).argmax(axis=0).astype(np.int32)


def pixel_labels(points: DataFrame, model: Model, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """frame_id, v, u, label of each pixel that a point is in; none unless the model is READY.

    A frame's image is one input of the model, 5 x rows x columns: at most as many pixels are gathered for it, however many
    points the frame has, as the nearest point of each pixel is found before.
    """
    schema = "frame_id bigint, v int, u int, label int"
    image = range_image(points, rows=rows, columns=columns)
    if model.predict is None:
        return image.select("frame_id", "v", "u", F.lit(0).alias("label")).limit(0)
    predict = model.predict

    def run(frame: pa.Table) -> pa.Table:
        v, u = frame.column("v").to_numpy(), frame.column("u").to_numpy()
        values = np.stack([frame.column(c).to_numpy() for c in CHANNELS], axis=1)
        labels = labels_of(predict(tensor(v, u, values, rows, columns)), rows, columns)
        return pa.table({"frame_id": frame.column("frame_id"), "v": frame.column("v"), "u": frame.column("u"), "label": pa.array(labels[v, u], pa.int32())})

    metres = [(F.col(f"{c}_mm") / 1000.0).alias(c) for c in "xyz"]
    own = image.select("frame_id", "v", "u", "r", *metres, (F.col("i_pct") / 100.0).alias("i"))
    return own.groupBy("frame_id").applyInArrow(run, schema)


def segmented(points: DataFrame, model: Model, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """points with label and label_source: the model's label of their pixel (model), or one by height (height) for points
    outside of the image and wherever the model is not READY."""
    if model.predict is None:
        return points.withColumn("label", height_label(F.col("z_mm"))).withColumn("label_source", F.lit("height"))
    seen = spherical(points, rows=rows, columns=columns)
    out = labels_of_pixels(seen, pixel_labels(points, model, rows, columns))
    return out.withColumn("label_source", F.when(F.col("u") >= 0, "model").otherwise("height")).select(*points.columns, "label", "label_source")
