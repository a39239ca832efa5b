"""Side tables: class maps, model and threshold settings in JSON, detector settings in YAML."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Detector:
    """What a pillar detector reads: the box of points (least, then greatest x, y, z), the pillar's sides, and class names."""

    point_range: tuple[float, ...] = (-51.2, -51.2, -5.0, 51.2, 51.2, 3.0)
    voxel: tuple[float, float, float] = (0.2, 0.2, 8.0)
    classes: tuple[str, ...] = ("car", "truck", "construction_vehicle", "bus", "trailer", "barrier", "motorcycle", "bicycle", "pedestrian", "traffic_cone")

    @property
    def grid(self) -> tuple[int, int, int]:
        """Pillars along x, y and z."""
        return tuple(round((self.point_range[k + 3] - self.point_range[k]) / self.voxel[k]) for k in range(3))


def _text(spark: SparkSession, path: str) -> str | None:
    """A small file's text through Spark's readers, None if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.text(path, wholetext=True).first().value


def settings(spark: SparkSession, path: str, default: Any = None) -> Any:
    """A JSON file as it is, or default where it is absent or not JSON."""
    text = _text(spark, path)
    try:
        return default if text is None else json.loads(text)
    except ValueError:
        return default


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """label, name from a JSON object of numbers to names; entries whose key is no number are left out."""
    found = settings(spark, path, {})
    rows = [(int(k), str(v)) for k, v in found.items() if k.lstrip("-").isdigit()] if isinstance(found, dict) else []
    return spark.createDataFrame(rows, "label int, name string")


def threshold(spark: SparkSession, path: str, key: str = "threshold", default: float = 0.75) -> float:
    """A number of a JSON file, default where it is absent or no number."""
    found = settings(spark, path, {})
    value = found.get(key) if isinstance(found, dict) else None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else default


def detector(spark: SparkSession, path: str | None = None) -> Detector:
    """A detector's settings from YAML (or JSON, which is YAML); defaults for what is absent or of the wrong size."""
    text = _text(spark, path) if path else None
    if text is None:
        return Detector()
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            return Detector()
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError:
            return Detector()
    if not isinstance(found, dict):
        return Detector()
    usual, data = Detector(), found.get("DATA_CONFIG") or {}
    box = tuple(float(v) for v in data.get("POINT_CLOUD_RANGE", usual.point_range))
    sides = next((tuple(float(v) for v in p["VOXEL_SIZE"]) for p in data.get("DATA_PROCESSOR", []) if "VOXEL_SIZE" in p), usual.voxel)
    return Detector(box if len(box) == 6 else usual.point_range, sides if len(sides) == 3 else usual.voxel, tuple(found.get("CLASS_NAMES", usual.classes)))
