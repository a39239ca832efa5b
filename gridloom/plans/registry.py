"""Collects the query modules' registries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import cell_queries, frame_queries, object_queries, point_queries, raster_queries, terrain_queries

_MODULES = (point_queries, cell_queries, terrain_queries, raster_queries, object_queries, frame_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> (spark, sf_dir) -> DataFrame, over all query modules."""
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL, over all query modules."""
    out: dict[str, str] = {}
    for module in _MODULES:
        out.update(module.ORACLE)
    return out
