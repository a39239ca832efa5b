"""Parameters of the operators; lengths in millimetres, costs from 0 to 255."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Bounds:
    """The mapped box, closed on all sides."""

    x_min: int = -40_000
    x_max: int = 60_000
    y_min: int = -35_000
    y_max: int = 35_000
    z_min: int = -2_500
    z_max: int = 3_000


@dataclass(frozen=True)
class Grid:
    """Cell sizes and what splits a cell."""

    coarse: int = 500
    fine: int = 125
    step: int = 180
    least_points: int = 3


@dataclass(frozen=True)
class Costs:
    """Bands: safe up to SAFE, caution up to CAUTION, lethal beyond."""

    safe: int = 50
    caution: int = 180
    lethal: int = 255


BOUNDS, GRID, COSTS = Bounds(), Grid(), Costs()
SENSOR_HEIGHT = 1_600
