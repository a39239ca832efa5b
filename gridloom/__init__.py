"""Spatial sweep analytics on DataFrames: filtering, gridding, costing, tracking and telemetry."""
