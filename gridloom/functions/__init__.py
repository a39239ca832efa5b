"""Functions for SQL: register(spark) makes them available by name."""

from gridloom.functions.sql import register

__all__ = ["register"]
