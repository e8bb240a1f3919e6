"""Registered queries over the star-schema tables and the SQL that checks them."""

from . import cell_queries, grid_queries, mesh_queries, science_queries, spline_queries, track_queries  # noqa: F401
from .views import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
