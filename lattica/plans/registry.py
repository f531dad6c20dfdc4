"""All queries: name -> function of (spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

from . import catalog, changes, grid, joining, scalars, series, timelines  # noqa: F401  (each registers its queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
