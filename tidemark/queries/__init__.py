"""Registered queries: every operator over the driver tables, with its SQL where SQL can
say the same thing."""

from tidemark.queries import (  # noqa: F401
    aggregates,
    artifacts,
    calibration,
    drift_models,
    live,
    monitoring,
    ordering,
    projections,
    ranking,
    robust,
    scans,
    searches,
)
from tidemark.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
