"""Queries of the keypoint operators and their SQL."""

from __future__ import annotations

from kinefold.plans import q_geometry, q_joins, q_metrics, q_sampling, q_sources, q_tracking  # noqa: F401
from kinefold.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
