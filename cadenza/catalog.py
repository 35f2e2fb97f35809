"""All queries outside the training-data subpackage, and their DuckDB SQL."""

from __future__ import annotations

from cadenza.plans import aggregate_queries, field_queries, geometry_queries, grid_queries, join_queries, repair_queries, scalar_queries, select_queries, sequence_queries, telemetry_queries, view_queries  # noqa: F401
from cadenza.plans.registry import ORACLES, QUERIES  # noqa: F401
