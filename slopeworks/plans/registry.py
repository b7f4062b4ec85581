"""All registered queries of the hazard analytics part, with their SQL."""

from __future__ import annotations

from slopeworks.plans import checks, formats, hazard, learning, regions, scalars, streams, terrain  # noqa: F401  each registers its queries

QUERIES = hazard.QUERIES | streams.QUERIES
ORACLE = hazard.ORACLE | streams.ORACLE
