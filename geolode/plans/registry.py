"""All registered queries and their SQL."""

from __future__ import annotations

from geolode.plans import meshes, oracles, queries, shapes

QUERIES = queries.QUERIES
SQL: dict[str, str] = oracles.SQL | shapes.SQL | meshes.SQL
