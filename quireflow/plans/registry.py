"""All queries of the core library: name -> (spark, sf_dir) -> DataFrame, and their SQL oracles."""

from __future__ import annotations

from . import aggregates, catalog, joins, pages, pipeline, projections, rules, scalars, sources, windows  # noqa: F401

QUERIES: dict = {**catalog.QUERIES, **pipeline.QUERIES}
SQL: dict[str, str] = {**catalog.SQL, **pipeline.SQL}
