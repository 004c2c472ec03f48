"""All registered queries (id -> callable) and their DuckDB oracles."""

from __future__ import annotations

from wharf.plans import queries_feed, queries_feeds7, queries_marts, queries_sources, queries_views

QUERIES: dict = {}
ORACLES: dict = {}

for _mod in (queries_feed, queries_views, queries_marts, queries_feeds7, queries_sources):
    QUERIES.update(_mod.QUERIES)
    ORACLES.update(_mod.ORACLES)
