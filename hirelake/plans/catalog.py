"""Registered queries of the engine's own operators and the SQL they are held against."""

from __future__ import annotations

from hirelake.plans import extraction, matches, merges, pages, searches, streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (searches, extraction, matches, merges, pages, streams):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
