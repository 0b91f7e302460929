"""Queries of the engine's own operators and the SQL each must agree with."""

from __future__ import annotations

from riskloom.plans import advisories, feeds, graphs, matching, requests, scans, stores, texts, versions

_PARTS = (versions, advisories, feeds, matching, requests, stores, graphs, texts, scans)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL: dict = {k: v for part in _PARTS for k, v in part.SQL.items()}
