"""Every registered query and its SQL counterpart."""

from __future__ import annotations

from annolens.plans import boxes, corpora, files, helpers, matches, tracks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (boxes, corpora, tracks, files, helpers, matches):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
