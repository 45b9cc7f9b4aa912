"""All registered queries outside the corpus part, with their DuckDB equivalents."""

from __future__ import annotations

from tideline.plans import detection, reports

_PARTS = (detection, reports)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE = {name: q for part in _PARTS for name, q in part.ORACLE.items()}
