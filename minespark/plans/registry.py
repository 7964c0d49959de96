"""All queries of the core and their SQL."""

from __future__ import annotations

from minespark.plans import claims, files, mining, models, relational, trees

_MODULES = [claims, trees, relational, mining, models, files]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
