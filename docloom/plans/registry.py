"""All core queries and their SQL counterparts, collected from the modules of this package."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = ("ingest_queries", "text_queries", "archive_queries", "model_queries")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    if importlib.util.find_spec(f"docloom.plans.{_name}") is None:
        continue
    _module = importlib.import_module(f"docloom.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
