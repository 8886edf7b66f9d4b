"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

import importlib

_MODULES = ["rule_queries", "retrieval_queries", "document_queries", "verdict_queries", "chat_queries"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"pactscope.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
