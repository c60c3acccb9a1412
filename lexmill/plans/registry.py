"""All plans of the core package: name -> (spark, folder) -> DataFrame, and name -> SQL where DuckDB can express it."""

from __future__ import annotations

from . import corpus_plans, label_plans, retrieval_plans, text_plans

_MODULES = (text_plans, retrieval_plans, corpus_plans, label_plans)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: s for m in _MODULES for name, s in m.ORACLE.items()}
