"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import importlib

QUERIES = {}
ORACLE_SQL = {}

for _name in ("lm_score", "secret_scan", "quote_threads", "jaccard_join", "media_jpeg", "quality_qda", "temperature_mix", "language_cnn", "decontaminate", "pii_scan"):
    _module = importlib.import_module(f"veristrata.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
