"""Every query of the reference's own operators, with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholarframe.queries import accounts, asking, citing, evidence, graphs, integration, library, reading, works

_MODULES = (works, graphs, accounts, evidence, citing, reading, integration, library, asking)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
