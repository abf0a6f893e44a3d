"""Every query of the library by name, with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis, files, imaging, tiling

_ALL = tiling.QUERIES | analysis.QUERIES | imaging.QUERIES | files.QUERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
