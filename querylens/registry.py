"""Named queries over the driver tables and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLES[name]`` is
SQL text that DuckDB runs over the same parquet tables (registered as views
under their table names).  Every computed column is aliased identically on
both sides, doubles are rounded to 6 places and counts are BIGINT so that
value hashes compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from .checks import (  # noqa: F401
        q_querylog, q_features, q_labels, q_metrics, q_splits, q_catalog_history, q_workload_reports, q_plans, q_models, q_classifiers, q_streaming, q_io,
    )
