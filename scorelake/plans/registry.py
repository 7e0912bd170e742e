"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus
the DuckDB SQL that must return the same rows (absent for rows-only checks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
HEADLINE = ["admin_latest", "counterfactual", "auc", "scorecard_score", "shap_linear", "sensitivity"]


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that it registers its queries."""
    for mod in ("reports", "prepare", "reconcile", "model", "whatif", "sources", "stream", "trees", "resample", "survey"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as exc:  # module not written yet
            if exc.name != f"{__package__}.{mod}":
                raise
