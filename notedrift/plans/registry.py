"""Registry of the queries exposed through ``__spark_entry__``.

``@register(name, oracle=sql)`` records a Spark query ``fn(spark, sf_dir) ->
DataFrame`` and, where the operator is SQL-expressible, its DuckDB oracle text.
Computed columns carry the same names on both sides; doubles are rounded to 6
places and integers are BIGINT on both sides so value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its queries register."""
    from . import q_filings, q_panel, q_text, q_stats, q_models, q_linear, q_experiments  # noqa: F401
