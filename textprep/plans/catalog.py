"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the operator is SQL-expressible, the equivalent DuckDB query over the same
parquet tables (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from textprep.plans import (  # noqa: F401
        q_aggregate,
        q_arrays,
        q_flows,
        q_metrics,
        q_models,
        q_relational,
        q_sampling,
        q_scan,
        q_text,
        q_vocab,
    )
