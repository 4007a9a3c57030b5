"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly, exports, inventory, knowledge, publication, records, retrieval, rules

MODULES = (knowledge, retrieval, exports, assembly, inventory, rules, publication, records)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
