"""All queries of the library, but for those of the subpackage ``llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomfield.plans import data_quality, document_queries, edit_queries, retrieval_queries, search_queries, source_queries, state_queries, structure_queries, usage_queries

FLAGSHIP = "usage_summary"
MODULES = (usage_queries, search_queries, structure_queries, document_queries, retrieval_queries, edit_queries, source_queries, state_queries, data_quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out |= module.SQL
    return out
