"""All queries of the engine's own operators, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawl.plans import contract_plans, evaluation_plans, relation_plans, retrieval_plans, review_plans, run_plans, selection_plans, source_plans, text_plans

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "tfidf_top20"
_MODULES = [text_plans, retrieval_plans, evaluation_plans, relation_plans, source_plans, selection_plans, review_plans, run_plans, contract_plans]


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
