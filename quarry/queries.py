"""Queries by name, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from quarry.plans import answer_queries, chunk_queries, metric_queries, pipeline_queries, precedence_queries, record_queries, retrieval_queries, service_queries, source_queries, text_queries  # noqa: F401
from quarry.plans.corpus import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
