"""The queries outside the llm subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from potflow.operators import nested, references, units
from potflow.plans import corpus_queries, graph_queries, graph_sql, response_queries, response_sql


def queries() -> dict[str, Callable]:
    return {
        "p2_found": nested.p2_found,
        "p2_objects": nested.p2_objects,
        "p2_records": nested.p2_records,
        "p4_found": references.p4_found,
        "p4_report": references.p4_report,
        "p5_found": units.p5_found,
        **graph_queries.QUERIES,
        **response_queries.QUERIES,
        **corpus_queries.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return nested.SQL | references.SQL | graph_sql.SQL | response_sql.SQL | corpus_queries.SQL
