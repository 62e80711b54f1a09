"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from potflow.llm import abuse, canonical, leakage, packing, signature_tree, sql, term_counts


def queries() -> dict[str, Callable]:
    return {
        "p1_found": term_counts.p1_found,
        "p1_terms": term_counts.p1_terms,
        "p3_found": canonical.p3_found,
        "p3_misses": canonical.p3_misses,
        "p6_found": signature_tree.p6_found,
        "p6_groups": signature_tree.p6_groups,
        "p7_containers": packing.p7_containers,
        "p7_report": packing.p7_report,
        "p8_found": leakage.p8_found,
        "p8_items": leakage.p8_items,
        "p9_found": abuse.p9_found,
        "p9_rates": abuse.p9_rates,
    }


def oracle_sql() -> dict[str, str]:
    return sql.SQL
