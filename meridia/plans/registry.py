"""All core queries and their SQL, by name."""

from __future__ import annotations

from meridia.plans import change_queries, core_queries, core_sql, place_queries, rule_queries, state_queries


def queries() -> dict:
    return {"p2_found": change_queries.p2_found} | place_queries.p3_p7_queries() | core_queries.QUERIES | rule_queries.QUERIES | state_queries.QUERIES


def oracle_sql() -> dict:
    return {"p2_found": change_queries.P2_SQL} | place_queries.p3_p7_sql() | core_sql.SQL | rule_queries.SQL | state_queries.SQL
