"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from loadstone.plans import data_queries, reference_queries, reference_sql, report_queries

QUERIES = {**reference_queries.QUERIES, **report_queries.QUERIES, **data_queries.QUERIES}
ORACLE = {**reference_sql.ORACLE, **report_queries.ORACLE, **data_queries.ORACLE}
