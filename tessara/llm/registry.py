"""All queries of the subpackage, by name, and their SQL."""

from __future__ import annotations

from tessara.llm import checks, queries

QUERIES = {**queries.QUERIES, **checks.QUERIES}
SQL = checks.SQL
