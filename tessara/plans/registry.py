"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessara.plans import checks, forms, learned, problems, relations, scoring, summaries

QUERIES = {**forms.QUERIES, **relations.QUERIES, **summaries.QUERIES, **learned.QUERIES, **scoring.QUERIES, **checks.QUERIES, **problems.QUERIES}
SQL = {**forms.SQL, **relations.SQL, **summaries.SQL, **learned.SQL, **scoring.SQL, **checks.SQL, **problems.SQL}
