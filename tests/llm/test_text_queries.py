"""Every registered text query runs on whole tables."""

from __future__ import annotations

import pytest

from helpers import as_rows, rows_of

from tessara.llm import queries, registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(name, spark, tiny, oracle):
    frame = registry.QUERIES[name](spark, tiny)
    columns, rows = oracle(registry.SQL[name])
    assert sorted(frame.columns) == sorted(columns)
    assert as_rows(frame) == rows_of(columns, rows)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(name, spark, tiny):
    frame = registry.QUERIES[name](spark, tiny)
    assert len(set(frame.columns)) == len(frame.columns) and frame.count() > 0


def test_columns(spark, tiny):
    assert dict(queries.p2_found(spark, tiny).dtypes) == {"source_table": "string", "row_id": "bigint"}
    assert dict(queries.p3_found(spark, tiny).dtypes) == {"player_id": "bigint", "source": "string", "source_id": "string"}
    assert dict(queries.p8_ids(spark, tiny).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert dict(queries.p10_found(spark, tiny).dtypes) == {"doc_id": "bigint"}


def test_containers_are_nearly_full(spark, tiny):
    rows = queries.p9_containers(spark, tiny).collect()
    assert sum(r["n_tokens"] for r in rows) > 2048 * (len({r["container"] for r in rows}) - 1)
