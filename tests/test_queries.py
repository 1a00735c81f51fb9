"""Every registered query of the core: against its SQL, or at least that it runs with a stable schema."""

from __future__ import annotations

import pytest
from helpers import as_rows, rows_of

from tessara.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(name, spark, tiny, oracle):
    frame = registry.QUERIES[name](spark, tiny)
    columns, rows = oracle(registry.SQL[name])
    assert sorted(frame.columns) == sorted(columns)
    assert as_rows(frame) == rows_of(columns, rows)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(name, spark, tiny):
    frame = registry.QUERIES[name](spark, tiny)
    assert len(set(frame.columns)) == len(frame.columns)
    assert frame.count() > 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark, tiny):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_the_text_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; import tessara.plans.registry, tessara.streaming.events, tessara.sources.files, tessara.sources.sinks, tessara.operators.quality; assert not any(m.startswith('tessara.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
