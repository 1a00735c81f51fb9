"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessara.session import local_session

    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny() -> str:
    """The smallest test tables."""
    if not (DATA / "sf0.001").exists():
        pytest.skip("no test tables here")
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def oracle(tiny):
    """Rows of an SQL text over the smallest tables, as dicts."""
    import duckdb

    connection = duckdb.connect()
    for table in Path(tiny).glob("*.parquet"):
        connection.execute(f"create view {table.stem} as select * from '{table if table.is_file() else str(table) + '/*.parquet'}'")

    def run(sql: str) -> tuple[list[str], list[tuple]]:
        result = connection.execute(sql)
        return [d[0] for d in result.description], result.fetchall()

    return run
