"""Instants against a plain reading of the texts."""

from __future__ import annotations

import pytest
from brute_instants import seconds

from tessara.operators import instants
from tessara.plans import problems
from tessara.sources.tables import table


def read(spark, rows, prefix=False):
    frame = spark.createDataFrame(rows, "text string, zone string, ord string")
    return [r["at"] for r in instants.add_instant(frame, "text", "zone", "ord", "at", prefix).collect()]


CASES = [
    ("2025-08-15T19:00:00Z", None, None, 1755284400),
    ("2025-08-15 20:00:00", "Europe/London", "dmy", 1755284400),
    ("15/08/2025 20:00", "Europe/London", "dmy", 1755284400),
    ("08/15/2025 15:00", "America/New_York", "mdy", 1755284400),
    ("15.08.25 21:00", "Europe/Berlin", "dmy", 1755284400),
    ("1755284400", None, None, 1755284400),
    ("1755284400999", None, None, 1755284400),
    ("15-Aug-2025 8:00 PM", "Europe/London", "dmy", 1755284400),
    ("Fri, 15 Aug 2025 19:00:00 GMT", None, None, 1755284400),
    ("Fri 15 Aug 2025, 15:00 EDT", None, None, 1755284400),
    ("2025-08-15T20:00:00+01:00[Europe/London]", None, None, 1755284400),
    ("20250815T190000Z", None, None, 1755284400),
    ("16-Aug-2025 12:30 AM", "UTC", "dmy", 1755304200),
    ("2024-02-29 00:00", "UTC", "dmy", 1709164800),
    # no time, no day, no zone, no order
    ("2025-08-15", "UTC", "dmy", None),
    ("TBC", "UTC", "dmy", None),
    ("", "UTC", "dmy", None),
    (None, "UTC", "dmy", None),
    ("2025-08-15 20:00:00", None, None, None),
    ("15/08/2025 20:00", "UTC", None, None),
    ("2025-02-30T15:00:00Z", "UTC", "dmy", None),
    ("2025-02-29 15:00", "UTC", "dmy", None),
    ("2025-08-00 15:00", "UTC", "dmy", None),
    ("2025-08-17T24:75:00Z", "UTC", "dmy", None),
    ("13-Aug-2025 13:00 PM", "UTC", "dmy", None),
    # repeated and skipped local times
    ("2025-10-26 01:30", "Europe/London", "dmy", 1761438600),
    ("2026-03-29 01:30", "Europe/London", "dmy", 1774747800),
    ("x" * 100_000, "UTC", "dmy", None),
]


def test_cases(spark):
    got = read(spark, [c[:3] for c in CASES])
    assert [(c[0], g) for c, g in zip(CASES, got)] == [(c[0], c[3]) for c in CASES]


def test_titles_may_follow_the_time(spark):
    rows = [("2025-08-15 19:00:00 Norkowick FC v Gaveth", "UTC", "dmy"), ("2025-08-15 Cesta v Estar", "UTC", "dmy"), ("15-Aug-2025 8:00 PM AFC Pendo-Fenby", "Europe/London", "dmy")]
    assert read(spark, rows, True) == [1755284400, None, 1755284400]


def test_other_columns_stay(spark):
    frame = spark.createDataFrame([(5, "2025-08-15T19:00:00Z", None, None, 1, 2)], "id int, text string, zone string, ord string, at int, y int")
    out = instants.add_instant(frame, "text", "zone", "ord", "at")
    assert out.columns == ["id", "text", "zone", "ord", "y", "at"] and tuple(out.first()) == (5, "2025-08-15T19:00:00Z", None, None, 2, 1755284400)
    assert instants.add_instant(frame.limit(0), "text", "zone", "ord", "at").count() == 0


@pytest.mark.parametrize("name", sorted(problems.TIMED))
def test_all_texts_of_a_table(name, spark, tiny):
    text, prefix = problems.TIMED[name]
    zones = {r["feed"]: r for r in table(spark, tiny, "feed_zones").collect()}
    rows = problems.with_instants(table(spark, tiny, name, "row_id", "feed", text), table(spark, tiny, "feed_zones"), text, prefix).collect()
    for r in rows:
        zone = zones.get(r["feed"])
        assert r["kickoff_epoch_s"] == seconds(r[text], zone and zone["time_zone"], zone and zone["date_order"], prefix), r


def test_one_match_for_each_text(spark, tiny):
    """The expression is not repeated by the optimizer: neither collapsed into later columns nor pushed into filters."""
    plan = problems.p4_found(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?is)") == 3
