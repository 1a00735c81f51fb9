"""Block decomposition against plain sums."""

from __future__ import annotations

from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessara.operators import rolling

FACTS = "who string, at long, v long"


def brute(facts, who, at, length):
    return sum(v or 0 for w, t, v in facts if w == who and t is not None and at - length < t <= at)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-40, 40) | st.none(), st.integers(-5, 90) | st.none()), max_size=40), st.sampled_from([1, 2, 7, 30]))
def test_totals_equal_plain_sums(spark, facts, length):
    asked = [(w, t) for w in ("a", "b", "c") for t in (-41, -7, 0, 1, 13, 29, 40, 70)]
    frame = spark.createDataFrame(asked, "who string, at long")
    out = rolling.totals_at(frame, spark.createDataFrame(facts, FACTS), "who", "at", "v", {"total": length}).collect()
    assert {(r["who"], r["at"]): r["total"] for r in out} == {(w, t): brute(facts, w, t, length) for w, t in asked}


def test_asked_rows_survive_nulls_repeats_and_clashing_names(spark):
    asked = spark.createDataFrame([("a", 3, "x", 1), ("a", 3, "x", 1), (None, 3, None, None), ("a", None, "y", 2)], "who string, at long, prefix string, total int")
    facts = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("a", 3, None), (None, 3, 100)], FACTS)
    out = rolling.totals_at(asked, facts, "who", "at", "v", {"total": 7})
    assert sorted(out.columns) == ["at", "prefix", "total", "who"]
    assert sorted([tuple(r) for r in out.select("who", "at", "prefix", "total").collect()], key=str) == sorted([("a", 3, "x", 11), ("a", 3, "x", 11), (None, 3, None, 0), ("a", None, "y", None)], key=str)


def test_empty_facts(spark):
    facts = spark.createDataFrame([], FACTS)
    asked = spark.createDataFrame([("a", 1)], "who string, at long")
    assert rolling.totals_at(asked, facts, "who", "at", "v", {"total": 7}).first()["total"] == 0
    assert rolling.block_sums(facts, "who", "at", "v", 7).count() == 0


def test_every_day_has_a_row(spark):
    start = date(2025, 8, 20)
    facts = [("a", start, 90), ("a", start + timedelta(3), 45), ("a", start + timedelta(40), 10), ("b", start, 1), (None, start, 9)]
    frame = spark.createDataFrame(facts, "who string, day date, minutes long")
    out = {(r["who"], r["day"]): r for r in rolling.daily_totals(frame, "who", "day", "minutes", {"m7": 7, "m30": 30}).collect()}
    assert len(out) == 41 + 1
    for (who, day), r in out.items():
        for name, n in (("m7", 7), ("m30", 30)):
            expected = sum(v for w, d, v in facts if w == who and day - timedelta(n) < d <= day)
            assert r[name] == expected and abs(r[f"mean_{name}"] - expected / n) < 1e-12
    assert out["a", start + timedelta(1)]["minutes"] == 0


def test_trailing_events_leave_the_row_itself_out(spark):
    rows = [("a", k, 10 * k) for k in range(9)] + [("b", 0, None)]
    out = {(r["who"], r["at"]): r for r in rolling.trailing_events(spark.createDataFrame(rows, FACTS), "who", ["at"], "v", 5).collect()}
    assert out["a", 0]["trailing_mean"] is None and out["b", 0]["trailing_mean"] is None
    for k in range(1, 9):
        held = [10 * j for j in range(max(0, k - 5), k)]
        assert out["a", k]["trailing_n"] == len(held) and abs(out["a", k]["trailing_mean"] - sum(held) / len(held)) < 1e-12


def test_hot_entity_has_the_same_totals(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 500)).alias("who"), (F.col("id") % 50).alias("at"), F.lit(1).alias("v"))
    out = rolling.totals_at(spark.createDataFrame([("hot", 49)], "who string, at long"), facts, "who", "at", "v", {"total": 50})
    assert out.first()["total"] == 1000


def test_event_numbers_span_buckets(spark):
    rows = [("a", k * 50 - 1000, k) for k in range(40)] + [("a", -1000, 99), ("a", None, 5), (None, 3, 1), (None, 4, 2)]
    out = rolling.event_numbers(spark.createDataFrame(rows, FACTS), "who", ["at", "v"], "n").collect()
    got = {(r["who"], r["at"], r["v"]): r["n"] for r in out}
    mine = sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert [got[r] for r in mine] == list(range(len(mine)))
    assert len(out) == len(rows) and all(got[r] is None for r in rows if r[0] is None)
    means = rolling.trailing_events(spark.createDataFrame(rows, FACTS), "who", ["at", "v"], "v", 5).where("who is null").collect()
    assert [(r["trailing_n"], r["trailing_mean"]) for r in means] == [(None, None)] * 2


def test_every_note_has_its_day_in_the_season(spark, tiny):
    """Days before a player's first match and after the last are there, as the notes ask for them."""
    from tessara.plans.problems import QUERIES
    from tessara.sources.tables import table

    notes = table(spark, tiny, "load_report", "player_id", "day").distinct().withColumnRenamed("day", "match_date")
    lacking = lambda name: notes.join(QUERIES[name](spark, tiny), ["player_id", "match_date"], "left_anti").count()
    assert lacking("p1_season") == 0 < lacking("p1_daily")
