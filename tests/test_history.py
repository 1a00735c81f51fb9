"""Histories and attributes as known, against plain loops."""

from __future__ import annotations

from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessara.operators import history

SNAPSHOTS = "id long, who long, gw long, position string, seen timestamp"
DEADLINES = [(g, datetime(2025, 8, g, 12)) for g in range(1, 13)]
snapshot = st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([*range(1, 9), None]), st.sampled_from(["A", "B", None]), st.integers(1, 14))


def rows_of(items):
    return [(k, w, g, p, datetime(2025, 8, d, 9)) for k, (w, g, p, d) in enumerate(items)]


def firsts(rows):
    out = {}
    for k, w, g, p, t in rows:
        if None not in (w, g, p) and (t, k) < out.get((w, g), ((datetime.max, 0), None))[0]:
            out[w, g] = ((t, k), p)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(snapshot, max_size=25))
def test_versions_and_known_values(spark, items):
    rows = rows_of(items)
    frame = spark.createDataFrame(rows, SNAPSHOTS)
    first = history.first_recorded(frame, "who", "gw", "seen", F.col("position"), "id")
    got = {tuple(r) for r in history.version_periods(history.fold_versions(first, "who", "gw", "value"), "who").collect()}
    expected = set()
    for who in (1, 2):
        line = sorted((g, p) for (w, g), (_, p) in firsts(rows).items() if w == who)
        starts = [x for k, x in enumerate(line) if k == 0 or line[k - 1][1] != x[1]]
        expected |= {(who, p, g, starts[k + 1][0] - 1 if k + 1 < len(starts) else 0) for k, (g, p) in enumerate(starts)}
    assert got == expected

    deadlines = spark.createDataFrame(DEADLINES, "gw long, closes timestamp")
    known = history.known_versions(frame, "who", "gw", "seen", F.col("position"), deadlines, "closes", "id")
    asked = spark.createDataFrame([(w, g) for w in (1, 2, 3, None) for g in range(1, 13)], "who long, gw long")
    for r in history.as_known(asked, "who", "gw", {"position": known}).collect():
        open_ = [(-g, t, k, p) for k, w, g, p, t in rows if w is not None and w == r["who"] and g is not None and p is not None and g <= r["gw"] and t <= DEADLINES[r["gw"] - 1][1]]
        assert r["known_position"] == (min(open_)[3] if open_ else None), (r, rows)


def test_two_attributes_change_on_their_own(spark):
    rows = [(1, 7, 1, "MID", "X", datetime(2025, 8, 1)), (2, 7, 2, None, "Y", datetime(2025, 8, 2)), (3, 7, 4, "DEF", None, datetime(2025, 8, 30))]
    frame = spark.createDataFrame(rows, "id long, who long, gw long, position string, team string, seen timestamp")
    deadlines = spark.createDataFrame(DEADLINES, "gw long, closes timestamp")
    of = lambda c: history.known_versions(frame, "who", "gw", "seen", F.col(c), deadlines, "closes", "id")
    events = spark.createDataFrame([(7, 1, "old"), (7, 2, "old"), (7, 9, "old"), (7, 9, "old"), (8, 9, None), (7, None, None)], "who long, gw long, known_team string")
    out = history.as_known(events, "who", "gw", {"position": of("position"), "team": of("team")})
    assert out.columns == ["who", "gw", "known_position", "known_team"]
    got = sorted([tuple(r) for r in out.collect()], key=str)
    # the row for gameweek 4 became known after the last deadline
    assert got == sorted([(7, 1, "MID", "X"), (7, 2, "MID", "Y"), (7, 9, "MID", "Y"), (7, 9, "MID", "Y"), (8, 9, None, None), (7, None, None, None)], key=str)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SNAPSHOTS)
    first = history.first_recorded(frame, "who", "gw", "seen", F.col("position"), "id")
    assert history.version_periods(history.fold_versions(first, "who", "gw", "value"), "who").count() == 0
    deadlines = spark.createDataFrame([], "gw long, closes timestamp")
    known = history.known_versions(frame, "who", "gw", "seen", F.col("position"), deadlines, "closes", "id")
    asked = spark.createDataFrame([(1, 1)], "who long, gw long")
    assert history.as_known(asked, "who", "gw", {"position": known}).first()["known_position"] is None
