"""Matching on small invented sources with known truth."""

from __future__ import annotations

import random

from tessara.llm import matching as M

COLUMNS = "who string, name string, match string, minutes int, goals int, assists int"
GIVEN = ["Tosic", "Maín", "Vlauş", "Brorim", "Jeane", "Skarar", "Lolim", "Près"]
LAST = ["Galmgorerin", "Hếiạng", "Tumbøl", "Zwandeth", "Šeimłek", "Kranwick", "Obriath", "Yewick"]


def sources(n=64, seed=4):
    """Two sources of one season: half the names are shortened, minutes differ a little, some appearances are missing."""
    r = random.Random(seed)
    left, right, hints = [], [], []
    for k in range(n):
        first, last, squad = GIVEN[k % 8], LAST[k // 8 % 8], k // 16
        other = f"{first[0]}. {last}" if r.random() < 0.3 else f"{last} {first}" if r.random() < 0.2 else f"{first} {last}"
        for m in range(20):
            if r.random() < 0.4:
                continue
            minutes, goals = r.choice([90, 90, 90, r.randint(1, 89)]), int(r.random() < 0.1)
            left.append((f"p{k}", f"{first} {last}", f"{squad}/{m}", minutes, goals, 0))
            if r.random() < 0.95:
                right.append((f"x{k}", other, f"{squad}/{m}", minutes - (r.random() < 0.15), goals, 0))
        hints.append((f"p{k}", other if r.random() < 0.9 else "Somebody Else"))
    right += [(f"z{k}", f"Ander {LAST[k % 8]}", f"{k % 4}/{m}", r.randint(1, 90), 0, 0) for k in range(6) for m in range(8)]
    return left, right, hints


def test_truth_is_found(spark):
    left, right, hints = sources()
    a = M.profiles(spark.createDataFrame(left, COLUMNS), "who", "name", "match", ["minutes"], ["goals", "assists"])
    b = M.profiles(spark.createDataFrame(right + right[:50], COLUMNS), "who", "name", "match", ["minutes"], ["goals"])
    out = M.match(a, b, spark.createDataFrame(hints, "left_id string, hinted string")).collect()
    right_ones = [r for r in out if r["left_id"][1:] == r["right_id"][1:] and r["right_id"][0] == "x"]
    assert len(right_ones) >= 60 and len(out) - len(right_ones) <= 1
    assert all(0.5 <= r["probability"] <= 1 for r in out)
    assert len({r["left_id"] for r in out}) == len({r["right_id"] for r in out}) == len(out)


def test_without_hints_and_with_holes(spark):
    left = [("a", "Maín Tumbøl", "1", 90, 1, 0), ("a", "Maín Tumbøl", "2", 45, 0, 0), ("b", None, "1", 90, 0, 0), (None, "x", "1", 1, 0, 0), ("c", "y", None, 5, 0, 0)]
    right = [("r", "Main Tumbol", "1", 90, 1, 0), ("r", "Main Tumbol", "2", 45, 0, 0), ("s", None, "9", None, None, None)]
    a = M.profiles(spark.createDataFrame(left, COLUMNS), "who", "name", "match", ["minutes"], ["goals"])
    b = M.profiles(spark.createDataFrame(right, COLUMNS), "who", "name", "match", ["minutes"], ["goals"])
    assert {r["id"] for r in a.collect()} == {"a", "b"}
    assert [(r["left_id"], r["right_id"]) for r in M.match(a, b).collect()] == [("a", "r")]


def test_empty(spark):
    none = M.profiles(spark.createDataFrame([], COLUMNS), "who", "name", "match", ["minutes"], ["goals"])
    assert M.match(none, none).count() == 0


def test_folding(spark):
    row = spark.createDataFrame([("  O'Brïen-Šeimłek ß.", "")], "n string, e string").select(M.name_words("n").alias("w"), M.name_words("e").alias("e"), M.letter_pairs(M.name_words("e")).alias("p")).first()
    assert row["w"] == ["o", "brien", "seimlek", "s"] and row["e"] == [] and row["p"] == []


def test_blocking_finds_nearly_all_true_pairs(spark):
    left, right, _ = sources(64, 9)
    a = M.profiles(spark.createDataFrame(left, COLUMNS), "who", "name", "match", ["minutes"], ["goals"])
    b = M.profiles(spark.createDataFrame(right, COLUMNS), "who", "name", "match", ["minutes"], ["goals"])
    pairs = {(r["left_id"], r["right_id"]) for r in M.candidates(a, b).collect()}
    assert sum((f"p{k}", f"x{k}") in pairs for k in range(64)) >= 63
    assert len(pairs) < 64 * 30  # and far from all


def test_a_hot_event_loses_no_pair(spark, monkeypatch):
    """Names missing or spelt quite differently in an event that all share: minutes alone bring the pairs together."""
    left = [(f"p{k}", GIVEN[k % 8], "1", k + 1, 0, 0) for k in range(40)]
    right = [(f"x{k}", None if k % 2 else "Quzzyx Zwybb", "1", k + 1, 0, 0) for k in range(40)]
    a = M.profiles(spark.createDataFrame(left, COLUMNS), "who", "name", "match", ["minutes"], [])
    b = M.profiles(spark.createDataFrame(right, COLUMNS), "who", "name", "match", ["minutes"], [])
    monkeypatch.setattr(M, "HOT_PAIRS", 100)
    assert {(r["left_id"], r["right_id"]) for r in M.match(a, b, least=0.4).collect()} == {(f"p{k}", f"x{k}") for k in range(40)}


def test_candidates_are_the_same_at_every_size(spark, monkeypatch):
    """Bands cut into many parts give the pairs of whole bands: one event for all, with equal minutes, and others."""
    r = random.Random(8)
    rows = lambda side: [(f"{side}{k}", r.choice([None, *LAST]), e, 90 if e == "hot" else r.randint(1, 9), 0, 0) for k in range(70) for e in ("hot", *(f"{r.randint(0, 9)}" for _ in range(k % 3)))]
    a, b = (M.profiles(spark.createDataFrame(rows(side), COLUMNS), "who", "name", "match", ["minutes"], []) for side in "ab")
    found = []
    for hot, part in ((10**9, 100), (50, 7)):
        monkeypatch.setattr(M, "HOT_PAIRS", hot)
        monkeypatch.setattr(M, "PART", part)
        pairs = [tuple(x) for x in M.candidates(a, b).collect()]
        assert len(pairs) == len(set(pairs))
        found.append(set(pairs))
    assert found[0] == found[1] and len(found[0]) > 500


def test_recall_and_confidence_in_a_crowd(spark, monkeypatch):
    """One event that all share, unlike spellings, and parts as small as can be: recall of candidates and of matches, Brier score."""
    left, right, hints = sources(128, 12)
    left += [(f"p{k}", f"{GIVEN[k % 8]} {LAST[k // 8 % 8]}", "crowd", 90, 0, 0) for k in range(128)]
    names = {r[0]: r[1] for r in right}
    right += [(f"x{k}", names[f"x{k}"] if k % 3 else None, "crowd", 90 - k % 2, 0, 0) for k in range(128)]
    a = M.profiles(spark.createDataFrame(left, COLUMNS), "who", "name", "match", ["minutes"], ["goals", "assists"])
    b = M.profiles(spark.createDataFrame(right, COLUMNS), "who", "name", "match", ["minutes"], ["goals"])
    hinted = spark.createDataFrame(hints, "left_id string, hinted string")
    truth = {(f"p{k}", f"x{k}") for k in range(128)}
    plain = {(r["left_id"], r["right_id"]): r["probability"] for r in M.match(a, b, hinted, least=0.0).collect()}
    monkeypatch.setattr(M, "HOT_PAIRS", 50)
    monkeypatch.setattr(M, "PART", 10)
    assert len(truth & {tuple(r) for r in M.candidates(a, b).collect()}) >= 127
    crowded = {(r["left_id"], r["right_id"]): r["probability"] for r in M.match(a, b, hinted, least=0.0).collect()}
    assert crowded.keys() == plain.keys() and all(abs(crowded[x] - plain[x]) < 1e-6 for x in plain)
    assert len(truth & plain.keys()) >= 0.99 * 128  # the best partner is the right one
    kept = {x for x, p in plain.items() if p >= 0.5}
    assert len(truth & kept) >= 0.95 * 128 and not kept - truth  # a tenth of the labels are wrong, so some confidence is low
    assert sum((p - (x in truth)) ** 2 for x, p in plain.items()) / len(plain) < 0.05


def test_dates_in_any_form(spark):
    from tessara.llm.queries import with_day

    zones = spark.createDataFrame([("uk", "Europe/London", "dmy"), ("us", "America/New_York", "mdy")], "feed string, time_zone string, date_order string")
    texts = [(1, "uk", "2025-09-03"), (2, "uk", "03/09/2025 15:00"), (3, "us", "09/03/2025 15:00"), (4, "uk", "Wed, 3 Sep 2025 15:00 BST"), (5, None, "1756908000"), (6, None, "03/09/2025"), (7, "uk", "soon"), (8, "uk", None), (9, "uk", "2025-02-30"), (10, "uk", "3 September 2025")]
    out = {r["k"]: str(r["day"]) for r in with_day(spark.createDataFrame(texts, "k int, feed string, t string"), zones, "t", False).collect()}
    assert {k for k, d in out.items() if d == "2025-09-03"} == {1, 2, 3, 4, 5, 10} and {out[k] for k in (6, 7, 8, 9)} == {"None"}
