"""Filling from similar rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessara.operators import impute

COLUMNS = "id int, kind string, a double, b double, x double, filled_x double"


def rows(n=300):
    r = random.Random(1)
    out = []
    for k in range(n):
        kind = "lo" if k % 2 else "hi"
        base = 1.0 if kind == "lo" else 9.0
        out.append((k, kind, base + r.random(), r.random(), base * 10 + r.random(), None))
    return out


def fill(frame, **more):
    return impute.fill_from_similar(frame, {"x": ((F.col("x") >= 0), "median")}, F.col("a").isNotNull(), ["a", "b"], ["kind"], "kind", k=4, **more)


def test_filled_from_the_own_cluster_and_marked(spark):
    held = [(k, kind, a, b, None if k % 10 == 0 else -1.0 if k % 10 == 5 else x, f) for k, kind, a, b, x, f in rows()]
    out = {r["id"]: r for r in fill(spark.createDataFrame(held, COLUMNS)).collect()}
    assert len(out) == 300
    for k, kind, _a, _b, x, _f in held:
        if k % 5 == 0:
            assert out[k]["method_x"] == "cluster" and abs(out[k]["filled_x"] - (10 if kind == "lo" else 90)) < 1.5
        else:
            assert out[k]["method_x"] is None and out[k]["filled_x"] == x


def test_fallbacks_unwanted_rows_and_repeats(spark):
    held = [(1, "u", 1.0, 1.0, None, 0.0), (1, "u", 1.0, 1.0, None, 0.0), (2, None, None, None, None, 0.0)] + [(10 + k, "v", 5.0, None, 7.0, None) for k in range(6)]
    out = fill(spark.createDataFrame(held, COLUMNS)).collect()
    assert sorted((r["id"], r["method_x"] or "", r["filled_x"] or 0.0) for r in out if r["id"] < 10) == [(1, "global", 7.0), (1, "global", 7.0), (2, "", 0.0)]


def test_nothing_to_fill_from_and_empty(spark):
    one = spark.createDataFrame([(1, "u", 1.0, None, None, None)], COLUMNS)
    assert [(r["method_x"], r["filled_x"]) for r in fill(one).collect()] == [("none", None)]
    assert fill(one.limit(0)).count() == 0


def test_clusters_do_not_depend_on_partitioning(spark):
    frame = spark.createDataFrame(rows(), COLUMNS)
    a = impute.fit_prototypes(frame.repartition(7), ["a", "b"], ["kind"], 4)
    b = impute.fit_prototypes(frame.coalesce(1), ["a", "b"], ["kind"], 4)
    assert len(a.centers) == 4 and [{k: round(v, 6) if isinstance(v, float) else v for k, v in c.items()} for c in a.centers] == [{k: round(v, 6) if isinstance(v, float) else v for k, v in c.items()} for c in b.centers]


def test_centers_are_those_of_plain_iteration_and_stand_still(spark):
    import numpy as np

    held = [(k, kind, a, None if k % 7 == 0 else b, x, f) for k, kind, a, b, x, f in rows(200)]
    frame = spark.createDataFrame(held, COLUMNS)
    fitted = impute.fit_prototypes(frame, ["a", "b"], ["kind"], 5)
    numbers = np.array([[np.nan if v is None else v for v in (r[2], r[3])] for r in held])
    kinds = np.array([r[1] for r in held], dtype=object)
    cost = lambda c, x, kind: sum(((v - fitted.mean[n]) / fitted.scale[n] - c[n]) ** 2 for n, v in zip("ab", x) if not np.isnan(v) and c[n] is not None) - (c["kind"] == kind)
    best, _, _, _ = fitted.nearest(numbers, [kinds])
    for row, x, kind in zip(best, numbers, kinds):
        known = [sum((-2 * (v - fitted.mean[n]) / fitted.scale[n] * c[n] + c[n] ** 2) for n, v in zip("ab", x) if not np.isnan(v)) - (c["kind"] == kind) for c in fitted.centers]
        assert known[row] <= min(known) + 1e-9
    moved, _ = impute._moved(frame.select("a", "b", "kind"), fitted)
    old = [[c[n] for n in "ab"] for c in fitted.centers]
    assert np.allclose(np.array([[c[n] for n in "ab"] for c in moved], float), np.array(old, float), atol=0.15)
    assert 1 < fitted.rounds < impute.MOST_ROUNDS and cost(fitted.centers[best[0]], numbers[0], kinds[0]) < 9
    with pytest.raises(impute.NotConverged):
        impute.fit_prototypes(frame, ["a", "b"], ["kind"], 5, rounds=1)


def test_too_many_categories_are_refused(spark, monkeypatch):
    monkeypatch.setattr(impute, "MOST_KINDS", 10)
    with pytest.raises(ValueError, match="no categories"):
        impute.fit_prototypes(spark.createDataFrame([(k, str(k), 1.0, 1.0, 1.0, None) for k in range(40)], COLUMNS), ["a"], ["kind"], 3)
