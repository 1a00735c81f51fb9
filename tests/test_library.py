"""Windows, joins, summaries, models, decisions, guards, sources, sinks, streams: small cases and properties."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessara.functions import numeric as N
from tessara.functions import text as X
from tessara.operators import decide, models, quality, relate, simulate
from tessara.operators import summarize as S
from tessara.operators import windows as W
from tessara.sources import files, sinks
from tessara.streaming import events


def some_history(spark, n=60, seed=3):
    r = random.Random(seed)
    rows = [(k % 4, k, r.choice([None, *range(90)]), r.random() < 0.5) for k in range(n)]
    return spark.createDataFrame(rows, "who int, t int, v int, f boolean")


def features(frame):
    w = W.history_of("who", "t")
    out = W.prior_streak(frame, F.col("f"), "who", ["t"], "streak")
    return out.select("who", "t", "streak", W.prior_mean(F.col("v"), w, 3).alias("m3"), W.prior_mean(F.col("v"), w).alias("all"), W.prior_sum(F.col("v"), w).alias("s"), W.prior_ratio(F.col("v"), F.col("t"), w, 5).alias("r"))


def test_features_do_not_change_when_later_rows_are_removed(spark):
    frame = some_history(spark)
    whole = {(r["who"], r["t"]): r for r in features(frame).collect()}
    for cut in (0, 7, 31):
        for r in features(frame.where(F.col("t") <= cut)).collect():
            assert r == whole[r["who"], r["t"]]
    assert all(r["m3"] is None and r["s"] == 0 and r["streak"] == 0 for k, r in whole.items() if k[1] < 4)


def test_forward_mean_and_nested_rows(spark):
    frame = spark.createDataFrame([("a", k, k) for k in range(7)], "g string, t int, v int")
    out = {r["t"]: r["m"] for r in frame.select("t", W.forward_mean(F.col("v"), W.history_of("g", "t"), 5).alias("m")).collect()}
    assert out[0] == 2.0 and out[6] == 6.0
    nested = W.nested_top_n(frame, ["g"], [F.col("v").desc()], 3, ["t", "v"], "x").first()
    assert [tuple(x) for x in nested["x"]] == [(6, 6), (5, 5), (4, 4)]


def test_top_k_below_equals_a_plain_search(spark):
    r = random.Random(5)
    offers = [(k, r.choice("ab"), r.randint(0, 400) * 7, r.randint(0, 9)) for k in range(300)]
    asked = [(k, r.choice("abc"), r.randint(-50, 3500)) for k in range(60)]
    out = relate.top_k_below(spark.createDataFrame(asked, "q int, g string, top int"), spark.createDataFrame(offers, "item int, g string, price int, value int"), "g", "top", "price", "value", "item", 3, 100).collect()
    assert len(out) == 60
    for row in out:
        best = sorted(((-v, p, k) for k, g, p, v in offers if g == row["g"] and p <= row["top"]))[:3]
        assert [(-x["value"], x["price"], x["item"]) for x in row["best"]] == best


def test_staged_reconcile_and_snapshots(spark):
    left = spark.createDataFrame([(1, "a", "X"), (2, "b", "X"), (3, "b", "Z"), (4, None, "X"), (5, "q", "X")], "l int, name string, team string")
    right = spark.createDataFrame([(10, "a", "Y"), (20, "b", "X"), (21, "b", "Y")], "r int, name string, team string")
    assert sorted(tuple(x) for x in relate.staged_reconcile(left, right, "l", "r", [["name"], ["name", "team"]]).collect()) == [(1, 10, 1), (2, 20, 2)]
    old = spark.createDataFrame([(1, "u", 5), (2, "u", 6)], "k int, a string, b int")
    new = spark.createDataFrame([(2, "v", 6), (3, None, 7)], "k int, a string, b int")
    assert sorted([tuple(x) for x in relate.snapshot_diff(old, new, "k", ["a", "b"]).collect()], key=str) == [(1, "gone", "", None, None), (2, "changed", "a", "u", "v"), (3, "new", "", None, None)]


def test_find_one(spark):
    frame = spark.createDataFrame([("Ångø Bo", 1), ("Ango Cy", 2), ("Bo", 3), (None, 4)], "n string, k int")
    assert [r["k"] for r in relate.find_one(frame, "n", "bo", X.simple_name).collect()] == [3]
    assert [r["k"] for r in relate.find_one(frame, "n", "cy", X.simple_name).collect()] == [2]
    for asked in ("ang", "zz"):
        with pytest.raises(LookupError):
            relate.find_one(frame, "n", asked, X.simple_name)


def test_mirror_keeps_a_lone_side(spark):
    frame = spark.createDataFrame([(1, True, 5), (1, False, 2), (2, True, 7)], "f int, home boolean, v int")
    assert sorted((r["f"], r["v"], r["opp_v"]) for r in relate.mirror(frame, ["f"], "home", ["v"]).where("f = 1").collect()) == [(1, 2, 5), (1, 5, 2)]
    assert relate.mirror(frame, ["f"], "home", ["v"]).where("f = 2").first()["opp_v"] is None


def test_average_ranks_and_bins(spark):
    values = [3.0, 1.0, 3.0, None, 7.0, 3.0]
    out = S.average_ranks(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double"), "v", "r").orderBy("k").collect()
    assert [x["r"] for x in out] == [3.0, 1.0, 3.0, None, 5.0, 3.0]
    bins = S.fixed_bins(spark.createDataFrame([(0.05, 0), (0.95, 1), (1.0, 1)], "p double, y int"), "p", "y").orderBy("bin").collect()
    assert [(b["bin"], b["n"]) for b in bins] == [(0, 1), (9, 1)]
    buckets = S.quantile_buckets(spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3)], "v double"), "v", 3, "b")
    assert sorted((r["v"], r["b"]) for r in buckets.collect()) == [(1.0, 0)] * 4 + [(2.0, 1), (3.0, 1)]


def test_text_and_numbers(spark):
    one = spark.createDataFrame([("  Ångström   O'Brïen ", "a, ,b", "Possession 12 of 15", None)], "n string, l string, s string, z string")
    row = one.select(X.simple_name(F.col("n")).alias("a"), X.strict_name(F.col("n"), {"angstrom": "anders"}).alias("b"), X.parts(F.col("l")).alias("c"), X.number_after(F.col("s"), r"(\d+) of (\d+)", 2).alias("d"), X.number_after(F.col("z"), r"(\d+)").alias("e"), X.simple_name(F.col("z")).alias("f"), X.contains_word(F.col("z"), "x").alias("g"), X.token_sort_ratio(F.lit("b a"), F.lit("A B")).alias("h")).first()
    assert tuple(row) == ("angstrom o'brien", "anders obrien", ["a", "b"], 15.0, None, "", False, 100.0)
    rate = 1.37
    exact = sum(math.exp(-rate) * rate**k / math.factorial(k) * (k // 2) for k in range(60))
    got = one.select(N.expected_halves(F.lit(rate)).alias("a"), N.platt(F.lit(0.3), 1.0, 0.0).alias("b"), N.either(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.5)).alias("c"), N.gap_label(F.lit(-9), 8, 20).alias("d"), N.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("e")).first()
    assert abs(got["a"] - exact) < 1e-12 and abs(got["b"] - 0.3) < 1e-9 and got["c"] == 0.75 and got["d"] == "DISAGREE" and got["e"] == 0.0


def test_adapters_and_labels(spark):
    from tessara.sources import tables

    frame = spark.createDataFrame([("7.25", "DEF", 10, 1.23456)], "selected string, pos string, n int, x double")
    assert tables.adapt(frame, [{"none": "a"}, {"pos": "position"}]).columns == ["selected", "position", "n", "x"]
    with pytest.raises(ValueError, match="no known convention"):
        tables.adapt(frame, [{"none": "a"}])
    assert tables.rounded(frame, 2).first()["x"] == 1.23 and tables.present(frame, ["n", "zz", "pos"]) == ["n", "pos"]
    row = frame.select(N.number_or(F.col("selected")).alias("a"), N.number_or(F.col("pos"), 1.5).alias("b"), N.reaches(F.col("n"), F.col("pos"), {"DEF": 10, "MID": 12}).alias("c"), N.reaches(F.col("n"), F.lit("GK"), {"DEF": 10}).alias("d"), X.feature_family(F.lit("opp_team_roll5_shots")).alias("e"), X.feature_family(F.lit("season_tackles"), {"tackles": "defending"}).alias("f")).first()
    assert tuple(row) == (7.25, 1.5, 1, None, "shots", "defending")


def irls(x, y, w, rounds=50):
    """Poisson regression with frequency weights, by iteratively reweighted least squares."""
    b = np.zeros(x.shape[1])
    b[-1] = math.log(max(np.average(y, weights=w), 1e-6))
    for _ in range(rounds):
        m = np.exp(x @ b)
        b = b + np.linalg.solve(x.T @ ((w * m)[:, None] * x), x.T @ (w * (y - m)))
    return b


def test_poisson_fit_equals_plain_iteration(spark):
    g = np.random.default_rng(4)
    x = np.column_stack([g.normal(size=400), g.integers(0, 2, 400), np.ones(400)])
    y, w = g.poisson(np.exp(x @ [0.4, -0.3, 0.2])), g.integers(1, 4, 400)
    frame = spark.createDataFrame([(float(a), float(b), int(c), int(d)) for (a, b, _), c, d in zip(x, y, w)], "a double, b double, y int, w int")
    model = models.fit_glm(frame, "y", ["a", "b"], "poisson", "w")
    expected = irls(x, y, w)
    assert np.allclose([model.weights["a"], model.weights["b"], model.intercept], expected, atol=1e-5)
    total = frame.select(F.sum(F.col("w") * (F.col("y") - model.score()))).first()[0]
    assert abs(total) < 1e-2  # predictions balance the counts
    parts = model.contributions({"a": 0.0, "b": 0.0})
    assert set(parts) == {"a", "b"}


def test_segments_pruning_and_isotonic(spark):
    g = np.random.default_rng(1)
    rows = [(("p", "q")[k % 2], float(v), float(v) * 2, 0.0, int(k % 3 == 0)) for k, v in enumerate(g.normal(size=200))] + [("r", 1.0, 2.0, 0.0, 1)]
    frame = spark.createDataFrame(rows, "s string, a double, twice double, flat double, y int")
    assert models.varying(frame, ["a", "flat"]) == ["a"] and models.prune_correlated(frame, ["a", "twice"], 0.98) == ["a"]
    fitted = models.fit_segments(frame, "s", ["p", "q", "r"], "y", ["a", "flat"])
    assert set(fitted) == {"p", "q"}  # r has too few rows
    assert frame.select(models.score_segments(fitted, "s").alias("x")).where("x is null").count() == 0
    assert models.family_best(frame, ["a", "twice"], "y", {"a": "f", "twice": "f"}, 10) in (["a"], ["twice"])
    curve = models.apply_isotonic(F.col("p"), [0.2, 0.6], [0.1, 0.5])
    got = [r["x"] for r in spark.createDataFrame([(0.0,), (0.2,), (0.4,), (0.9,)], "p double").select(curve.alias("x")).collect()]
    assert np.allclose(got, [0.1, 0.1, 0.3, 0.5])


def test_simulation_meets_analytic_means_and_ignores_partitioning(spark):
    frame = spark.createDataFrame([(1, 1.5, 0.7), (2, None, 1.0), (3, 2.0, None)], "k int, rate double, here double")
    draw = lambda f: {r["k"]: r for r in simulate.totals(f, ["k"], [simulate.Part("rate", 4.0)], "here").collect()}
    out = draw(frame)
    assert abs(out[1]["sim_mean"] - 4 * 1.5 * 0.7) < 0.25 and out[2]["sim_mean"] == 0 and out[3]["sim_p90"] == 0
    assert out == draw(frame.repartition(3))


def test_a_double_round_adds_independent_draws(spark):
    """Two matches of one key: mean and variance are sums; gates, chances and steps have their analytic means."""
    parts = [simulate.Part("rate", 2.0), simulate.Part("p", 3.0, "chance", "full"), simulate.Part("", 1.0, "sure"), simulate.Part("lost", -1.0, "count", "", 2)]
    rows = [("a", m, 1.2, 0.3, 2.5, 0.8, 0.5) for m in range(2)] + [("b", 0, 1.2, 0.3, 2.5, 0.8, 0.5), ("c", 9, 0.0, 0.0, 60.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "k string, m int, rate double, p double, lost double, here double, full double")
    out = {r["k"]: r for r in simulate.totals(frame, ["k"], parts, "here", "full", ["m"], draws=40000).collect()}
    halves = sum(math.exp(-2.5) * 2.5**k / math.factorial(k) * (k // 2) for k in range(60))
    mean = 0.8 * (2 * 1.2 + 1) + 0.5 * 3 * 0.3 - halves
    assert out["a"]["n_rows"] == 2 and abs(out["b"]["sim_mean"] - mean) < 0.06 and abs(out["a"]["sim_mean"] - 2 * mean) < 0.08
    assert abs(out["a"]["sim_std"] ** 2 - 2 * out["b"]["sim_std"] ** 2) < 0.06 * out["a"]["sim_std"] ** 2
    assert abs(out["c"]["sim_mean"] - (1 - 29.75)) < 0.2
    again = {r["k"]: r for r in simulate.totals(frame.repartition(5), ["k"], parts, "here", "full", ["m"], draws=40000).collect()}
    assert all(abs(out[k]["sim_mean"] - again[k]["sim_mean"]) < 1e-9 for k in out)


def test_a_starting_eleven_equals_exhaustive_search():
    r = random.Random(2)
    for _ in range(20):
        squad = [decide.Item(k, "abc"[k % 3], "x", 1, round(r.random() * 9, 1)) for k in range(9)]
        least, most = {"a": 1, "b": 2, "c": 0}, {"a": 2, "b": 3, "c": 2}
        best = max(sum(x.value for x in c) for c in itertools.combinations(squad, 5) if all(least[g] <= sum(x.group == g for x in c) <= most[g] for g in least))
        assert abs(sum(x.value for x in decide.starting(squad, least, most, 5)) - best) < 1e-9
    assert decide.starting(squad[:3], least, most, 5) == []


def test_logistic_falls_back_where_classes_are_separated(spark):
    frame = spark.createDataFrame([(float(k), int(k >= 20), k % 2) for k in range(40)], "x double, y int, z int")
    model, converged = models.fit_logistic(frame, "y", ["x"], alpha=0.01)
    assert not converged and model.weights["x"] > 0
    assert models.fit_logistic(frame, "z", ["x"])[1]
    ends = models.probe(models.fit_ols(frame, "x", ["y"]), frame)
    assert abs(ends["best"] - 29.5) < 1e-6 and abs(ends["worst"] - 9.5) < 1e-6


def test_isotonic_uses_all_rows_with_weights(spark):
    rows = [(0.1, 0, 9.0), (0.1, 1, 1.0), (0.5, 1, 1.0), (0.5, 0, 1.0), (0.9, 1, 1.0)]
    boundaries, values = models.fit_isotonic(spark.createDataFrame(rows, "p double, y int, w double"), "p", "y", "w")
    assert dict(zip(boundaries, values)) == {0.1: 0.1, 0.5: 0.5, 0.9: 1.0}


def test_exact_quantiles_with_outliers_and_groups(spark):
    r = random.Random(3)
    rows = [(g, r.choice([None, 1e12, -1e12, *range(20)])) for g in ("a", "b", None) for _ in range(101)] + [("none", None)]
    rows = [(g, None if v is None else float(v)) for g, v in rows]
    out = {x["g"]: x["q"] for x in S.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g in ("a", "b", None):
        assert np.allclose(out[g], np.quantile([v for h, v in rows if h == g and v is not None], [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert "none" not in out


def test_corrupt_records_are_found(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n{bad json\nnot json\n{"a": "zz"}\n\n{"a": null}\n')
    assert sorted(r["raw"] for r in files.corrupt_records(spark, str(tmp_path / "lines.json"), "a INT").collect()) == ["", "not json", '{"a": "zz"}', "{bad json"]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "good.json").write_text('{"a": 1, "b": [{"c": 2}]}')
    (docs / "bad.json").write_text('{"a": 1, "b": ')
    assert [r["a"] for r in files.read_nested_json(spark, str(docs), "a int, b array<struct<c:int>>").collect()] == [1]
    assert [r["file"] for r in files.corrupt_documents(spark, str(docs), "a int, b array<struct<c:int>>").collect()] == ["bad.json"]


def test_checkpoint_folder_on_a_cluster(monkeypatch):
    from tessara import session

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError, match="share"):
        session.checkpoint_dir(type("S", (), {"sparkContext": Context})())


def test_mirror_with_null_keys_and_repeated_sides(spark):
    frame = spark.createDataFrame([(None, True, 1), (None, False, 2), (1, True, 5), (1, False, 3), (1, False, 2), (2, None, 7), (2, True, 8)], "f int, home boolean, v int")
    got = sorted(((r["f"], r["home"], r["v"], r["opp_v"]) for r in relate.mirror(frame, ["f"], "home", ["v"]).collect()), key=str)
    assert got == sorted([(None, True, 1, None), (None, False, 2, None), (1, True, 5, 2), (1, False, 3, 5), (1, False, 2, 5), (2, None, 7, None), (2, True, 8, None)], key=str)


def test_reports(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0.5, None), (2, 1.25, "x")], "run int, mae double, note string")
    assert sinks.text_report(frame, "Errors") == "Errors\nrun  mae    note\n1    0.500  -\n2    1.250  x\n"
    path = str(tmp_path / "history")
    sinks.report_run(spark.createDataFrame([(1, 2.0)], "run int, mae double"), path, "run", ["mae"], "Runs")
    assert sinks.report_run(spark.createDataFrame([(1, 9.0), (2, 2.5)], "run int, mae double"), path, "run", ["mae"], "Runs").splitlines()[2:] == ["1    2.000  -", "2    2.500  0.500"]


def test_best_squad_never_returns_an_unproven_choice(spark):
    items = [decide.Item(k, "g", f"t{k}", k % 7 + 1, float(k * 5 % 11)) for k in range(30)]
    with pytest.raises(RuntimeError):
        decide.best_squad(items, {"g": 5}, 12, 2, limit=3)
    assert len(decide.best_squad(items, {"g": 5}, 12, 2)) == 5


def test_best_squad_equals_exhaustive_search(spark):
    r = random.Random(8)
    for trial in range(6):
        items = [decide.Item(k, "ab"[k % 2], "xyz"[r.randrange(3)], r.randint(3, 12), round(r.random() * 10, 2)) for k in range(12)]
        quota, budget = {"a": 2, "b": 3}, 35
        best = max((sum(x.value for x in c) for c in itertools.combinations(items, 5) if sum(x.price for x in c) <= budget and all(sum(x.group == g for x in c) == n for g, n in quota.items()) and all(sum(x.team == t for x in c) <= 2 for t in "xyz")), default=None)
        got = decide.best_squad(items, quota, budget, 2)
        assert (best is None and got == []) or abs(sum(x.value for x in got) - best) < 1e-9, trial
        frame = spark.createDataFrame([(x.key, x.group, x.team, x.price, x.value) for x in items], "k int, g string, t string, p int, v double")
        pruned = decide.best_squad(decide.undominated(frame, "k", "g", "t", "p", "v", quota, 2), quota, budget, 2)
        assert best is None or abs(sum(x.value for x in pruned) - best) < 1e-9


def test_swaps_and_captains(spark):
    a, b, c = decide.Item(1, "m", "x", 5, 1.0), decide.Item(2, "m", "y", 6, 9.0), decide.Item(3, "m", "z", 50, 99.0)
    scores = {t: {1: 1.0, 2: 3.0, 3: 9.0} for t in range(1, 6)}
    assert decide.plan_swaps([1, 2], [a], {1: [b, c], 2: [b, c]}, scores, 1, 3) == [(1, 1, 2, 6.0)]
    pool = spark.createDataFrame([("g", 1, 5.0, 1.0), ("g", 2, 5.0, 9.0), ("g", 3, 4.0, 9.0), ("h", 4, 1.0, 1.0)], "g string, k int, v double, c double")
    assert sorted([tuple(x) for x in decide.captains(pool, "g", "k", "v", "c").collect()], key=str) == [("g", 1, 2, 2), ("h", 4, None, 4)]


def test_guards(spark):
    frame = spark.createDataFrame([(1, 1, None), (1, 1, 2), (2, 1, 3)], "k int, g int, y int")
    with pytest.raises(quality.ContractError):
        quality.unique_key(frame, ["k"])
    with pytest.raises(quality.ContractError):
        quality.same_rows(frame, frame.limit(2))
    with pytest.raises(quality.ContractError):
        quality.required(frame, ["none"])
    assert tuple(quality.contract(frame, ["k"], ["g"], 2, "y").first()) == (1, 1, 1)
    assert quality.drift({"mae": 1.3, "bias": 0.0}, {"mae": 1.0, "bias": 0.2}, {"mae": 0.15}, {"bias": 0.1}) == ["mae", "bias"]
    assert quality.drift({"mae": None}, {"mae": 1.0}, {"mae": 0.15}, {}) == ["mae"]
    assert [x[1] for x in quality.steps([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 2)])] == [True, False, True]
    runs = spark.createDataFrame([(1, 1.0), (2, 1.5)], "run int, mae double")
    assert [r["mae_change"] for r in quality.run_over_run(runs, "run", ["mae"]).orderBy("run").collect()] == [None, 0.5]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2.5\n2,NaN\n3,\n")
    assert [r["v"] for r in files.read_csv(spark, str(tmp_path / "a.csv"), "k int, v double").orderBy("k").collect()] == [2.5, None, None]
    (tmp_path / "p.json").write_text(json.dumps({"id": 7, "history": [{"m": 90}, {"m": 12}]}))
    assert [tuple(r) for r in files.read_nested_json(spark, str(tmp_path / "p.json"), "id int, history array<struct<m:int>>", "history", "h_").collect()] == [(7, 90), (7, 12)]
    nested = spark.createDataFrame([((1, (2,)),)], "a struct<b:int,c:struct<d:int>>")
    assert files.flatten(nested).columns == ["a_b", "a_c_d"]
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "match_1.html").write_text("<b>53%</b><i class='card'></i><i class='card'></i>\n<b>x</b>")
    (pages / "other.txt").write_text("no page")
    assert [tuple(r) for r in files.read_pages(spark, str(pages), "match_*.html", {"possession": r"(\d+)%"}, {"cards": "class='card'"}).collect()] == [("match_1", 53.0, 2)]
    (tmp_path / "team.txt").write_text("Gaseth\n\n  Loim \n")
    assert [r["name"] for r in files.read_list(spark, str(tmp_path / "team.txt")).collect()] == ["Gaseth", "Loim"]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "run_1.log").write_text("MAE: 1.5\nMAE: 1.2\n")
    (logs / "run_2.log").write_text("failed\n")
    read = files.read_log(spark, str(logs), {"mae": r"MAE: ([0-9.]+)"})
    assert sorted([(r["file"], r["mae"]) for r in read.collect()]) == [("run_1.log", 1.2), ("run_2.log", None)]
    assert [r["file"] for r in files.latest_file(read).collect()] == ["run_2.log"]
    old = spark.createDataFrame([(1,)], "k int")
    assert [r["k"] for r in files.unseen(spark.createDataFrame([(1,), (2,)], "k int"), old, "k").collect()] == [2]


def test_sinks_keep_good_data(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.guarded_overwrite(frame, path) == 2
    with pytest.raises(sinks.EmptyResult):
        sinks.guarded_overwrite(frame.limit(0), path)
    assert spark.read.parquet(path).count() == 2
    assert sinks.append_first_wins(spark.createDataFrame([(2, "late"), (3, "c")], "k int, v string"), path, ["k"], ["v"]) == 3
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    sinks.write_state(str(tmp_path / "s.json"), {"last": 3})
    assert files.read_state(str(tmp_path / "s.json"), {}) == {"last": 3} and files.read_state(str(tmp_path / "none.json"), {"last": 0}) == {"last": 0}
    assert sinks.report_page(frame, "<x>__DATA__</x>") == '<x>[{"k":1,"v":"a"},{"k":2,"v":"b"}]</x>'
    with pytest.raises(ValueError, match="at most"):
        sinks.report_page(frame, "__DATA__", most=1)
    flagged = W.duplicate_flags(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, t int"), ["k"], [F.col("t").asc()])
    assert sinks.split_duplicates(flagged, str(tmp_path / "dup")).count() == 2 and spark.read.parquet(str(tmp_path / "dup")).count() == 1


def test_high_water_mark(spark):
    rounds = spark.createDataFrame([(1, True, True), (2, True, False), (3, True, True), (4, True, True)], "id int, finished boolean, data_checked boolean")
    assert events.newly_completed(rounds, 1) == 3 and events.newly_completed(rounds, 4) is None


def test_stream_state_over_several_batches(spark, tmp_path):
    folder = tmp_path / "events"
    for k in range(3):
        rows = [(10 * k + j, f"2024-01-0{k + 1} 00:00:0{j}", j % 2, "view", float(10 * k + j), "{}") for j in range(4)]
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(folder))
    stream = events.event_stream(spark, str(folder), per_trigger=1)
    out = events.run_available(events.last_values(stream, 3), "update", str(tmp_path / "w"))
    last = {r["user_id"]: r["x"] for r in out.groupBy("user_id").agg(F.max_by("mean_last", "batch").alias("x")).collect()}
    assert last == {0: (12 + 20 + 22) / 3, 1: (13 + 21 + 23) / 3}
