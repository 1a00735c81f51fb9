"""Model, simulation, decision and streaming queries. Those with a closed form have SQL; the rest are tested otherwise."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessara.functions import numeric as N
from tessara.operators import decide, models, simulate
from tessara.operators import summarize as S
from tessara.operators import windows as W
from tessara.plans.forms import cents
from tessara.session import checkpoint_dir
from tessara.sources.tables import table
from tessara.streaming import events as stream


def _lines(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem", "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    return rows.select(
        F.col("l_quantity").cast("bigint").alias("quantity"), "l_returnflag", "l_linestatus", (F.col("l_linestatus") == "O").cast("int").alias("is_open"),
        *[(F.col("l_returnflag") == x).cast("int").alias(f"flag_{x.lower()}") for x in ("N", "R")], (F.col("l_quantity") > 25).cast("int").alias("large"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("discount"), F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
    )


def glm_poisson_saturated(spark: SparkSession, root: str) -> DataFrame:
    """Poisson model of quantity on the return flag in each status: saturated, so predictions are the group means."""
    lines = _lines(spark, root)
    fitted = models.fit_segments(lines, "l_linestatus", ["F", "O"], "quantity", ["flag_n", "flag_r"])
    scored = lines.select("l_linestatus", "l_returnflag", models.score_segments(fitted, "l_linestatus").alias("p"))
    return scored.groupBy("l_linestatus", "l_returnflag").agg(F.round(F.max("p"), 5).alias("predicted"), F.count("*").alias("n"))


def logit_saturated(spark: SparkSession, root: str) -> DataFrame:
    """Logistic model of large lines on the return flag, weighted by discount + 1: predictions are weighted rates."""
    lines = _lines(spark, root).withColumn("weight", F.col("discount") + 1)
    fitted = models.fit_glm(lines, "large", ["flag_n", "flag_r"], "binomial", "weight")
    return lines.select("l_returnflag", fitted.score().alias("p")).groupBy("l_returnflag").agg(F.round(F.max("p"), 6).alias("predicted"))


def ols(spark: SparkSession, root: str) -> DataFrame:
    """Slope and intercept of price on quantity."""
    lines = table(spark, root, "lineitem", "l_quantity", "l_extendedprice")
    fitted = models.fit_ols(lines, "l_extendedprice", ["l_quantity"])
    return lines.agg(F.count("*").alias("n")).select("n", F.round(F.lit(fitted.weights["l_quantity"]), 3).alias("slope"), F.round(F.lit(fitted.intercept), 1).alias("intercept"))


FEATURES = ["roll5_minutes", "season_minutes", "roll5_goals", "roll5_bps", "consecutive_starts", "was_home_int"]


def _facts(spark: SparkSession, root: str) -> DataFrame:
    """Matches with leak-free features and outcomes."""
    from tessara.plans.forms import player_features

    days = table(spark, root, "model_ready_dataset", "player_id", "fixture_id", "gameweek", "position", "was_home_int")
    reports = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "fixture_id", "minutes", "goals", "ingested_at")
    last = W.latest_rows(reports, ["player_id", "fixture_id"], ["ingested_at", "row_id"]).select("player_id", "fixture_id", "minutes", "goals")
    both = player_features(spark, root).join(days, ["player_id", "fixture_id"]).join(last, ["player_id", "fixture_id"])
    return both.where("roll5_minutes is not null").select("player_id", "fixture_id", "gameweek", "position", *FEATURES, "minutes", "goals", (F.col("minutes") >= 60).cast("int").alias("full"), (F.col("minutes") > 0).cast("int").alias("any"))


def _split(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train up to the third quartile of gameweeks, test after it; read twice, so cut from its sources."""
    checkpoint_dir(facts.sparkSession)
    kept = facts.checkpoint()
    cut = S.quantile_edges(kept, "gameweek", [0.75])[0]
    return kept.where(F.col("gameweek") <= cut), kept.where(F.col("gameweek") > cut)


POSITIONS = ["GK", "DEF", "MID", "FWD"]
#: Sizes of the tree models. A boosted model's rounds are one after the other, a job or more each: 50 long steps go as far
#: towards the fit (1 - 0.8 ** 50) as 300 of 0.05.
TREES, FOREST_DEPTH, ROUNDS, STEP, BOOSTED_DEPTH = 300, 5, 50, 0.2, 4


def versions(result: DataFrame, against: str, most: float = 1.05) -> DataFrame:
    """(version, n, is_sound) of a tournament: whether a version's held-out Brier score is at most so many times another's."""
    base = result.where(F.col("version") == against).select(F.col("brier").alias("__base"))
    return result.join(F.broadcast(base)).select("version", "n", (F.col("brier") <= F.col("__base") * most).cast("int").alias("is_sound"))  # one row


def minutes_bins(spark: SparkSession, root: str) -> DataFrame:
    """Chance to play an hour on held-out gameweeks: calibration bins of the Platt-scaled logistic model."""
    train, test = _split(_facts(spark, root))
    features = models.prune_correlated(train, models.varying(train, FEATURES), 0.98)
    model, _ = models.fit_logistic(train, "full", features)
    a, b = models.fit_platt(train.withColumn("p", model.score()), "p", "full")
    return S.fixed_bins(test.withColumn("p", N.platt(model.score(), a, b)), "p", "full")


def minutes_model(spark: SparkSession, root: str) -> DataFrame:
    """One row: held-out matches in the model's bins, and whether predicted and actual shares are within five percent of all."""
    bins = minutes_bins(spark, root)
    gap = F.abs(F.sum(F.col("n") * (F.col("mean_predicted") - F.col("mean_actual")))) / F.sum("n")
    return bins.agg(F.sum("n").alias("n"), (gap < 0.05).cast("int").alias("is_calibrated"), F.min((F.col("mean_actual").between(0, 1) & F.col("mean_predicted").between(0, 1)).cast("int")).alias("in_range"))


def forecasts(spark: SparkSession, root: str, trees: int = TREES, rounds: int = ROUNDS, step: float = STEP) -> DataFrame:
    """Goals by position: Poisson, forest and boosted versions against the train mean, on held-out gameweeks."""
    train, test = _split(_facts(spark, root))
    poisson = models.fit_segments(train, "position", POSITIONS, "goals", FEATURES)
    mean = float(train.agg(F.avg("goals")).first()[0] or 0.0)
    forest, assembler = models.fit_trees(train, "goals", FEATURES, trees=trees, depth=FOREST_DEPTH)
    boosted, other = models.fit_trees(train, "goals", FEATURES, kind="boosted", trees=rounds, depth=BOOSTED_DEPTH, step=step)
    scored = models.score_trees(boosted, other, models.score_trees(forest, assembler, test, "forest"), "boosted")
    return models.tournament(scored, "goals", {"poisson": models.score_segments(poisson, "position"), "forest": F.col("forest"), "boosted": F.col("boosted"), "mean": F.lit(mean)})


def forecast_tournament(spark: SparkSession, root: str) -> DataFrame:
    """The versions' places are in ``forecasts``; deep trees may do worse than the mean on few matches, but not twice as badly."""
    return versions(forecasts(spark, root), "mean", 2.0)


def calibrations(spark: SparkSession, root: str) -> DataFrame:
    """Brier scores of the raw, Platt-scaled, isotonic and cross-calibrated chance to play at all, all fitted on train, held out."""
    train, test = _split(_facts(spark, root))
    features = models.varying(train, FEATURES)
    model, _ = models.fit_logistic(train, "any", features)
    scored = train.withColumn("p", model.score())
    a, b = models.fit_platt(scored, "p", "any")
    boundaries, values = models.fit_isotonic(scored, "p", "any")
    folds = models.fit_cross_calibrated(train, ["player_id", "fixture_id"], "any", features)
    p = model.score()
    return models.tournament(test, "any", {"raw": p, "platt": N.platt(p, a, b), "isotonic": models.apply_isotonic(p, boundaries, values), "folds": models.score_cross_calibrated(folds)})


def calibrators(spark: SparkSession, root: str) -> DataFrame:
    return versions(calibrations(spark, root), "raw")


def coefficient_rows(spark: SparkSession, root: str) -> DataFrame:
    """Coefficients of a Poisson model of minutes for each position, with their signs against those expected."""
    train, _ = _split(_facts(spark, root))
    rows = models.coefficient_table(train, models.fit_segments(train, "position", POSITIONS, "minutes", FEATURES))
    expected = F.when(F.col("feature").isin("roll5_minutes", "season_minutes", "consecutive_starts"), 1).otherwise(0)
    return rows.withColumn("sign", F.when(expected != 0, models.sign_label(F.col("coefficient"), expected)))


def coefficients(spark: SparkSession, root: str) -> DataFrame:
    """(position, n, is_balanced): whether a position's predictions add up to its outcomes, as those of a Poisson fit must."""
    train, _ = _split(_facts(spark, root))
    fitted = models.fit_segments(train, "position", POSITIONS, "minutes", FEATURES)
    scored = train.where(F.col("position").isin(list(fitted))).withColumn("__p", models.score_segments(fitted, "position"))
    return scored.groupBy("position").agg(F.count("*").alias("n"), (F.abs(F.sum("__p") / F.sum("minutes") - 1) < 1e-3).cast("int").alias("is_balanced"))


def logistic_fallback(spark: SparkSession, root: str) -> DataFrame:
    """A fit that converges, and one of separated classes, which falls back to a penalty; what either predicts in each class.

    The first is saturated, so that its predictions are the classes' rates; the second's only have to be on the right side.
    """
    lines = _lines(spark, root)
    plain, converged = models.fit_logistic(lines, "large", ["flag_n", "flag_r"])
    split, ran_away = models.fit_logistic(lines, "large", ["large"], alpha=0.01)
    scored = lines.select("l_returnflag", "large", plain.score().alias("p"), split.score().alias("q"))
    right = F.min(((F.col("q") > 0.5) == (F.col("large") == 1)).cast("int"))
    return scored.groupBy("l_returnflag").agg(F.round(F.max("p"), 6).alias("predicted"), F.lit(int(converged)).alias("converged"), F.lit(int(ran_away)).alias("second_converged"), right.alias("second_right"))


def kept_features(spark: SparkSession, root: str) -> DataFrame:
    """Features left after those without variance, those that repeat an earlier one, and all but the best of a family."""
    lines = _lines(spark, root).withColumns({"twice": F.col("quantity") * 2, "flat": F.lit(1), "noise": F.col("tax")})
    varied = models.varying(lines, ["quantity", "twice", "flat", "discount", "noise"])
    pruned = models.prune_correlated(lines, varied, 0.98)
    best = models.family_best(lines, pruned, "large", {"quantity": "size", "discount": "rate", "noise": "rate"}, 1000)
    return spark.createDataFrame([(f, int(f in varied), int(f in pruned), int(f in best)) for f in ("quantity", "twice", "flat")], "feature string, varies int, is_own int, is_best int")


def extreme_probe(spark: SparkSession, root: str) -> DataFrame:
    """The prediction of price at the most and the least favourable quantity there is."""
    lines = table(spark, root, "lineitem", "l_quantity", "l_extendedprice")
    ends = models.probe(models.fit_ols(lines, "l_extendedprice", ["l_quantity"]), lines)
    return lines.agg(F.count("*").alias("n")).select("n", F.round(F.lit(ends["best"]), 1).alias("best"), F.round(F.lit(ends["worst"]), 1).alias("worst"))


def simulated_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Ranges of every fixture's total of goals from the clubs' rates before it: 5,000 draws a row."""
    drawn = fixture_ranges(spark, root)
    mean = F.coalesce(F.col("home"), F.lit(0.0)) + F.coalesce(F.col("away"), F.lit(0.0))
    near = (F.abs(F.col("sim_mean") - mean) <= 6 * F.sqrt(mean / 5000) + 1e-9) & (F.abs(F.col("sim_std") - F.sqrt(mean)) <= 0.1 * F.sqrt(mean) + 1e-9)
    return drawn.select("fixture_id", near.cast("int").alias("is_near"), ((F.col("sim_p10") <= F.col("sim_p50")) & (F.col("sim_p50") <= F.col("sim_p90"))).cast("int").alias("is_ordered"))


def fixture_ranges(spark: SparkSession, root: str) -> DataFrame:
    from tessara.plans.relations import side_log

    sides = side_log(spark, root)
    days = table(spark, root, "model_ready_dataset", "fixture_id", "gameweek").groupBy("fixture_id").agg(F.max("gameweek").alias("gameweek"))
    w = W.history_of("club", "gameweek", "fixture_id", "was_home_int")
    rated = sides.join(days, "fixture_id").withColumn("rate", F.coalesce(W.prior_mean(F.col("goals"), w, 10), F.lit(1.3)))
    both = rated.groupBy("fixture_id").agg(F.max(F.when(F.col("was_home_int") == 1, F.col("rate"))).alias("home"), F.max(F.when(F.col("was_home_int") == 0, F.col("rate"))).alias("away"))
    drawn = simulate.totals(both.withColumn("played", F.lit(1.0)), ["fixture_id"], [simulate.Part("home", 1.0), simulate.Part("away", 1.0)], "played", row=[])
    return drawn.join(both, "fixture_id")


def two_rate_scores(spark: SparkSession, root: str) -> DataFrame:
    """Chance of conceding nothing, held out: from the opponent's goal rate against a direct model and the train mean.

    The rate model knows a side's goals before and what its opponent conceded before; the opponent's rate comes to a
    side by the mirror of the fixture.
    """
    from tessara.operators import relate
    from tessara.plans.relations import side_log

    days = table(spark, root, "model_ready_dataset", "fixture_id", "gameweek").groupBy("fixture_id").agg(F.max("gameweek").alias("gameweek"))
    sides = side_log(spark, root).join(days, "fixture_id")
    w = W.history_of("club", "gameweek", "fixture_id", "was_home_int")
    formed = sides.select("fixture_id", "gameweek", "club", "was_home_int", "goals", "opp_goals", W.prior_mean(F.col("goals"), w, 10).alias("own_for"), W.prior_mean(F.col("opp_goals"), w, 10).alias("own_against"))
    rows = relate.mirror(formed, ["fixture_id"], "was_home_int", ["own_for", "own_against"]).withColumn("clean", (F.col("opp_goals") == 0).cast("int")).where("own_for is not null and opp_own_for is not null")
    train, test = _split(rows)
    rate = models.fit_glm(train, "goals", ["own_for", "opp_own_against", "was_home_int"], "poisson")
    direct = models.fit_glm(train, "clean", ["own_against", "opp_own_for", "was_home_int"], "binomial")
    both = relate.mirror(test.withColumn("rate", rate.score()), ["fixture_id"], "was_home_int", ["rate"]).where("opp_rate is not null")
    mean = float(train.agg(F.avg("clean")).first()[0] or 0.0)
    return models.tournament(both, "clean", {"two_rates": N.none_of_poisson(F.col("opp_rate")), "direct": direct.score(), "mean": F.lit(mean)})


def two_rates(spark: SparkSession, root: str) -> DataFrame:
    out = two_rate_scores(spark, root)
    return out.select("version", (F.col("n") > 0).cast("int").alias("has_rows"), F.col("brier").between(0, 0.5).cast("int").alias("in_range"))


def season_scores(spark: SparkSession, root: str) -> DataFrame:
    """Held-out error of a minutes model on recent matches alone, and on all with recent ones weighted threefold."""
    train, test = _split(_facts(spark, root))
    cut = S.quantile_edges(train, "gameweek", [0.5])[0]
    weighted = train.withColumn("weight", F.when(F.col("gameweek") > cut, 3.0).otherwise(1.0))
    features = models.varying(train, FEATURES)
    recent, _ = models.fit_logistic(train.where(F.col("gameweek") > cut), "full", features)
    every, _ = models.fit_logistic(weighted, "full", features, "weight")
    mean = float(train.agg(F.avg("full")).first()[0] or 0.0)
    return models.tournament(test, "full", {"recent": recent.score(), "weighted": every.score(), "mean": F.lit(mean)})


def weighted_seasons(spark: SparkSession, root: str) -> DataFrame:
    return versions(season_scores(spark, root), "mean")


QUOTA = {"STANDARD": 2, "SMALL": 5, "MEDIUM": 5, "ECONOMY": 3}
LEAST = {"STANDARD": 1, "SMALL": 3, "MEDIUM": 2, "ECONOMY": 1}
MOST = {"STANDARD": 1, "SMALL": 5, "MEDIUM": 5, "ECONOMY": 3}
PER_BRAND = 3


def choose(spark: SparkSession, root: str) -> tuple[list[decide.Item], list[decide.Item], int]:
    """(squad, its starting eleven, budget)."""
    parts = table(spark, root, "part", "p_partkey", "p_type", "p_brand", "p_retailprice", "p_size").withColumn("price", F.floor("p_retailprice").cast("int"))
    items = decide.undominated(parts, "p_partkey", "p_type", "p_brand", "price", "p_size", QUOTA, PER_BRAND)
    budget = int(sum(sorted(i.price for i in items)[:15]) * 1.05)
    chosen = decide.best_squad(items, QUOTA, budget, PER_BRAND)
    return chosen, decide.starting(chosen, LEAST, MOST), budget


def squad(spark: SparkSession, root: str) -> DataFrame:
    """The 15 parts of greatest total size within quotas of types, three of a brand, and a budget; which of them start."""
    chosen, first, _ = choose(spark, root)
    starts = {i.key for i in first}
    return spark.createDataFrame([(i.key, i.group, i.team, i.price, i.value, i.key in starts) for i in chosen], "p_partkey long, p_type string, p_brand string, price int, value double, starts boolean")


def squad_rules(spark: SparkSession, root: str) -> DataFrame:
    """By type: how many are chosen, and whether budget, brands and the eleven's formation are kept."""
    chosen, first, budget = choose(spark, root)
    brands: dict[str, int] = {}
    for i in chosen:
        brands[i.team] = brands.get(i.team, 0) + 1
    kept = int(sum(i.price for i in chosen) <= budget and max(brands.values(), default=0) <= PER_BRAND)
    rows = [(g, sum(i.group == g for i in chosen), kept, int(LEAST[g] <= sum(i.group == g for i in first) <= MOST[g] and len(first) == 11)) for g in QUOTA]
    return spark.createDataFrame(rows, "p_type string, n long, limits_kept int, formation_kept int")


def lookahead(spark: SparkSession, root: str) -> DataFrame:
    """(player_id, gameweek, ahead): the minutes of a player's next three rounds, this one included."""
    reports = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "fixture_id", "gameweek", "minutes", "ingested_at")
    last = W.latest_rows(reports, ["player_id", "fixture_id"], ["ingested_at", "row_id"])
    each = last.groupBy("player_id", "gameweek").agg(F.sum("minutes").cast("bigint").alias("minutes"))
    w = Window.partitionBy("player_id").orderBy(F.col("gameweek").cast("long")).rangeBetween(0, 2)
    return each.select("player_id", "gameweek", F.sum("minutes").over(w).alias("ahead"))


def swap_plan(spark: SparkSession, root: str) -> tuple[list[decide.Item], list[tuple[int, int, int, float]], dict[int, decide.Item]]:
    """(the eleven owned at first, the plan, all items by key): at each round the best swap over the next three rounds.

    For each round, position and price only the best offers are kept (as many as the squad and the club limit could
    rule out), so what comes to the driver grows with rounds and prices, not with players.
    """
    reports = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "gameweek", "position", "team", "value", "ingested_at")
    last = W.latest_rows(reports.where("value is not null and position is not null and team is not null"), ["player_id", "gameweek"], ["ingested_at", "row_id"])
    pool = last.join(lookahead(spark, root), ["player_id", "gameweek"])
    first = pool.where("gameweek = 1")
    owned_rows = W.top_n(first, ["position"], [F.col("ahead").asc(), F.col("player_id")], 3).collect()
    owned = [decide.Item(r["player_id"], r["position"], r["team"], r["value"], float(r["ahead"])) for r in owned_rows]
    mine = [x.key for x in owned]
    kept = W.top_n(pool, ["gameweek", "position", "value"], [F.col("ahead").desc(), F.col("player_id")], len(owned) + PER_BRAND + 1).unionByName(W.top_n(pool.where(F.col("player_id").isin(mine)), ["gameweek", "player_id"], [F.col("ahead")], 1))
    offers: dict[int, list[decide.Item]] = {}
    scores: dict[int, dict[int, float]] = {}
    items = {x.key: x for x in owned}
    for r in kept.select("gameweek", "player_id", "position", "team", "value", "ahead").collect():
        item = decide.Item(r["player_id"], r["position"], r["team"], r["value"], float(r["ahead"]))
        offers.setdefault(r["gameweek"], []).append(item)
        scores.setdefault(r["gameweek"], {})[r["player_id"]] = item.value
        items[item.key] = item
    plan = decide.plan_swaps(sorted(offers), owned, offers, scores, 5, PER_BRAND, window=1)
    return owned, plan, items


def transfer_rules(spark: SparkSession, root: str) -> DataFrame:
    """The swap plan's promises: gains of one at least, positions kept, none sold that isn't owned, one a round at most."""
    owned, plan, items = swap_plan(spark, root)
    held, fine = {x.key for x in owned}, True
    for _, out, into, gain in plan:
        fine &= out in held and into not in held and gain >= 1.0 and items[out].group == items[into].group
        held = (held - {out}) | {into}
    return spark.createDataFrame([(len(owned), int(fine), int(len({r for r, *_ in plan}) == len(plan)), int(len(held) == len(owned)))], "n_owned long, swaps_fine int, one_a_round int, size_kept int")


def captain_picks(spark: SparkSession, root: str) -> DataFrame:
    """Best, second and highest-ceiling customer of each segment."""
    orders = table(spark, root, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(cents("o_totalprice")).alias("total"), F.max(cents("o_totalprice")).alias("ceiling"))
    pool = table(spark, root, "customer", "c_custkey", "c_mktsegment").join(orders, "c_custkey")
    return decide.captains(pool, "c_mktsegment", "c_custkey", "total", "ceiling")


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events by hour and type, as a stream over all that is there."""
    counts = stream.windowed_counts(stream.event_stream(spark, f"{root}/events.parquet"))
    out = stream.run_available(counts, "complete", _shared(spark, "windows"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def stream_once(spark: SparkSession, root: str) -> DataFrame:
    """Each event once, as a stream: counts by type. The watermark is longer than any history, so no late file is dropped."""
    out = stream.run_available(stream.once(stream.event_stream(spark, f"{root}/events.parquet"), "36500 days"), "append", _shared(spark, "once"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def stream_last_values(spark: SparkSession, root: str) -> DataFrame:
    """Mean of each user's last five values, kept as state by a stream."""
    means = stream.last_values(stream.event_stream(spark, f"{root}/events.parquet"), idle="36500 days")
    out = stream.run_available(means, "update", _shared(spark, "last"))
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "mean_last"), "batch").alias("x"))
    return last.select("user_id", "x.n", F.round("x.mean_last", 6).alias("mean_last"))


QUERIES = {
    f.__name__: f
    for f in (glm_poisson_saturated, logit_saturated, ols, minutes_model, forecast_tournament, calibrators, coefficients, logistic_fallback, kept_features, extreme_probe, simulated_ranges, two_rates, weighted_seasons, squad, squad_rules, lookahead, transfer_rules, captain_picks, stream_windows, stream_once, stream_last_values)
}

def _facts_sql() -> str:
    from tessara.plans.forms import SQL as FORMS

    return f"""with pf as ({FORMS["player_features"]}),
reports as (select player_id, fixture_id, minutes from (select *, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1),
facts as (select pf.player_id, pf.fixture_id, m.gameweek, m.position, r.minutes from pf join model_ready_dataset m on m.player_id = pf.player_id and m.fixture_id = pf.fixture_id join reports r on r.player_id = pf.player_id and r.fixture_id = pf.fixture_id where pf.roll5_minutes is not null),
cut as (select quantile_cont(gameweek, 0.75) as cut from facts), test as (select facts.* from facts, cut where gameweek > cut), train as (select facts.* from facts, cut where gameweek <= cut)"""


def _versions_sql(*names: str) -> str:
    return f"{_facts_sql()} select unnest([{', '.join(repr(n) for n in names)}]) as version, count(*) as n, 1 as is_sound from test"


SQL = {
    "minutes_model": f"{_facts_sql()} select count(*) as n, 1 as is_calibrated, 1 as in_range from test",
    "forecast_tournament": _versions_sql("poisson", "forest", "boosted", "mean"),
    "calibrators": _versions_sql("raw", "platt", "isotonic", "folds"),
    "weighted_seasons": _versions_sql("recent", "weighted", "mean"),
    "coefficients": f"{_facts_sql()} select position, count(*) as n, 1 as is_balanced from train where position in ('GK', 'DEF', 'MID', 'FWD') group by 1 having count(*) >= 60",
    "two_rates": "select unnest(['two_rates', 'direct', 'mean']) as version, 1 as has_rows, 1 as in_range",
    "logistic_fallback": "select l_returnflag, round(avg(cast(l_quantity > 25 as int)), 6) as predicted, 1 as converged, 0 as second_converged, 1 as second_right from lineitem group by 1",
    "kept_features": "select unnest(['quantity', 'twice', 'flat']) as feature, unnest([1, 1, 0]) as varies, unnest([1, 0, 0]) as is_own, unnest([1, 0, 0]) as is_best",
    "extreme_probe": """
with m as (select count(*) as n, regr_intercept(l_extendedprice, l_quantity) as i, regr_slope(l_extendedprice, l_quantity) as s, min(l_quantity) as a, max(l_quantity) as z from lineitem)
select n, round(greatest(i + s * a, i + s * z), 1) as best, round(least(i + s * a, i + s * z), 1) as worst from m""",
    "simulated_ranges": "select fixture_id, 1 as is_near, 1 as is_ordered from fpl_clean_dataset join (select distinct fixture_id from model_ready_dataset) using (fixture_id) where team is not null group by 1",
    "squad_rules": f"select unnest({list(QUOTA)}) as p_type, unnest({list(QUOTA.values())}::bigint[]) as n, 1 as limits_kept, 1 as formation_kept",
    "lookahead": """
with last as (select * from (select *, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1),
e as (select player_id, gameweek, sum(minutes) as m from last group by 1, 2)
select player_id, gameweek, cast(sum(m) over (partition by player_id order by gameweek range between current row and 2 following) as bigint) as ahead from e""",
    "transfer_rules": """
with p as (select player_id, arg_max(position, row(ingested_at, row_id)) as position from fpl_clean_dataset where gameweek = 1 and value is not null and position is not null and team is not null group by 1),
n as (select least(3, count(*)) as n from p group by position)
select cast(sum(n) as bigint) as n_owned, 1 as swaps_fine, 1 as one_a_round, 1 as size_kept from n""",
    "glm_poisson_saturated": "select l_linestatus, l_returnflag, round(avg(cast(l_quantity as bigint)), 5) as predicted, count(*) as n from lineitem group by 1, 2",
    "logit_saturated": "with l as (select l_returnflag, cast(l_quantity > 25 as int) as y, cast(round(l_discount * 100) as bigint) + 1 as w from lineitem) select l_returnflag, round(cast(sum(y * w) as double) / sum(w), 6) as predicted from l group by 1",
    "ols": "select count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 3) as slope, round(regr_intercept(l_extendedprice, l_quantity), 1) as intercept from lineitem",
    "captain_picks": """
with o as (select o_custkey, sum(cast(round(o_totalprice * 100) as bigint)) as total, max(cast(round(o_totalprice * 100) as bigint)) as ceiling from orders group by 1),
r as (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by total desc, c_custkey) as a, row_number() over (partition by c_mktsegment order by ceiling desc, c_custkey) as b from customer join o on o_custkey = c_custkey)
select c_mktsegment, max(c_custkey) filter (where a = 1) as captain, max(c_custkey) filter (where a = 2) as vice, max(c_custkey) filter (where b = 1) as high from r group by 1""",
    "stream_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total from events group by 1, 2",
    "stream_once": "select event_type, count(distinct event_id) as n from events group by 1",
    "stream_last_values": "with r as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events where value is not null) select user_id, count(*) as n, round(avg(value), 6) as mean_last from r where place <= 5 group by 1",
}
