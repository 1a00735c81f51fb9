"""A game's scoring rule as data, and the queries that build on it: scores, expected totals, simulated rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.functions import numeric as N
from tessara.operators import models, relate, simulate
from tessara.operators import windows as W
from tessara.plans.relations import side_log
from tessara.sources.tables import table

# The game's points.
GOAL = {"GK": 10, "DEF": 6, "MID": 5, "FWD": 4}
CLEAN_SHEET = {"GK": 4, "DEF": 4, "MID": 1}
ENOUGH_DEFENCE = {"DEF": 10, "MID": 12, "FWD": 12}
FULL_MATCH = 60
RULE = [
    N.Term("minutes", 1, least=1),
    N.Term("minutes", 1, least=FULL_MATCH),
    N.Term("goals", GOAL),
    N.Term("assists", 3),
    N.Term("clean_sheets", CLEAN_SHEET, gate=("minutes", FULL_MATCH)),
    N.Term("saves", {"GK": 1}, step=3),
    N.Term("penalties_saved", {"GK": 5}),
    N.Term("penalties_missed", -2),
    N.Term("own_goals", -2),
    N.Term("defensive_contribution", dict.fromkeys(ENOUGH_DEFENCE, 2), least=ENOUGH_DEFENCE),
    N.Term("yellow_cards", -1),
    N.Term("red_cards", -3),
    N.Term("goals_conceded", {"GK": -1, "DEF": -1}, step=2),
    N.Term("bonus", 1),
]
FIGURES = ["minutes", "goals", "assists", "clean_sheets", "saves", "penalties_saved", "penalties_missed", "own_goals", "defensive_contribution", "yellow_cards", "red_cards", "goals_conceded", "bonus"]


def scored_points(spark: SparkSession, root: str) -> DataFrame:
    """Every report's points by the rule, and whether the stored and the actual points are others."""
    rows = table(spark, root, "fpl_clean_dataset", "row_id", "position", *FIGURES, "calculated_points", "actual_points")
    points = rows.withColumn("points", N.scored(RULE, F.col("position")).cast("bigint"))
    differs = lambda c: (~F.col(c).cast("bigint").eqNullSafe(F.col("points"))).cast("int")
    return points.select("row_id", "points", differs("calculated_points").alias("differs_stored"), differs("actual_points").alias("differs_actual"))


def points_mismatch(spark: SparkSession, root: str) -> DataFrame:
    """By position: reports whose stored points are not the actual ones, and the size of the difference."""
    rows = table(spark, root, "fpl_clean_dataset", "position", "calculated_points", "actual_points")
    gap = F.col("calculated_points") - F.col("actual_points")
    return rows.groupBy("position").agg(F.count("*").alias("n"), F.count_if(gap != 0).alias("n_wrong"), F.sum(F.abs(gap)).cast("bigint").alias("total_gap"))


def rates(spark: SparkSession, root: str) -> DataFrame:
    """(player_id, fixture_id, gameweek, position, chances and rates): means of the ten matches before, 0 for none."""
    columns = [*FIGURES, "row_id", "player_id", "fixture_id", "ingested_at"]
    last = W.latest_rows(table(spark, root, "fpl_clean_dataset", *columns), ["player_id", "fixture_id"], ["ingested_at", "row_id"]).drop("row_id", "ingested_at")
    days = table(spark, root, "model_ready_dataset", "player_id", "fixture_id", "gameweek", "match_date", "position")
    rows = last.join(days, ["player_id", "fixture_id"])
    w = W.history_of("player_id", "gameweek", "match_date", "fixture_id")
    mean = lambda c: F.coalesce(W.prior_mean(c, w, 10), F.lit(0.0))
    hit = F.coalesce(N.reaches(F.col("defensive_contribution"), F.col("position"), ENOUGH_DEFENCE), F.lit(0))
    flags = {"p_any": (F.col("minutes") > 0).cast("int"), "p_full": (F.col("minutes") >= FULL_MATCH).cast("int"), "p_defence": hit}
    counts = {"goals": "goals", "assists": "assists", "saves": "saves", "penalties": "penalties_saved", "yellow": "yellow_cards", "red": "red_cards", "conceded": "goals_conceded", "bonus": "bonus"}
    return rows.select("player_id", "fixture_id", "gameweek", "position", *[mean(c).alias(n) for n, c in flags.items()], *[mean(F.col(c)).alias(f"r_{n}") for n, c in counts.items()])


def expected_mix(spark: SparkSession, root: str) -> DataFrame:
    """Expected points of every match in ten parts, each with its gate, and their sum; and the sum with one part exchanged.

    The parts that depend on the whole match have the chance of it as their gate, the others that of playing at all.
    """
    rows = rates(spark, root)
    of = lambda points: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for g, v in points.items() for x in (g, float(v))]), F.col("position")), F.lit(0.0))
    any_, full, one = F.col("p_any"), F.col("p_full"), F.lit(1.0)
    clean = N.none_of_poisson(F.col("r_conceded"))
    back = of({"GK": 1, "DEF": 1})
    parts = models.points_mix({
        "appearance": (any_ + full, 1.0, one),
        "goals": (F.col("r_goals") * of(GOAL), 1.0, any_),
        "assists": (F.col("r_assists"), 3.0, any_),
        "defence": (F.col("p_defence"), 2.0, any_),
        "clean_sheet": (clean * of(CLEAN_SHEET), 1.0, full),
        "saves": (F.col("r_saves") / 3 * of({"GK": 1}), 1.0, any_),
        "penalties": (F.col("r_penalties"), 5.0, any_),
        "cards": (F.col("r_yellow") + F.col("r_red") * 3, -1.0, any_),
        "conceded": (N.expected_halves(F.col("r_conceded")) * back, -1.0, full),
        "bonus": (F.col("r_bonus"), 1.0, full),
    })
    other = N.platt(clean, 0.9, -0.1) * of(CLEAN_SHEET) * full
    swapped = models.replaced(parts["pts_total"], parts["pts_clean_sheet"], other)
    return rows.select("player_id", "fixture_id", *[F.round(c, 6).alias(n) for n, c in parts.items()], F.round(swapped, 6).alias("pts_calibrated"))


def simulated_rounds(spark: SparkSession, root: str) -> DataFrame:
    """Totals of every club and round, 5,000 draws, double rounds added draw by draw: are mean and spread the analytic ones?

    A fixture's total has goals (5 each), a clean sheet (4, only in full), a point for being there, one for lasting,
    and minus one for each two conceded; rates are the club's means of ten fixtures before.
    """
    days = table(spark, root, "model_ready_dataset", "fixture_id", "gameweek").groupBy("fixture_id").agg(F.max("gameweek").alias("gameweek"))
    w = W.history_of("club", "gameweek", "fixture_id", "was_home_int")
    sides = side_log(spark, root).join(days, "fixture_id").where("club is not null")
    mean = lambda c: F.coalesce(W.prior_mean(F.col(c), w, 10), F.lit(1.3))
    rows = sides.select("club", "gameweek", "fixture_id", "was_home_int", mean("goals").alias("scored"), mean("opp_goals").alias("against")).withColumn("clean", N.none_of_poisson(F.col("against"))).withColumns({"there": F.lit(0.95), "full": F.lit(0.8)})
    parts = [simulate.Part("scored", 5.0), simulate.Part("clean", 4.0, "chance", "full"), simulate.Part("", 1.0, "sure"), simulate.Part("", 1.0, "sure", "full"), simulate.Part("against", -1.0, "count", "full", 2)]
    drawn = simulate.totals(rows, ["club", "gameweek"], parts, "there", "full", ["fixture_id", "was_home_int"])
    s, c, lam, a, f = F.col("scored"), F.col("clean"), F.col("against"), F.col("there"), F.col("full")
    halves = N.expected_halves(lam)
    means = a * (5 * s + 1) + f * (4 * c + 1 - halves)
    each = rows.groupBy("club", "gameweek").agg(F.sum(means).alias("mean"), F.count("*").alias("n"))
    both = drawn.join(each, ["club", "gameweek"])
    near = F.abs(F.col("sim_mean") - F.col("mean")) <= 6 * F.col("sim_std") / F.sqrt(F.lit(5000.0)) + 1e-9
    ordered = (F.col("sim_p10") <= F.col("sim_p25")) & (F.col("sim_p25") <= F.col("sim_p50")) & (F.col("sim_p50") <= F.col("sim_p75")) & (F.col("sim_p75") <= F.col("sim_p90"))
    return both.select("club", "gameweek", "n_rows", near.cast("int").alias("is_near"), (ordered & (F.col("n") == F.col("n_rows"))).cast("int").alias("is_ordered"))


def opponents_sum(spark: SparkSession, root: str) -> DataFrame:
    """For each fixture and side the other side's expected goals: the sum over its players, in tenths of a goal for each match before."""
    one = rates(spark, root).select("player_id", "fixture_id", F.round(F.col("r_goals") * 1000).cast("bigint").alias("expected"))
    sides = table(spark, root, "model_ready_dataset", "player_id", "fixture_id", "was_home_int")
    team = one.join(sides, ["player_id", "fixture_id"]).groupBy("fixture_id", "was_home_int").agg(F.sum("expected").alias("expected"))
    return relate.mirror(team, ["fixture_id"], "was_home_int", ["expected"])


QUERIES = {f.__name__: f for f in (scored_points, points_mismatch, expected_mix, simulated_rounds, opponents_sum)}


def _case(points: dict[str, float], column: str = "position") -> str:
    return f"case {column} " + " ".join(f"when '{g}' then {v}" for g, v in points.items()) + " else 0 end"


def _rates_sql() -> str:
    over = "over (partition by player_id order by gameweek, match_date, fixture_id rows between 10 preceding and 1 preceding)"
    mean = lambda x: f"coalesce(cast(sum({x}) {over} as double) / nullif(cast(count({x}) {over} as double), 0), 0.0)"
    counts = {"goals": "goals", "assists": "assists", "saves": "saves", "penalties": "penalties_saved", "yellow": "yellow_cards", "red": "red_cards", "conceded": "goals_conceded", "bonus": "bonus"}
    hit = "case " + " ".join(f"when position = '{g}' then coalesce(cast(defensive_contribution >= {n} as int), 0)" for g, n in ENOUGH_DEFENCE.items()) + " else 0 end"
    flags = {"p_any": "cast(minutes > 0 as int)", "p_full": f"cast(minutes >= {FULL_MATCH} as int)", "p_defence": hit}
    return f"""last as (select * from (select *, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1),
j as (select l.* exclude (gameweek, position), m.gameweek, m.match_date, m.position, m.was_home_int from last l join model_ready_dataset m on m.player_id = l.player_id and m.fixture_id = l.fixture_id),
rates as (select player_id, fixture_id, gameweek, position, was_home_int, {", ".join(f"{mean(x)} as {n}" for n, x in flags.items())}, {", ".join(f"{mean(x)} as r_{n}" for n, x in counts.items())} from j)"""


def _points_sql() -> str:
    parts = []
    for t in RULE:
        points = _case(t.points) if isinstance(t.points, dict) else str(t.points)
        value = f"coalesce({t.value}, 0)"
        if t.least is None:
            units = f"({value} // {t.step})"
        else:
            units = f"cast({value} >= {_case(t.least) if isinstance(t.least, dict) else t.least} as int)"
        gate = f" * cast(coalesce({t.gate[0]}, 0) >= {t.gate[1]} as int)" if t.gate else ""
        parts.append(f"{units} * ({points}){gate}")
    return " + ".join(parts)


_MIX = {
    "appearance": "p_any + p_full",
    "goals": f"r_goals * {_case(GOAL)} * p_any",
    "assists": "r_assists * 3 * p_any",
    "defence": "p_defence * 2 * p_any",
    "clean_sheet": f"exp(-r_conceded) * {_case(CLEAN_SHEET)} * p_full",
    "saves": f"r_saves / 3 * {_case({'GK': 1})} * p_any",
    "penalties": "r_penalties * 5 * p_any",
    "cards": "-(r_yellow + r_red * 3) * p_any",
    "conceded": f"-(r_conceded / 2 - (1 - exp(-2 * r_conceded)) / 4) * {_case({'GK': 1, 'DEF': 1})} * p_full",
    "bonus": "r_bonus * p_full",
}
_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, exp(-r_conceded))) / (1 - greatest(1e-6, least(1 - 1e-6, exp(-r_conceded)))))"

SQL = {
    "scored_points": f"""with p as (select *, cast({_points_sql()} as bigint) as points from fpl_clean_dataset)
select row_id, points, cast(calculated_points is distinct from points as int) as differs_stored, cast(actual_points is distinct from points as int) as differs_actual from p""",
    "points_mismatch": "select position, count(*) as n, count(*) filter (where calculated_points <> actual_points) as n_wrong, cast(sum(abs(calculated_points - actual_points)) as bigint) as total_gap from fpl_clean_dataset group by 1",
    "expected_mix": f"""with {_rates_sql()}, x as (select player_id, fixture_id, {", ".join(f"{e} as pts_{n}" for n, e in _MIX.items())}, 1 / (1 + exp(-({_LOGIT} * 0.9 - 0.1))) * {_case(CLEAN_SHEET)} * p_full as other from rates),
t as (select *, {" + ".join(f"pts_{n}" for n in _MIX)} as pts_total from x)
select player_id, fixture_id, {", ".join(f"round(pts_{n}, 6) as pts_{n}" for n in [*_MIX, "total"])}, round(pts_total - pts_clean_sheet + other, 6) as pts_calibrated from t""",
    "simulated_rounds": """
with last as (select * from (select *, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1),
n as (select fixture_id, was_home, team, count(*) as n from last where team is not null group by all),
labels as (select fixture_id, was_home, team as club from (select *, row_number() over (partition by fixture_id, was_home order by n desc, team) as place from n) where place = 1),
d as (select fixture_id, max(gameweek) as gameweek from model_ready_dataset group by 1)
select club, gameweek, count(*) as n_rows, 1 as is_near, 1 as is_ordered from labels join d using (fixture_id) group by 1, 2""",
    "opponents_sum": f"""with {_rates_sql()}, t as (select fixture_id, was_home_int, cast(sum(cast(round(r_goals * 1000) as bigint)) as bigint) as expected from rates group by 1, 2)
select a.fixture_id, a.was_home_int, a.expected, b.expected as opp_expected from t a left join t b on a.fixture_id = b.fixture_id and a.was_home_int <> b.was_home_int""",
}
