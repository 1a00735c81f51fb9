"""Queries of sources, sinks, guards, labels and filters, each over whole tables, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.functions import numeric as N
from tessara.functions import text as X
from tessara.operators import models, quality, relate
from tessara.operators import windows as W
from tessara.operators.summarize import quantile_edges
from tessara.plans.forms import cents
from tessara.session import checkpoint_dir
from tessara.sources import files, sinks, tables
from tessara.sources.tables import table
from tessara.streaming import events as stream


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def csv_scan(spark: SparkSession, root: str) -> DataFrame:
    """Customers written as CSV and read back with a declared schema, some columns only."""
    path = _folder(spark, "csv")
    rows = table(spark, root, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    sinks.guarded_overwrite(rows, path, "csv")
    return files.read_csv(spark, path, rows.schema, ["c_custkey", "c_acctbal", "c_mktsegment"])


def nested_scan(spark: SparkSession, root: str) -> DataFrame:
    """Orders written as a JSON document for each customer, read back one row for each order."""
    path = _folder(spark, "json")
    orders = table(spark, root, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    each = orders.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))).alias("orders"))
    each.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return files.read_nested_json(spark, path, "o_custkey long, orders array<struct<key:long,price:double>>", "orders", "o_", lines=True)


def corrupt_lines(spark: SparkSession, root: str) -> DataFrame:
    """Properties of events written as lines, those of clicks cut short: how many lines do not fit their schema."""
    path = _folder(spark, "lines")
    rows = table(spark, root, "events", "event_type", "props")
    rows.select(F.when(F.col("event_type") == "click", F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props")).alias("value")).where("value is not null").write.text(path)
    return files.corrupt_records(spark, path, "k INT").agg(F.count("*").alias("n_corrupt"))


def name_list(spark: SparkSession, root: str) -> DataFrame:
    """Names of parts as a plain list with blanks and empty lines, read and looked up among all parts (semi-join)."""
    path = _folder(spark, "list")
    names = table(spark, root, "part", "p_name").where("p_name is not null").distinct()
    names.select(F.explode(F.array(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")), F.lit(""))).alias("value")).write.text(path)
    return files.read_list(spark, path).groupBy("name").agg(F.count("*").alias("n"))


def log_fields(spark: SparkSession, root: str) -> DataFrame:
    """A log of region figures: the last number of each kind that its patterns find."""
    path = _folder(spark, "log")
    figures = table(spark, root, "nation", "n_nationkey").agg(F.count("*").alias("n"), F.max("n_nationkey").alias("z"))
    figures.select(F.concat(F.lit("rows: 1\nrows: "), F.col("n"), F.lit(" of 99\nlargest: "), F.col("z"), F.lit("\n")).alias("value")).coalesce(1).write.text(path)
    read = files.read_log(spark, path, {"n_rows": r"rows: (\d+)", "largest": r"largest: (\d+)", "absent": r"error: (\d+)"}, glob="*.txt")
    return files.latest_file(read).select(F.col("n_rows").cast("bigint").alias("n_rows"), F.col("largest").cast("bigint").alias("largest"), F.col("absent").cast("bigint").alias("absent"))


def append_history(spark: SparkSession, root: str) -> DataFrame:
    """Orders appended in two loads that overlap and have different columns: the first write of a key stays."""
    path = _folder(spark, "history")
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    early = orders.where("o_orderstatus <> 'O'").withColumn("load", F.lit(1))
    sinks.append_first_wins(early, path, ["o_orderkey"], ["o_custkey"])
    stored = spark.read.parquet(path)
    unseen = files.unseen(orders, stored, "o_orderkey").agg(F.count("*").alias("n")).first()["n"]
    sinks.append_first_wins(orders.drop("o_orderstatus").withColumn("load", F.lit(2)), path, ["o_orderkey"], ["o_custkey"])
    try:  # a result without rows replaces nothing
        sinks.guarded_overwrite(stored.limit(0), path)
    except sinks.EmptyResult:
        pass
    return spark.read.parquet(path).groupBy("load").agg(F.count("*").alias("n"), F.count("o_orderstatus").alias("n_status")).withColumn("n_unseen", F.lit(unseen).cast("bigint"))


def side_output(spark: SparkSession, root: str) -> DataFrame:
    """Repeated reports split off to a side output: rows kept and rows there."""
    path = _folder(spark, "side")
    rows = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "fixture_id", "ingested_at")
    kept = sinks.split_duplicates(W.duplicate_flags(rows, ["player_id", "fixture_id"], [F.col("ingested_at").desc(), F.col("row_id").desc()]), path)
    return kept.agg(F.count("*").alias("n_kept")).join(F.broadcast(spark.read.parquet(path).agg(F.count("*").alias("n_side"))))  # one row each


def next_round(spark: SparkSession, root: str) -> DataFrame:
    """The first finished round after a stored mark, which then moves on; a round is finished once its deadline is past."""
    import tempfile

    rounds = table(spark, root, "gameweeks").select(F.col("gameweek").alias("id"), (F.col("deadline_time") < F.lit("2026-01-01").cast("timestamp")).alias("finished"), F.lit(True).alias("data_checked"))
    with tempfile.TemporaryDirectory() as folder:  # the driver's own small state
        path, out = f"{folder}/state.json", []
        for _ in range(3):
            found = stream.newly_completed(rounds, files.read_state(path, {"last": 9})["last"])
            sinks.write_state(path, {"last": found})
            out.append((found,))
    return spark.createDataFrame(out, "gameweek int").withColumn("gameweek", F.col("gameweek").cast("bigint"))


def adapted(spark: SparkSession, root: str) -> DataFrame:
    """Customers under the naming convention that fits, the columns asked for that are there, rounded, keys as text."""
    rows = tables.adapt(table(spark, root, "customer"), [{"id": "key"}, {"c_custkey": "key", "c_acctbal": "balance", "c_mktsegment": "segment"}])
    some = rows.select(*tables.present(rows, ["segment", "key", "none", "balance"]))
    return tables.rounded(some.withColumn("balance", F.col("balance") / 1000), 2).withColumn("key", F.col("key").cast("string")).drop("absent")


def labels(spark: SparkSession, root: str) -> DataFrame:
    """Lines by reached threshold, size of gap, error in words and sign: the number of each combination."""
    lines = table(spark, root, "lineitem", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    pct = lambda c: F.round(F.col(c) * 100).cast("bigint")
    gap = pct("l_discount") - pct("l_tax")
    tagged = lines.select(
        N.reaches(F.col("l_quantity"), F.col("l_returnflag"), {"N": 20, "R": 30}).alias("hit"), N.gap_label(gap, 3, 6).alias("gap"), N.error_label(gap, 2).alias("error"), models.sign_label(gap, F.lit(1)).alias("sign"),
        N.safe_ratio(pct("l_discount").cast("double"), pct("l_tax").cast("double"), -1.0).alias("ratio"),
    )
    return tagged.groupBy("hit", "gap", "error", "sign").agg(F.count("*").alias("n"), F.count_if(F.col("ratio") == -1.0).alias("without_ratio"))


def half_open(spark: SparkSession, root: str) -> DataFrame:
    """Reports of the three rounds from the twentieth on, of the first and of the last round, by league; rows left out are counted."""
    rows = table(spark, root, "fpl_clean_dataset", "gameweek", "feed", "minutes")
    ends = rows.agg(F.min("gameweek").alias("a"), F.max("gameweek").alias("z"))
    both = rows.join(F.broadcast(ends))  # one row
    inside = (F.col("gameweek") >= 20) & (F.col("gameweek") < 23)
    return both.groupBy(F.coalesce("feed", F.lit("none")).alias("feed")).agg(F.count_if(inside).alias("n_window"), F.count_if(F.col("gameweek") == F.col("a")).alias("n_first"), F.count_if(F.col("gameweek") == F.col("z")).alias("n_last"), F.count_if(~inside).alias("n_left_out"))


def families(spark: SparkSession, root: str) -> DataFrame:
    """Families of generated feature names, made from the columns of a table."""
    columns = [f"{side}{window}{c}" for c in ("minutes", "goals", "own_goals") for side in ("", "opp_", "own_") for window in ("", "roll5_", "season_", "team_roll10_")]
    return spark.createDataFrame([(c,) for c in columns], "feature string").select("feature", X.feature_family(F.col("feature"), {"own_goals": "goals"}).alias("family"))


def text_bits(spark: SparkSession, root: str) -> DataFrame:
    """Dates at the front, "N of M", a made-up file name and a full name, of every match and player text."""
    rows = table(spark, root, "fbref_player_match_summary", "row_id", "game", "player", "team", "min")
    day = F.nullif(F.regexp_extract("game", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    share = F.concat(F.col("min").cast("string"), F.lit(" of 90"))
    return rows.select("row_id", day.alias("day"), X.number_after(share, r"(\d+) of (\d+)").alias("n"), X.number_after(share, r"(\d+) of (\d+)", 2).alias("m"), F.regexp_replace(F.lower(F.trim(F.concat_ws(" ", "player", "team"))), r"[ /]", "_").alias("file"))


def name_ratio(spark: SparkSession, root: str) -> DataFrame:
    """Similarity, words sorted, of every proposed pair of names."""
    rows = table(spark, root, "entity_matching_table", "row_id", "fpl_full_name", "understat_name").where("fpl_full_name is not null and understat_name is not null")
    ascii_only = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z ]", "")
    return rows.select("row_id", F.round(X.token_sort_ratio(ascii_only("fpl_full_name"), ascii_only("understat_name")), 6).alias("ratio"))


def find_player(spark: SparkSession, root: str) -> DataFrame:
    """The one nation that is meant by a part of its name."""
    return relate.find_one(table(spark, root, "nation", "n_nationkey", "n_name"), "n_name", "nation_7", X.simple_name).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")


def guarded_join(spark: SparkSession, root: str) -> DataFrame:
    """Orders with their customer's segment, by a join whose keys and row counts are checked."""
    orders = quality.required(table(spark, root, "orders", "o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"])
    customers = quality.unique_key(table(spark, root, "customer", "c_custkey", "c_mktsegment"), ["c_custkey"])
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return quality.same_rows(orders, joined).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def side_contract(spark: SparkSession, root: str) -> DataFrame:
    """Stored matches: repeated keys, players with more than two matches in a round, and rows without the figure."""
    return quality.contract(table(spark, root, "model_ready_dataset", "player_id", "fixture_id", "gameweek", "roll5_xG"), ["player_id", "fixture_id"], ["player_id", "gameweek"], 2, "roll5_xG")


def first_rows(spark: SparkSession, root: str) -> DataFrame:
    """Features that a player's first match already has, which only later ones may have."""
    return quality.first_row_leaks(table(spark, root, "model_ready_dataset", "player_id", "match_date", "fixture_id", "roll5_minutes", "days_since_last_game", "consecutive_starts"), "player_id", ["match_date", "fixture_id"], ["roll5_minutes", "days_since_last_game", "consecutive_starts"])


def feature_spread(spark: SparkSession, root: str) -> DataFrame:
    """Range of each stored feature, and players in whom it never changes."""
    features = ["days_since_last_game", "consecutive_starts", "was_home_int"]
    return quality.spread(table(spark, root, "model_ready_dataset", "player_id", *features), "player_id", features)


def rebuilt_totals(spark: SparkSession, root: str) -> DataFrame:
    """Goals of a player before each match, rebuilt from the matches and compared with the features' own total."""
    from tessara.plans.forms import player_features

    days = table(spark, root, "model_ready_dataset", "player_id", "fixture_id", "gameweek", "match_date")
    reports = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "fixture_id", "goals", "ingested_at")
    goals = W.latest_rows(reports, ["player_id", "fixture_id"], ["ingested_at", "row_id"]).select("player_id", "fixture_id", "goals")
    rows = player_features(spark, root).select("player_id", "fixture_id", "season_goals_total").join(days, ["player_id", "fixture_id"]).join(goals, ["player_id", "fixture_id"])
    out = quality.rebuilt(rows, "player_id", ["gameweek", "match_date", "fixture_id"], "goals", "season_goals_total")
    return out.agg(F.count("*").alias("n"), F.count_if(~F.col("agrees")).alias("n_wrong"), F.sum("true_before").cast("bigint").alias("total"))


def roster_status(spark: SparkSession, root: str) -> DataFrame:
    """Players of the reports against the proposals: absent, under another name, or fine."""
    players = table(spark, root, "fpl_clean_dataset", "player_id", "full_name").groupBy("player_id").agg(F.max("full_name").alias("full_name"))
    known = table(spark, root, "entity_matching_table", "player_id", "fpl_full_name").groupBy("player_id").agg(F.max("fpl_full_name").alias("fpl_full_name"))
    return quality.classify(players, known, "player_id", ~F.col("full_name").eqNullSafe(F.col("fpl_full_name"))).groupBy("status").agg(F.count("*").alias("n"))


def month_over_month(spark: SparkSession, root: str) -> DataFrame:
    """Orders and their total by month, with the change to the month before."""
    orders = table(spark, root, "orders", "o_orderdate", "o_totalprice")
    monthly = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total"))
    return quality.run_over_run(monthly, "month", ["n", "total"])


def drift_alarms(spark: SparkSession, root: str) -> DataFrame:
    """Whether the mean order of the later half of time is in alarm against a baseline that the earlier half sets; steps go on after a failure."""
    orders = table(spark, root, "orders", "o_orderdate", "o_totalprice").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01")))
    orders = orders.withColumn("half", (F.col("day") > quantile_edges(orders, "day", [0.5])[0]).cast("int"))
    means = {r["half"]: r["m"] for r in orders.groupBy("half").agg((F.sum(cents("o_totalprice")) / F.count("*")).alias("m")).collect()}
    steps = quality.steps([("read", lambda: means[0]), ("fail", lambda: 1 / 0), ("go on", lambda: means[1])])
    alarms = quality.drift({"mean": means[1], "none": None}, {"mean": means[0] * 0.5, "none": 1.0}, {"mean": 0.05, "none": 0.15}, {})
    return spark.createDataFrame([(name, int(ok), int(name in alarms)) for name, ok, _ in steps] + [(name, 0, 1) for name in alarms], "name string, ok int, alarm int")


def report_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines and columns of a text report on regions, and the size of its page."""
    rows = table(spark, root, "region", "r_regionkey", "r_name").orderBy("r_regionkey")
    lines = sinks.text_report(rows, "Regions").splitlines()
    page = sinks.report_page(rows, "<script>__DATA__</script>")
    return spark.createDataFrame([(len(lines), lines[0], page.count("r_name"))], "n_lines long, title string, n_records long")


def target_strength(spark: SparkSession, root: str) -> DataFrame:
    """Correlation of each figure of a line with its price."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    one = table(spark, root, "lineitem", *columns, "l_extendedprice").agg(*[F.corr(c, "l_extendedprice").alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("r")) for c in columns])))


QUERIES = {
    f.__name__: f
    for f in (
        csv_scan, nested_scan, corrupt_lines, name_list, log_fields, append_history, side_output, next_round, adapted, labels, half_open, families, text_bits, name_ratio, find_player,
        guarded_join, side_contract, first_rows, feature_spread, rebuilt_totals, roster_status, month_over_month, drift_alarms, report_lines, target_strength,
    )
}

_GAP = "(cast(round(l_discount * 100) as bigint) - cast(round(l_tax * 100) as bigint))"
_LAST = "last as (select * from (select *, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1)"

SQL = {
    "csv_scan": "select c_custkey, c_acctbal, c_mktsegment from customer",
    "nested_scan": "select cast(o_custkey as bigint) as o_custkey, cast(o_orderkey as bigint) as o_key, o_totalprice as o_price from orders",
    "corrupt_lines": "select count(*) as n_corrupt from events where event_type = 'click' and props is not null",
    "name_list": "select trim(p_name) as name, count(distinct p_name) as n from part where p_name is not null group by 1",
    "log_fields": "select count(*) as n_rows, cast(max(n_nationkey) as bigint) as largest, cast(null as bigint) as absent from nation",
    "append_history": "select case when o_orderstatus <> 'O' then 1 else 2 end as load, count(*) as n, count(*) filter (where o_orderstatus <> 'O') as n_status, (select count(*) from orders where o_orderstatus = 'O') as n_unseen from orders group by 1",
    "side_output": "select count(*) filter (where rn = 1) as n_kept, count(*) filter (where rn > 1) as n_side from (select row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset)",
    "next_round": "select cast(gameweek as bigint) as gameweek from gameweeks where gameweek > 9 and deadline_time < timestamp '2026-01-01' order by gameweek limit 3",
    "adapted": "select c_mktsegment as segment, cast(c_custkey as varchar) as key, round(c_acctbal / 1000, 2) as balance from customer",
    "labels": f"""
with l as (select case l_returnflag when 'N' then cast(l_quantity >= 20 as int) when 'R' then cast(l_quantity >= 30 as int) end as hit, {_GAP} as g, cast(round(l_tax * 100) as bigint) as t from lineitem)
select hit, case when abs(g) >= 6 then 'MAJOR' when abs(g) >= 3 then 'DISAGREE' else 'AGREE' end as gap, case when abs(g) < 2 then 'noise' when g > 0 then 'too low' else 'too high' end as error,
    case when g = 0 then 'none' when g > 0 then 'as expected' else 'reversed' end as sign, count(*) as n, count(*) filter (where t = 0) as without_ratio from l group by 1, 2, 3, 4""",
    "half_open": "select coalesce(feed, 'none') as feed, count(*) filter (where gameweek >= 20 and gameweek < 23) as n_window, count(*) filter (where gameweek = a) as n_first, count(*) filter (where gameweek = z) as n_last, count(*) filter (where not (gameweek >= 20 and gameweek < 23)) as n_left_out from fpl_clean_dataset, (select min(gameweek) as a, max(gameweek) as z from fpl_clean_dataset) group by 1",
    "families": """
with f as (select c, s, w from (select unnest(['minutes', 'goals', 'own_goals']) as c), (select unnest(['', 'opp_', 'own_']) as s), (select unnest(['', 'roll5_', 'season_', 'team_roll10_']) as w))
select s || w || c as feature, case c when 'own_goals' then 'goals' else c end as family from f""",
    "text_bits": r"""
select row_id, nullif(regexp_extract(game, '^(\d{4}-\d{2}-\d{2})', 1), '') as day, cast(min as double) as n, case when min is not null then 90.0::double end as m,
    regexp_replace(lower(trim(concat_ws(' ', player, team))), '[ /]', '_', 'g') as file from fbref_player_match_summary""",
    "name_ratio": """
with n as (select row_id, list_aggregate(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(fpl_full_name), '[^a-z ]', '', 'g'), '\\s+', ' ', 'g')), ' ')), 'string_agg', ' ') as a,
    list_aggregate(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(understat_name), '[^a-z ]', '', 'g'), '\\s+', ' ', 'g')), ' ')), 'string_agg', ' ') as b from entity_matching_table where fpl_full_name is not null and understat_name is not null)
select row_id, round(100 * (1 - levenshtein(a, b)::double / greatest(length(a), length(b), 1)), 6) as ratio from n""".replace("\\\\s", "\\s"),
    "find_player": "select cast(n_nationkey as bigint) as n_nationkey, n_name from nation where lower(n_name) = 'nation_7'",
    "guarded_join": "select c_mktsegment, count(*) as n from orders left join customer on o_custkey = c_custkey group by 1",
    "side_contract": "select (select count(*) from (select 1 from model_ready_dataset group by player_id, fixture_id having count(*) > 1)) as duplicate_keys, (select count(*) from (select 1 from model_ready_dataset group by player_id, gameweek having count(*) > 2)) as crowded_groups, (select count(*) from model_ready_dataset where roll5_xG is null or isnan(roll5_xG)) as null_targets",
    "first_rows": """
with f as (select * from (select *, row_number() over (partition by player_id order by match_date, fixture_id) rn from model_ready_dataset) where rn = 1)
select 'roll5_minutes' as feature, count(*) filter (where not isnan(roll5_minutes)) as n from f union all select 'days_since_last_game', count(days_since_last_game) from f union all select 'consecutive_starts', count(consecutive_starts) from f""",
    "feature_spread": " union all ".join(
        f"select '{c}' as feature, cast(sum(n) as bigint) as n, cast(min(a) as double) as least, cast(max(z) as double) as most, count(*) filter (where n > 1) as entities, count(*) filter (where n > 1 and a = z) as constant from (select count({c}) as n, min({c}) as a, max({c}) as z from model_ready_dataset group by player_id)"
        for c in ("days_since_last_game", "consecutive_starts", "was_home_int")
    ),
    "rebuilt_totals": f"""
with {_LAST}, j as (select l.player_id, l.goals, m.gameweek, m.match_date, m.fixture_id from last l join model_ready_dataset m on m.player_id = l.player_id and m.fixture_id = l.fixture_id),
b as (select coalesce(sum(goals) over (partition by player_id order by gameweek, match_date, fixture_id rows between unbounded preceding and 1 preceding), 0) as t from j)
select count(*) as n, cast(0 as bigint) as n_wrong, cast(sum(t) as bigint) as total from b""",
    "roster_status": """
with p as (select player_id, max(full_name) as a from fpl_clean_dataset group by 1), e as (select player_id, max(fpl_full_name) as b, 1 as there from entity_matching_table group by 1)
select case when there is null then 'absent' when a is distinct from b then 'different' else 'fine' end as status, count(*) as n from p left join e using (player_id) group by 1""",
    "month_over_month": """
with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total from orders group by 1)
select month, n, n - lag(n) over w as n_change, total, total - lag(total) over w as total_change from m window w as (order by month)""",
    "drift_alarms": "select unnest(['read', 'fail', 'go on', 'mean', 'none']) as name, unnest([1, 0, 1, 0, 0]) as ok, unnest([0, 0, 0, 1, 1]) as alarm",
    "report_lines": "select count(*) + 2 as n_lines, 'Regions' as title, count(*) as n_records from region",
    "target_strength": " union all ".join(f"select '{c}' as feature, round(corr({c}, l_extendedprice), 6) as r from lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
}
