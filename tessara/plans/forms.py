"""Window queries: form, streaks, ranks, snapshots; with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessara.operators import windows as W
from tessara.sources.tables import table


def cents(price: str) -> Column:
    """A price in whole cents: sums of integers are exact in any order."""
    return F.round(F.col(price) * 100).cast("bigint")


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def rolling_form(spark: SparkSession, root: str) -> DataFrame:
    """Mean price of each customer's 3, 5, 10 and all orders before an order."""
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("c", cents("o_totalprice"))
    w = W.history_of("o_custkey", "o_orderdate", "o_orderkey")
    means = {f"roll{n}_price": W.prior_mean(F.col("c"), w, n) / 100.0 for n in (3, 5, 10)} | {"season_price": W.prior_mean(F.col("c"), w) / 100.0}
    return orders.select("o_orderkey", "o_custkey", *[m.alias(n) for n, m in means.items()])


def per_period_ratio(spark: SparkSession, root: str) -> DataFrame:
    """Discount per unit over a part's five lines before, and over all before."""
    lines = table(spark, root, "lineitem")
    w = W.history_of("l_partkey", *LINE_ORDER)
    off = cents("l_extendedprice") * F.round(F.col("l_discount") * 100).cast("bigint")
    quantity = F.col("l_quantity").cast("bigint")
    return lines.select("l_partkey", "l_orderkey", "l_linenumber", W.prior_ratio(off, quantity, w, 5).alias("roll5_ratio"), W.prior_ratio(off, quantity, w).alias("season_ratio"))


def days_since_last(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    w = W.history_of("o_custkey", "o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    return orders.select("o_orderkey", "o_custkey", W.days_since(day, w).cast("bigint").alias("days_since"), W.step_or(F.month(day), w, 7, 7).cast("bigint").alias("pseudo_days"))


def start_streak(spark: SparkSession, root: str) -> DataFrame:
    """Clicks of a user directly before an event."""
    events = table(spark, root, "events", "event_id", "user_id", "ts", "event_type")
    return W.prior_streak(events, F.col("event_type") == "click", "user_id", ["ts", "event_id"], "streak").select("event_id", "user_id", F.col("streak").cast("bigint").alias("streak"))


def penalty_rank(spark: SparkSession, root: str) -> DataFrame:
    """Urgent orders a customer had before; the two customers of a nation and month with most of them."""
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    nations = table(spark, root, "customer", "c_custkey", "c_nationkey")
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("bigint")
    before = orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), W.prior_sum(urgent, W.history_of("o_custkey", "o_orderdate", "o_orderkey")).alias("urgent_before"))
    # a customer has one place in a month, whatever the number of orders
    each = before.groupBy("o_custkey", "month").agg(F.max("urgent_before").alias("urgent_before")).join(nations, F.col("o_custkey") == F.col("c_custkey"))
    ranked = W.top_n(each, ["c_nationkey", "month"], [F.col("urgent_before").desc(), F.col("o_custkey")], 2)
    return ranked.where("urgent_before > 0").select(F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "month", "o_custkey", F.col("urgent_before").cast("bigint").alias("urgent_before"), (F.col("place") == 1).cast("int").alias("is_primary"), (F.col("place") == 2).cast("int").alias("is_backup"))


def rank_min_dense(spark: SparkSession, root: str) -> DataFrame:
    """Ranks of an order's lines by quantity; the first three dense ranks earn 3, 2 and 1."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc())
    lines = table(spark, root, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    dense = F.dense_rank().over(w)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.rank().over(w).cast("bigint").alias("min_rank"), dense.cast("bigint").alias("dense_rank"), F.greatest(F.lit(0), 4 - dense).cast("bigint").alias("bonus"))


def forward_mean(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    w = W.history_of("o_custkey", "o_orderdate", "o_orderkey")
    return orders.select("o_orderkey", "o_custkey", (W.forward_mean(cents("o_totalprice"), w, 5) / 100.0).alias("next5_price"))


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return W.latest_rows(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")


def next_n_nested(spark: SparkSession, root: str) -> DataFrame:
    """The first five lines of each order as a JSON list."""
    lines = table(spark, root, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("bigint").alias("q"), *[c for c in LINE_ORDER if c != "l_orderkey"])
    nested = W.nested_top_n(lines, ["l_orderkey"], [F.col("n"), F.col("p"), F.col("q"), *[F.col(c) for c in LINE_ORDER[3:]], F.col("l_shipdate")], 5, ["n", "p", "q"], "lines")
    return nested.select("l_orderkey", F.to_json("lines").alias("lines"))


def first_non_null(spark: SparkSession, root: str) -> DataFrame:
    """A customer's first known status that isn't P, and first priority that isn't low."""
    orders = table(spark, root, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    holes = orders.withColumns({"o_orderstatus": F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority": F.nullif("o_orderpriority", F.lit("5-LOW"))})
    return W.first_non_null(holes, ["o_custkey"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate", "o_orderkey"])


def dup_guard(spark: SparkSession, root: str) -> DataFrame:
    """Reports of the same player and fixture: which are duplicates, which is kept."""
    rows = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "fixture_id", "ingested_at")
    flagged = W.duplicate_flags(rows, ["player_id", "fixture_id"], [F.col("ingested_at").desc(), F.col("row_id").desc()])
    return flagged.where("is_duplicate").select("row_id", F.col("is_kept").cast("int").alias("is_kept"))


def player_features(spark: SparkSession, root: str) -> DataFrame:
    """Leak-free features of every player and fixture: trailing means, rates per 90, ratios, gaps and runs of starts.

    Every feature of the player shares one exchange and one sort; figures are summed as integers.
    """
    reports = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "fixture_id", "ingested_at", "minutes", "starts", "goals", "assists", "bps", "expected_goals")
    last = W.latest_rows(reports, ["player_id", "fixture_id"], ["ingested_at", "row_id"]).drop("row_id", "ingested_at")
    days = table(spark, root, "model_ready_dataset", "player_id", "fixture_id", "gameweek", "match_date")
    rows = last.join(days, ["player_id", "fixture_id"]).withColumn("x", F.round(F.col("expected_goals") * 100).cast("bigint"))
    order = ["gameweek", "match_date", "fixture_id"]
    rows = W.prior_streak(rows, F.col("starts") == 1, "player_id", order, "consecutive_starts")
    w = W.history_of("player_id", *order)
    out = {f"roll{n}_{s}": W.prior_mean(F.col(s), w, n) for n in (3, 5, 10) for s in ("minutes", "goals", "assists", "bps")}
    out |= {f"season_{s}": W.prior_mean(F.col(s), w) for s in ("minutes", "goals", "assists", "bps")}
    out |= {"roll5_goals_per90": W.prior_ratio(F.col("goals") * 90, F.col("minutes"), w, 5), "roll5_xg_per_goal": W.prior_ratio(F.col("x"), F.col("goals") * 100, w, 5), "season_goals_total": W.prior_sum(F.col("goals"), w).cast("bigint"), "days_since_last_game": W.days_since(F.col("match_date"), w).cast("bigint")}
    return rows.select("player_id", "fixture_id", F.col("consecutive_starts").cast("bigint").alias("consecutive_starts"), *[c.alias(n) for n, c in out.items()])


_ORDERS = "window w as (partition by o_custkey order by o_orderdate, o_orderkey)"
_LINES = ", ".join(LINE_ORDER)


def _mean_sql(value: str, by: str, order: str, frame: str) -> str:
    over = f"over (partition by {by} order by {order} rows between {frame})"
    return f"cast(sum({value}) {over} as double) / nullif(cast(count({value}) {over} as double), 0)"


def _player_features_sql() -> str:
    by, order = "player_id", "gameweek, match_date, fixture_id"
    columns = [f"{_mean_sql(s, by, order, f'{n} preceding and 1 preceding')} as roll{n}_{s}" for n in (3, 5, 10) for s in ("minutes", "goals", "assists", "bps")]
    columns += [f"{_mean_sql(s, by, order, 'unbounded preceding and 1 preceding')} as season_{s}" for s in ("minutes", "goals", "assists", "bps")]
    ratio = lambda a, b, n: f"cast(sum({a}) over (w rows between {n} preceding and 1 preceding) as double) / nullif(cast(sum({b}) over (w rows between {n} preceding and 1 preceding) as double), 0)"
    return f"""
with last as (select * from (select *, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1),
facts as (select l.player_id, l.fixture_id, l.minutes, l.starts, l.goals, l.assists, l.bps, m.gameweek, m.match_date,
    cast(round(case when isnan(l.expected_goals) then null else l.expected_goals end * 100) as bigint) as x, coalesce(cast(l.starts = 1 as int), 0) as f
    from last l join model_ready_dataset m on m.player_id = l.player_id and m.fixture_id = l.fixture_id),
runs as (select *, sum(1 - f) over (partition by player_id order by {order}) as i from facts),
streaks as (select *, sum(f) over (partition by player_id, i order by {order}) as s from runs)
select player_id, fixture_id, cast(coalesce(lag(s) over w, 0) as bigint) as consecutive_starts, {", ".join(columns)},
    {ratio("goals * 90", "minutes", 5)} as roll5_goals_per90, {ratio("x", "goals * 100", 5)} as roll5_xg_per_goal,
    cast(coalesce(sum(goals) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as season_goals_total,
    cast(match_date - lag(match_date) over w as bigint) as days_since_last_game
from streaks window w as (partition by player_id order by {order})"""


QUERIES = {
    "rolling_form": rolling_form, "per_period_ratio": per_period_ratio, "days_since_last": days_since_last, "start_streak": start_streak, "penalty_rank": penalty_rank,
    "rank_min_dense": rank_min_dense, "forward_mean": forward_mean, "latest_snapshot": latest_snapshot, "next_n_nested": next_n_nested, "first_non_null": first_non_null,
    "dup_guard": dup_guard, "player_features": player_features,
}

SQL = {
    "rolling_form": "with o as (select *, cast(round(o_totalprice * 100) as bigint) as c from orders) select o_orderkey, o_custkey, "
    + ", ".join(f"{_mean_sql('c', 'o_custkey', 'o_orderdate, o_orderkey', f'{n} preceding and 1 preceding')} / 100.0 as {name}" for n, name in ((3, "roll3_price"), (5, "roll5_price"), (10, "roll10_price"), ("unbounded", "season_price")))
    + " from o",
    "per_period_ratio": f"""
with l as (select *, cast(round(l_extendedprice * 100) as bigint) * cast(round(l_discount * 100) as bigint) as a, cast(l_quantity as bigint) as q from lineitem)
select l_partkey, l_orderkey, l_linenumber,
    cast(sum(a) over (w rows between 5 preceding and 1 preceding) as double) / nullif(cast(sum(q) over (w rows between 5 preceding and 1 preceding) as double), 0) as roll5_ratio,
    cast(sum(a) over (w rows between unbounded preceding and 1 preceding) as double) / nullif(cast(sum(q) over (w rows between unbounded preceding and 1 preceding) as double), 0) as season_ratio
from l window w as (partition by l_partkey order by {_LINES})""",
    "days_since_last": f"select o_orderkey, o_custkey, cast(date_diff('day', cast(lag(o_orderdate) over w as date), cast(o_orderdate as date)) as bigint) as days_since, cast(coalesce(month(o_orderdate) - month(lag(o_orderdate) over w), 7) * 7 as bigint) as pseudo_days from orders {_ORDERS}",
    "start_streak": """
with e as (select *, cast(event_type = 'click' as int) as f from events),
r as (select *, sum(1 - f) over (partition by user_id order by ts, event_id) as i from e),
s as (select *, sum(f) over (partition by user_id, i order by ts, event_id) as s from r)
select event_id, user_id, cast(coalesce(lag(s) over (partition by user_id order by ts, event_id), 0) as bigint) as streak from s""",
    "penalty_rank": """
with b as (select o_custkey, strftime(o_orderdate, '%Y-%m') as month, coalesce(sum(cast(o_orderpriority = '1-URGENT' as int)) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0) as u from orders),
e as (select o_custkey, month, max(u) as urgent_before from b group by 1, 2),
r as (select c_nationkey, month, o_custkey, urgent_before, row_number() over (partition by c_nationkey, month order by urgent_before desc, o_custkey) as place from e join customer on o_custkey = c_custkey)
select cast(c_nationkey as bigint) as c_nationkey, month, o_custkey, cast(urgent_before as bigint) as urgent_before, cast(place = 1 as int) as is_primary, cast(place = 2 as int) as is_backup from r where place <= 2 and urgent_before > 0""",
    "rank_min_dense": """select l_orderkey, l_linenumber, l_partkey, cast(rank() over w as bigint) as min_rank, cast(dense_rank() over w as bigint) as dense_rank, cast(greatest(0, 4 - dense_rank() over w) as bigint) as bonus
from lineitem window w as (partition by l_orderkey order by l_quantity desc)""",
    "forward_mean": f"select o_orderkey, o_custkey, cast(sum(c) over (w rows between current row and 4 following) as double) / cast(count(c) over (w rows between current row and 4 following) as double) / 100.0 as next5_price from (select *, cast(round(o_totalprice * 100) as bigint) as c from orders) {_ORDERS}",
    "latest_snapshot": "select o_custkey, o_orderkey, o_totalprice, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1",
    "next_n_nested": """
with l as (select l_orderkey, cast(l_linenumber as bigint) as n, l_partkey as p, cast(l_quantity as bigint) as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, cast(l_quantity as bigint), l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as place from lineitem)
select l_orderkey, '[' || string_agg('{"n":' || n || ',"p":' || p || ',"q":' || q || '}', ',' order by place) || ']' as lines from l where place <= 5 group by 1""",
    "first_non_null": "select o_custkey, arg_min(nullif(o_orderstatus, 'P'), row(o_orderdate, o_orderkey)) filter (where nullif(o_orderstatus, 'P') is not null) as o_orderstatus, arg_min(nullif(o_orderpriority, '5-LOW'), row(o_orderdate, o_orderkey)) filter (where nullif(o_orderpriority, '5-LOW') is not null) as o_orderpriority from orders group by 1",
    "dup_guard": "select row_id, cast(place = 1 as int) as is_kept from (select row_id, count(*) over (partition by player_id, fixture_id) as n, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) as place from fpl_clean_dataset) where n > 1",
    "player_features": _player_features_sql(),
}
