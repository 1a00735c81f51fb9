"""Join and set queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.functions import text as X
from tessara.operators import relate as R
from tessara.operators import summarize as S
from tessara.operators import windows as W
from tessara.plans.forms import cents
from tessara.sources.tables import table


def side_mirror(spark: SparkSession, root: str) -> DataFrame:
    """Quantity of each order and status, and that of the order's other status."""
    lines = table(spark, root, "lineitem", "l_orderkey", "l_linestatus", "l_quantity")
    sides = lines.groupBy("l_orderkey", "l_linestatus").agg(S.total(F.col("l_quantity").cast("bigint")).alias("quantity"))
    return R.mirror(sides, ["l_orderkey"], "l_linestatus", ["quantity"])


def side_log(spark: SparkSession, root: str) -> DataFrame:
    """One row for each fixture and side: its club by the mode of its rows' labels, totals, and the other side's totals."""
    rows = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "fixture_id", "was_home", "team", "minutes", "goals", "goals_conceded", "ingested_at")
    last = W.latest_rows(rows, ["player_id", "fixture_id"], ["ingested_at", "row_id"])
    labels = S.mode_labels(last, ["fixture_id", "was_home"], "team", "club").select("fixture_id", "was_home", "club", F.col("n_other").cast("bigint").alias("stale_labels"))
    totals = last.groupBy("fixture_id", "was_home").agg(S.total("goals").alias("goals"), F.max("goals_conceded").alias("conceded"))
    out = R.mirror(totals.join(labels, ["fixture_id", "was_home"]), ["fixture_id"], "was_home", ["club", "goals"])
    return out.select("fixture_id", F.col("was_home").cast("int").alias("was_home_int"), "club", "stale_labels", F.col("goals").cast("bigint").alias("goals"), F.col("conceded").cast("bigint").alias("conceded"), "opp_club", F.col("opp_goals").cast("bigint").alias("opp_goals"))


def opponent_context(spark: SparkSession, root: str) -> DataFrame:
    """Monthly sums of nations with the mean of their months before, attached to the nation they are paired with."""
    orders = table(spark, root, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, root, "customer", "c_custkey", "c_nationkey")
    monthly = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(cents("o_totalprice")).alias("c"))
    w = W.history_of("nation", "month")
    form = monthly.select("nation", "month", *[(W.prior_mean(F.col("c"), w, n) / 100.0).alias(f"roll{n}") for n in (3, 5)], (W.prior_mean(F.col("c"), w) / 100.0).alias("season"))
    other = form.select(((F.col("nation") + 12) % 25).alias("nation"), "month", *[F.col(c).alias(f"opp_{c}") for c in ("roll3", "roll5", "season")])
    out = form.withColumnsRenamed({c: f"own_{c}" for c in ("roll3", "roll5", "season")}).join(other, ["nation", "month"], "left")
    return out.withColumn("nation", F.col("nation").cast("bigint"))


def outer_indicator(spark: SparkSession, root: str) -> DataFrame:
    customers = table(spark, root, "customer", "c_nationkey").groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(F.count("*").alias("n_customers"))
    suppliers = table(spark, root, "supplier", "s_nationkey").groupBy(F.col("s_nationkey").cast("bigint").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return R.outer_with_indicator(customers, suppliers, ["nation"])


def semi_anti(spark: SparkSession, root: str) -> DataFrame:
    """Customers with an urgent order and those without, by segment."""
    customers = table(spark, root, "customer", "c_custkey", "c_mktsegment")
    urgent = table(spark, root, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    parts = [customers.join(urgent, "c_custkey", how).select("c_custkey", "c_mktsegment", F.lit(name).alias("kind")) for how, name in (("left_semi", "with"), ("left_anti", "without"))]
    return parts[0].unionByName(parts[1])


def fixture_expand(spark: SparkSession, root: str) -> DataFrame:
    """Each order once for its customer's side and once for its status' side, with the names of the first's segment."""
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderstatus").withColumns({"customer": F.col("o_custkey").cast("string"), "status": F.col("o_orderstatus")})
    sides = R.expand_sides(orders.select("o_orderkey", "o_custkey", "customer", "status"), {"home": {"own": "customer", "other": "status"}, "away": {"own": "status", "other": "customer"}}, "side")
    segments = table(spark, root, "customer", "c_custkey", "c_mktsegment")
    return sides.join(segments, sides["o_custkey"] == segments["c_custkey"], "left").select("o_orderkey", "side", "own", "other", "c_mktsegment")


def short_code_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Short codes of nations from two tables, attached to suppliers; a missing one is '?'."""
    nations = table(spark, root, "nation").where("n_nationkey % 5 <> 0")
    short = nations.withColumn("code", F.upper(F.concat(F.substring("n_name", 1, 1), F.substring_index("n_name", "_", -1))))
    lookup = R.union_lookup([(short.where("n_regionkey < 3"), "n_nationkey", "code"), (short.where("n_regionkey >= 2"), "n_nationkey", "code")], "s_nationkey", "code")
    suppliers = table(spark, root, "supplier", "s_suppkey", "s_nationkey")
    return R.coalesce_lookup(suppliers, lookup, ["s_nationkey"], "code", F.lit("?")).select("s_suppkey", "code")


def snapshot_diff(spark: SparkSession, root: str) -> DataFrame:
    """Positions and clubs of players at each gameweek against the one before: who came, who went, what changed."""
    rows = table(spark, root, "position_history", "row_id", "player_id", "gameweek", "position", "team", "recorded_at")
    last = W.latest_rows(rows, ["player_id", "gameweek"], ["recorded_at", "row_id"])
    out = R.snapshot_diff(last.withColumn("gameweek", F.col("gameweek") + 1), last, ["player_id", "gameweek"], ["position", "team"])
    return out.where("gameweek between 2 and 38")  # the first has none before it, and none comes after the last


def frozen_override(spark: SparkSession, root: str) -> DataFrame:
    """First-written positions of a player and gameweek, set into the report rows."""
    snapshots = table(spark, root, "position_history", "row_id", "player_id", "gameweek", "position", "recorded_at").where("position is not null")
    early, late = snapshots.where("gameweek <= 19"), snapshots.where("gameweek >= 19")
    frozen = R.first_write_wins(early, late, ["player_id", "gameweek"], ["recorded_at", "row_id"]).select("player_id", "gameweek", "position")
    rows = table(spark, root, "model_ready_dataset", "row_id", "player_id", "gameweek", "position")
    return R.frozen_override(rows, frozen, ["player_id", "gameweek"], "position").select("row_id", "position")


def _offers(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part", "p_partkey", "p_type", "p_size", "p_retailprice")
    return parts.select("p_partkey", "p_type", F.col("p_size").cast("bigint").alias("size"), cents("p_retailprice").alias("price"))


def best_swap(spark: SparkSession, root: str) -> DataFrame:
    """For each owned part (key divisible by 20) the part of its type, not owned and no dearer, of the greatest size."""
    offers = _offers(spark, root)
    asked, free = offers.where("p_partkey % 20 = 0"), offers.where("p_partkey % 20 <> 0")
    best = R.top_k_below(asked, free, "p_type", "price", "price", "size", "p_partkey", 1, 2_000)
    first = F.get("best", F.lit(0))
    return best.where(F.size("best") > 0).select("p_partkey", first["item"].alias("swap"), (first["value"] - F.col("size")).alias("gain"))


def affordable_top3(spark: SparkSession, root: str) -> DataFrame:
    """For each owned part the three best offers of its type for at most 10.00 more."""
    offers = _offers(spark, root)
    asked = offers.where("p_partkey % 20 = 0").withColumn("limit", F.col("price") + 1000)
    best = R.top_k_below(asked, offers.where("p_partkey % 20 <> 0"), "p_type", "limit", "price", "size", "p_partkey", 3, 2_000)
    return best.select("p_partkey", F.posexplode("best").alias("place", "x")).select("p_partkey", (F.col("place") + 1).cast("bigint").alias("place"), F.col("x.item").alias("offer"), F.col("x.value").alias("size"))


def staged_reconcile(spark: SparkSession, root: str) -> DataFrame:
    """Proposed names resolved to players: by name, then with the club."""
    proposals = table(spark, root, "entity_matching_table", "row_id", "fpl_full_name", "fpl_team").select("row_id", F.lower(F.trim("fpl_full_name")).alias("name"), F.col("fpl_team").alias("team"))
    players = table(spark, root, "fpl_clean_dataset", "player_id", "full_name", "team").select("player_id", F.lower(F.trim("full_name")).alias("name"), "team").distinct()
    return R.staged_reconcile(proposals, players, "row_id", "player_id", [["name"], ["name", "team"]]).withColumn("stage", F.col("stage").cast("bigint"))


def fuzzy_block(spark: SparkSession, root: str) -> DataFrame:
    """For each different part name the nearest other name with the same last word, by edit distance.

    Names are few words of a fixed vocabulary: distinct ones first, so that copies never meet.
    """
    names = table(spark, root, "part", "p_name").where("p_name is not null").distinct().withColumn("block", F.substring_index("p_name", " ", -1))
    other = names.select(F.col("p_name").alias("nearest"), "block")
    pairs = names.join(other, "block").where("p_name <> nearest").withColumn("distance", F.levenshtein("p_name", "nearest").cast("bigint"))
    best = pairs.groupBy("p_name").agg(F.min(F.struct("distance", "nearest")).alias("x"))
    return best.select("p_name", "x.nearest", "x.distance")


def normalise_names(spark: SparkSession, root: str) -> DataFrame:
    """Clubs of the first source split, trimmed and set to one form; the number of rows of each."""
    rows = table(spark, root, "understat_player_match_stats", "team").where("team is not null")
    clubs = rows.select(F.explode(X.parts(F.col("team"))).alias("club"))
    plain = F.regexp_replace(X.strict_name(F.col("club")), r"^(afc|fc) | (afc|fc)$", "")
    return clubs.select(X.alias(plain, {"kestrowick": "kestrowick vale"}).alias("club")).groupBy("club").agg(F.count("*").alias("n"))


def union_common(spark: SparkSession, root: str) -> DataFrame:
    """Customers and suppliers in the columns that both have, weighted by origin."""
    a = table(spark, root, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_mktsegment", F.lit(3.0).alias("weight"))
    b = table(spark, root, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit(1.0).alias("weight"))
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common)).withColumn("nation", F.col("nation").cast("bigint"))


def blank_double(spark: SparkSession, root: str) -> DataFrame:
    """Clubs and gameweeks without a match, or with two and more: every club of every gameweek there is."""
    sides = side_log(spark, root).select("fixture_id", F.col("club").alias("team")).where("team is not null")
    days = table(spark, root, "model_ready_dataset", "fixture_id", "gameweek").groupBy("fixture_id").agg(F.max("gameweek").alias("gameweek"))
    counts = sides.join(days, "fixture_id").groupBy("team", "gameweek").agg(F.count("*").alias("n"))
    weeks = table(spark, root, "gameweeks", "gameweek").agg(F.collect_set("gameweek").alias("weeks"))
    # a calendar: 38 gameweeks, for each club
    grid = sides.select("team").distinct().join(F.broadcast(weeks)).select("team", F.explode("weeks").alias("gameweek"))
    out = grid.join(counts, ["team", "gameweek"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where("n = 0 or n >= 2").select("team", F.col("gameweek").cast("bigint").alias("gameweek"), F.col("n").cast("bigint").alias("n"), F.when(F.col("n") == 0, "blank").otherwise("double").alias("kind"))


def cold_start(spark: SparkSession, root: str) -> DataFrame:
    """A prior for customers with fewer than three orders and a balance well above their segment's mean.

    The prior is the segment's mean order in cents times the balance ratio, held between 0.3 and 3.
    """
    customers = table(spark, root, "customer", "c_custkey", "c_mktsegment", "c_acctbal").withColumn("b", cents("c_acctbal"))
    orders = table(spark, root, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("c"))
    both = customers.join(orders, "c_custkey", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "c": F.coalesce("c", F.lit(0))})
    # one row for each of the few segments
    means = both.groupBy("c_mktsegment").agg((F.sum("b").cast("double") / F.count("*")).alias("mean_b"), (F.sum("c").cast("double") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_c"))
    ratio = F.try_divide(F.col("b").cast("double"), F.col("mean_b"))
    rated = both.join(means, "c_mktsegment").withColumn("ratio", ratio)
    return rated.where("n < 3 and ratio >= 1.15").select("c_custkey", (F.col("mean_c") * F.greatest(F.lit(0.3), F.least(F.lit(3.0), F.col("ratio")))).alias("prior"))


def league_fallback(spark: SparkSession, root: str) -> DataFrame:
    """Mean urgent order of each nation and segment; where there are fewer than ten, of the segment."""
    orders = table(spark, root, "orders", "o_custkey", "o_totalprice", "o_orderpriority").where("o_orderpriority = '1-URGENT'").withColumn("c", cents("o_totalprice"))
    customers = table(spark, root, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    sold = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    own = sold.groupBy("c_nationkey", "c_mktsegment").agg((F.sum("c").cast("double") / F.count("*")).alias("own"), F.count("*").alias("__n")).where(F.col("__n") >= 10).drop("__n")
    league = sold.groupBy("c_mktsegment").agg((F.sum("c").cast("double") / F.count("*")).alias("league"))
    groups = customers.select("c_nationkey", "c_mktsegment").distinct()
    out = groups.join(own, ["c_nationkey", "c_mktsegment"], "left").join(league, "c_mktsegment", "left")
    return out.select(F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_mktsegment", F.coalesce("own", "league").alias("mean_c"), F.col("own").isNull().cast("int").alias("is_fallback"))


QUERIES = {
    "side_mirror": side_mirror, "side_log": side_log, "opponent_context": opponent_context, "outer_indicator": outer_indicator, "semi_anti": semi_anti, "fixture_expand": fixture_expand,
    "short_code_lookup": short_code_lookup, "snapshot_diff": snapshot_diff, "frozen_override": frozen_override, "best_swap": best_swap, "affordable_top3": affordable_top3,
    "staged_reconcile": staged_reconcile, "fuzzy_block": fuzzy_block, "normalise_names": normalise_names, "union_common": union_common, "blank_double": blank_double,
    "cold_start": cold_start, "league_fallback": league_fallback,
}

_PARTS = "with p as (select p_partkey, p_type, cast(p_size as bigint) as size, cast(round(p_retailprice * 100) as bigint) as price from part)"

SQL = {
    "side_mirror": "with s as (select l_orderkey, l_linestatus, sum(cast(l_quantity as bigint)) as quantity from lineitem group by 1, 2) select a.l_orderkey, a.l_linestatus, cast(a.quantity as bigint) as quantity, cast(b.quantity as bigint) as opp_quantity from s a left join s b on a.l_orderkey = b.l_orderkey and a.l_linestatus <> b.l_linestatus",
    "side_log": """
with last as (select * from (select *, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1),
n as (select fixture_id, was_home, team, count(*) as n from last where team is not null group by all),
labels as (select fixture_id, was_home, team as club, total - n as stale from (select *, sum(n) over (partition by fixture_id, was_home) as total, row_number() over (partition by fixture_id, was_home order by n desc, team) as place from n) where place = 1),
t as (select fixture_id, was_home, coalesce(sum(goals), 0) as goals, max(goals_conceded) as conceded from last group by all),
s as (select t.*, club, stale from t join labels l on t.fixture_id = l.fixture_id and t.was_home = l.was_home)
select a.fixture_id, cast(a.was_home as int) as was_home_int, a.club, cast(a.stale as bigint) as stale_labels, cast(a.goals as bigint) as goals, cast(a.conceded as bigint) as conceded, b.club as opp_club, cast(b.goals as bigint) as opp_goals
from s a left join s b on a.fixture_id = b.fixture_id and a.was_home <> b.was_home""",
    "opponent_context": """
with m as (select c_nationkey as nation, strftime(o_orderdate, '%Y-%m') as month, sum(cast(round(o_totalprice * 100) as bigint)) as c from orders join customer on o_custkey = c_custkey group by 1, 2),
f as (select nation, month, cast(sum(c) over r3 as double) / nullif(cast(count(c) over r3 as double), 0) / 100.0 as roll3, cast(sum(c) over r5 as double) / nullif(cast(count(c) over r5 as double), 0) / 100.0 as roll5, cast(sum(c) over ra as double) / nullif(cast(count(c) over ra as double), 0) / 100.0 as season
  from m window r3 as (partition by nation order by month rows between 3 preceding and 1 preceding), r5 as (partition by nation order by month rows between 5 preceding and 1 preceding), ra as (partition by nation order by month rows between unbounded preceding and 1 preceding))
select cast(a.nation as bigint) as nation, a.month, a.roll3 as own_roll3, a.roll5 as own_roll5, a.season as own_season, b.roll3 as opp_roll3, b.roll5 as opp_roll5, b.season as opp_season
from f a left join f b on a.nation = (b.nation + 12) % 25 and a.month = b.month""",
    "outer_indicator": """
with c as (select cast(c_nationkey as bigint) as nation, count(*) as n_customers from customer group by 1), s as (select cast(s_nationkey as bigint) as nation, count(*) as n_suppliers from supplier group by 1)
select coalesce(c.nation, s.nation) as nation, n_customers, n_suppliers, case when c.nation is not null and s.nation is not null then 'both' when c.nation is not null then 'left' else 'right' end as found_in from c full join s on c.nation = s.nation""",
    "semi_anti": "select c_custkey, c_mktsegment, case when c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') then 'with' else 'without' end as kind from customer",
    "fixture_expand": """
with s as (select o_orderkey, o_custkey, 'home' as side, cast(o_custkey as varchar) as own, o_orderstatus as other from orders union all select o_orderkey, o_custkey, 'away', o_orderstatus, cast(o_custkey as varchar) from orders)
select o_orderkey, side, own, other, c_mktsegment from s left join customer on o_custkey = c_custkey""",
    "short_code_lookup": "select s_suppkey, case when s_nationkey % 5 = 0 then '?' else upper(substr(n_name, 1, 1) || split_part(n_name, '_', -1)) end as code from supplier left join nation on s_nationkey = n_nationkey",
    "snapshot_diff": """
with last as (select * from (select *, row_number() over (partition by player_id, gameweek order by recorded_at desc, row_id desc) rn from position_history) where rn = 1),
j as (select coalesce(a.player_id, b.player_id) as player_id, coalesce(a.gameweek + 1, b.gameweek) as gameweek, a.player_id is not null as in_a, b.player_id is not null as in_b, a.position as p0, b.position as p1, a.team as t0, b.team as t1 from last a full join last b on a.player_id = b.player_id and a.gameweek + 1 = b.gameweek),
k as (select * from j where gameweek between 2 and 38)
select player_id, gameweek, 'new' as change, '' as "column", null as before, null as after from k where not in_a
union all select player_id, gameweek, 'gone', '', null, null from k where not in_b
union all select player_id, gameweek, 'changed', 'position', p0, p1 from k where in_a and in_b and p0 is distinct from p1
union all select player_id, gameweek, 'changed', 'team', t0, t1 from k where in_a and in_b and t0 is distinct from t1""",
    "frozen_override": """
with h as (select *, 0 as s from position_history where position is not null and gameweek <= 19 union all select *, 1 from position_history where position is not null and gameweek >= 19),
frozen as (select player_id, gameweek, position from (select *, row_number() over (partition by player_id, gameweek order by s, recorded_at, row_id) rn from h) where rn = 1)
select m.row_id, coalesce(f.position, m.position) as position from model_ready_dataset m left join frozen f on f.player_id = m.player_id and f.gameweek = m.gameweek""",
    "best_swap": _PARTS + """, r as (select a.p_partkey, b.p_partkey as swap, b.size - a.size as gain, row_number() over (partition by a.p_partkey order by b.size desc, b.price, b.p_partkey) rn
from p a join p b on a.p_type = b.p_type and b.price <= a.price and b.p_partkey % 20 <> 0 where a.p_partkey % 20 = 0) select p_partkey, swap, gain from r where rn = 1""",
    "affordable_top3": _PARTS + """, r as (select a.p_partkey, b.p_partkey as offer, b.size, row_number() over (partition by a.p_partkey order by b.size desc, b.price, b.p_partkey) place
from p a join p b on a.p_type = b.p_type and b.price <= a.price + 1000 and b.p_partkey % 20 <> 0 where a.p_partkey % 20 = 0) select p_partkey, cast(place as bigint) as place, offer, size from r where place <= 3""",
    "staged_reconcile": """
with e as (select row_id, lower(trim(fpl_full_name)) as name, fpl_team as team from entity_matching_table), p as (select distinct player_id, lower(trim(full_name)) as name, team from fpl_clean_dataset),
one as (select name, min(player_id) as player_id from p where name is not null group by 1 having count(distinct player_id) = 1),
two as (select name, team, min(player_id) as player_id from p where name is not null and team is not null group by 1, 2 having count(distinct player_id) = 1)
select row_id, player_id, cast(1 as bigint) as stage from e join one using (name)
union all select row_id, player_id, 2 from e join two using (name, team) where name not in (select name from one)""",
    "fuzzy_block": """
with n as (select distinct p_name, split_part(p_name, ' ', -1) as block from part where p_name is not null),
r as (select a.p_name, b.p_name as nearest, levenshtein(a.p_name, b.p_name) as distance from n a join n b on a.block = b.block and a.p_name <> b.p_name)
select p_name, nearest, cast(distance as bigint) as distance from (select *, row_number() over (partition by p_name order by distance, nearest) rn from r) where rn = 1""",
    "normalise_names": r"""
with c as (select trim(unnest(string_split(team, ','))) as club from understat_player_match_stats where team is not null),
p as (select regexp_replace(trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(club)), '\s+', ' ', 'g')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), '^(afc|fc) | (afc|fc)$', '', 'g') as club from c where club <> '')
select case club when 'kestrowick' then 'kestrowick vale' else club end as club, count(*) as n from p group by 1""",
    "union_common": "select c_name as name, cast(c_nationkey as bigint) as nation, c_acctbal as balance, cast(3.0 as double) as weight from customer union all select s_name, s_nationkey, s_acctbal, 1.0 from supplier",
    "blank_double": """
with last as (select * from (select *, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1),
n as (select fixture_id, was_home, team, count(*) as n from last where team is not null group by all),
labels as (select fixture_id, team from (select *, row_number() over (partition by fixture_id, was_home order by n desc, team) as place from n) where place = 1),
d as (select fixture_id, max(gameweek) as gameweek from model_ready_dataset group by 1), k as (select team, gameweek, count(*) as n from labels join d using (fixture_id) group by 1, 2),
g as (select team, gameweeks.gameweek, coalesce(k.n, 0) as n from (select distinct team from labels) cross join gameweeks left join k using (team, gameweek))
select team, cast(gameweek as bigint) as gameweek, cast(n as bigint) as n, case when n = 0 then 'blank' else 'double' end as kind from g where n = 0 or n >= 2""",
    "cold_start": """
with o as (select o_custkey, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) as c from orders group by 1),
b as (select c_custkey, c_mktsegment, cast(round(c_acctbal * 100) as bigint) as b, coalesce(n, 0) as n, coalesce(c, 0) as c from customer left join o on o_custkey = c_custkey),
m as (select c_mktsegment, cast(sum(b) as double) / count(*) as mean_b, cast(sum(c) as double) / nullif(sum(n), 0) as mean_c from b group by 1),
r as (select c_custkey, n, mean_c, cast(b as double) / nullif(mean_b, 0) as ratio from b join m using (c_mktsegment))
select c_custkey, mean_c * greatest(0.3, least(3.0, ratio)) as prior from r where n < 3 and ratio >= 1.15""",
    "league_fallback": """
with s as (select c_nationkey, c_mktsegment, cast(round(o_totalprice * 100) as bigint) as c from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT'),
own as (select c_nationkey, c_mktsegment, cast(sum(c) as double) / count(*) as own from s group by 1, 2 having count(*) >= 10), league as (select c_mktsegment, cast(sum(c) as double) / count(*) as league from s group by 1),
g as (select distinct c_nationkey, c_mktsegment from customer)
select cast(g.c_nationkey as bigint) as c_nationkey, g.c_mktsegment, coalesce(own, league) as mean_c, cast(own is null as int) as is_fallback from g left join own on own.c_nationkey = g.c_nationkey and own.c_mktsegment = g.c_mktsegment left join league on league.c_mktsegment = g.c_mktsegment""",
}
