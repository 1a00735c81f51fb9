"""Aggregate, evaluation and scalar-function queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.functions import numeric as N
from tessara.functions import text as X
from tessara.operators import summarize as S
from tessara.operators import windows as W
from tessara.plans.forms import cents
from tessara.sources.tables import table


def _predicted(spark: SparkSession, root: str) -> DataFrame:
    """Orders with the customer's mean before as a prediction, in whole cents (rounded down); first orders left out."""
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("actual", cents("o_totalprice"))
    w = W.history_of("o_custkey", "o_orderdate", "o_orderkey")
    rows = orders.withColumn("predicted", F.floor(W.prior_mean(F.col("actual"), w)).cast("bigint")).where("predicted is not null")
    segments = table(spark, root, "customer", "c_custkey", "c_mktsegment")
    return rows.join(segments, F.col("o_custkey") == F.col("c_custkey"))


_PREDICTED = """
o as (select *, cast(round(o_totalprice * 100) as bigint) as actual from orders),
q as (select *, cast(floor(cast(sum(actual) over w as double) / nullif(cast(count(actual) over w as double), 0)) as bigint) as predicted from o
    window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding)),
p as (select q.*, c_mktsegment from q join customer on o_custkey = c_custkey where predicted is not null)
"""


def _ratio(top: Column, n: Column) -> Column:
    return top.cast("double") / n.cast("double")


def split_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Error and bias on the last quarter of time, by segment and over all (rollup)."""
    rows = _predicted(spark, root).withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01")))
    cut = S.exact_quantiles(rows, [], "day", [0.75]).select(F.get("q", F.lit(0)).alias("cut"))
    test = rows.join(F.broadcast(cut)).where("day > cut")  # one row
    gap = F.col("predicted") - F.col("actual")
    out = test.rollup("c_mktsegment").agg(_ratio(F.sum(F.abs(gap)), F.count("*")).alias("mae"), _ratio(F.sum(gap), F.count("*")).alias("bias"), F.count("*").alias("n"))
    return out.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "mae", "bias", "n")


def multi_split(spark: SparkSession, root: str) -> DataFrame:
    """At six cutoffs of time the test error of two forecasts, the customer's mean before and the order before; the winner."""
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("actual", cents("o_totalprice"))
    w = W.history_of("o_custkey", "o_orderdate", "o_orderkey")
    rows = orders.select(F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"), "actual", F.floor(W.prior_mean(F.col("actual"), w)).cast("bigint").alias("mean"), F.lag("actual").over(w).alias("last")).where("last is not null")
    shares = (0.55, 0.6, 0.65, 0.7, 0.75, 0.8)
    cuts = S.exact_quantiles(rows, [], "day", list(shares), "cuts")
    each = rows.join(F.broadcast(cuts)).select("day", "actual", "mean", "last", F.posexplode("cuts").alias("split", "cut")).where("day > cut")
    error = each.groupBy("split").agg(F.count("*").alias("n"), _ratio(F.sum(F.abs(F.col("mean") - F.col("actual"))), F.count("*")).alias("mae_mean"), _ratio(F.sum(F.abs(F.col("last") - F.col("actual"))), F.count("*")).alias("mae_last"))
    return error.select(F.col("split").cast("bigint").alias("split"), "n", "mae_mean", "mae_last", F.when(F.col("mae_mean") <= F.least("mae_mean", "mae_last"), "mean").otherwise("last").alias("winner"))


def brier_calibration(spark: SparkSession, root: str) -> DataFrame:
    """Discount times ten as a probability that a line was returned: calibration in fixed bins."""
    lines = table(spark, root, "lineitem", "l_discount", "l_returnflag").select((F.round(F.col("l_discount") * 100).cast("bigint")).alias("d"), (F.col("l_returnflag") == "R").cast("bigint").alias("y"))
    # p = d / 10 in tenths; the sums stay integers
    return lines.where("d < 10").groupBy(F.col("d").alias("bin")).agg(F.count("*").alias("n"), _ratio(F.sum("d"), F.count("*") * 10).alias("mean_predicted"), _ratio(F.sum("y"), F.count("*")).alias("mean_actual"), _ratio(F.sum((F.col("d") - 10 * F.col("y")) * (F.col("d") - 10 * F.col("y"))), F.count("*") * 100).alias("brier"))


def qcut_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Quintiles of quantity, right-closed, with the mean price of each."""
    lines = table(spark, root, "lineitem", "l_quantity", "l_extendedprice")
    bucketed = S.quantile_buckets(lines, "l_quantity", 5, "bucket")
    return bucketed.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), _ratio(F.sum(cents("l_extendedprice")), F.count("*")).alias("mean_c"))


def disagreement_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Gap of two estimates of an order in percent, binned, with the one that was nearer more often."""
    rows = _predicted(spark, root).withColumn("base", F.lit(25_000_000).cast("bigint"))
    gap = F.floor(F.abs(F.col("predicted") - F.col("base")) * 100 / F.col("base"))
    bins = F.when(gap < 5, "00-05").when(gap < 10, "05-10").when(gap < 20, "10-20").when(gap < 30, "20-30").otherwise("30+")
    nearer = F.abs(F.col("predicted") - F.col("actual")) < F.abs(F.col("base") - F.col("actual"))
    out = rows.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.count_if(nearer).alias("n_first"))
    return out.withColumn("winner", F.when(F.col("n_first") * 2 > F.col("n"), "first").otherwise("second"))


def confusion_pr(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem", "l_returnflag", "l_quantity").select((F.col("l_returnflag") == "R").alias("actual"), (F.col("l_quantity") > 25).alias("predicted"))
    return S.confusion(lines, "actual", "predicted")


def confusion_pivot(spark: SparkSession, root: str) -> DataFrame:
    """Return flag against status as a pivot of counts."""
    lines = table(spark, root, "lineitem", "l_returnflag", "l_linestatus")
    return lines.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


def spearman(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem", "l_quantity", "l_extendedprice")
    return S.spearman(lines, "l_quantity", "l_extendedprice").select(F.round("spearman", 8).alias("spearman"), "n")


def corr_prune_inputs(spark: SparkSession, root: str) -> DataFrame:
    """Variances and all correlations of four figures, in one aggregate."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return S.pair_correlations(table(spark, root, "lineitem", *columns), columns).select("x", "y", F.round("r", 6).alias("r"))


def ownership_consensus(spark: SparkSession, root: str) -> DataFrame:
    """Four estimates of one total from four groups' sums over their slots, with median, mean and spread, by gameweek."""
    rows = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "fixture_id", "gameweek", "position", "selected", "ingested_at")
    last = W.latest_rows(rows, ["player_id", "gameweek"], ["ingested_at", "row_id"])
    slots = F.create_map(*[F.lit(x) for pair in {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}.items() for x in pair])
    each = last.groupBy("gameweek", "position").agg((F.sum("selected").cast("double") / F.try_element_at(slots, "position")).alias("estimate"))
    return each.groupBy("gameweek").agg(F.median("estimate").alias("median"), F.min("estimate").alias("least"), F.max("estimate").alias("most"), ((F.max("estimate") - F.min("estimate")) / F.median("estimate")).alias("spread"))


def top_n_overlap(spark: SparkSession, root: str) -> DataFrame:
    """How many of the 100 dearest parts are among the 100 largest."""
    return S.top_overlap(table(spark, root, "part", "p_partkey", "p_retailprice", "p_size"), "p_partkey", F.col("p_retailprice").desc(), F.col("p_size").desc(), 100)


def concentration(spark: SparkSession, root: str) -> DataFrame:
    """Nations with three and more suppliers, and the mean of their first five balances in order of key."""
    suppliers = table(spark, root, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").withColumn("c", cents("s_acctbal"))
    first = W.top_n(suppliers, ["s_nationkey"], [F.col("s_suppkey").asc()], 5).groupBy("s_nationkey").agg(_ratio(F.sum("c"), F.count("*")).alias("mean_first5"))
    many = suppliers.groupBy("s_nationkey").agg(F.count("*").alias("n")).where("n >= 3")
    return many.join(first, "s_nationkey").withColumn("s_nationkey", F.col("s_nationkey").cast("bigint"))


def underperformers(spark: SparkSession, root: str) -> DataFrame:
    """Customers below the 35th percentile of balances in their segment."""
    customers = table(spark, root, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    limits = S.exact_quantiles(customers, ["c_mktsegment"], "c_acctbal", [0.35]).select("c_mktsegment", F.get("q", F.lit(0)).alias("cut"))
    return customers.join(limits, "c_mktsegment").where("c_acctbal < cut").select("c_custkey", "c_mktsegment", F.round("cut", 6).alias("cut"))


def weighted_score(spark: SparkSession, root: str) -> DataFrame:
    """A rule of weights and steps over the figures of a report, which is data, not code."""
    rows = table(spark, root, "fpl_clean_dataset", "row_id", "minutes", "goals", "assists", "saves", "yellow_cards", "red_cards", "bonus")
    terms = [(F.col("minutes"), 1, 60), (F.col("goals"), 5, 1), (F.col("assists"), 3, 1), (F.col("saves"), 1, 3), (F.col("yellow_cards"), -1, 1), (F.col("red_cards"), -3, 1), (F.col("bonus"), 1, 1)]
    return rows.select("row_id", N.weighted_rule(terms).cast("bigint").alias("score"))


def gc_penalty(spark: SparkSession, root: str) -> DataFrame:
    """Chance of none and expected pairs of a Poisson count, for the rates that occur."""
    rates = table(spark, root, "lineitem", "l_quantity").select((F.col("l_quantity") / 10).alias("rate")).distinct()
    return rates.select("rate", F.round(N.none_of_poisson(F.col("rate")), 10).alias("p_none"), F.round(N.expected_halves(F.col("rate")), 10).alias("halves"))


def platt_apply(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem", "l_discount", "l_tax").select((F.col("l_discount") * 9).alias("p")).distinct()
    return lines.select(F.round("p", 6).alias("p"), F.round(N.platt(F.col("p"), 0.8, -0.2), 8).alias("calibrated"), F.round(N.clip(F.col("p"), 0.1, 0.5), 6).alias("clipped"))


def bonus_fallback(spark: SparkSession, root: str) -> DataFrame:
    """Mean returned quantity of each part; where a part has none, of its type if that has enough lines, else of all."""
    lines = table(spark, root, "lineitem", "l_partkey", "l_quantity", "l_returnflag").where("l_returnflag = 'R'")
    parts = table(spark, root, "part", "p_partkey", "p_type")
    sold = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    own = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(_ratio(F.sum(F.col("l_quantity").cast("bigint")), F.count("*")).alias("own"))
    every = sold.agg(_ratio(F.sum(F.col("l_quantity").cast("bigint")), F.count("*")).alias("overall"))
    kinds = sold.groupBy("p_type").agg(F.count("*").alias("n"), _ratio(F.sum(F.col("l_quantity").cast("bigint")), F.count("*")).alias("kind"))
    out = parts.join(own, "p_partkey", "left").join(kinds, "p_type", "left").join(F.broadcast(every))  # one row
    return out.select("p_partkey", F.coalesce(F.col("own"), F.when(F.col("n") >= 100, F.col("kind")), F.col("overall")).alias("bonus"))


def explain_contributions(spark: SparkSession, root: str) -> DataFrame:
    """Contributions to a line's price unpivoted, small ones left out, in order of size."""
    lines = table(spark, root, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    pct = lambda c: F.round(F.col(c) * 100).cast("bigint")
    wide = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.sum(-pct("l_discount")).alias("discount"), F.sum(pct("l_tax")).alias("tax"))
    long = wide.unpivot(["l_orderkey"], ["quantity", "discount", "tax"], "part", "value").where("abs(value) >= 15")
    return W.top_n(long, ["l_orderkey"], [F.abs("value").desc(), F.col("part")], 3).withColumn("place", F.col("place").cast("bigint"))


def flag_lists(spark: SparkSession, root: str) -> DataFrame:
    """Reasons to doubt a proposed match, as a list; rows without any have an empty one."""
    rows = table(spark, root, "entity_matching_table")
    flags = F.array_compact(F.array(F.when(F.coalesce("needs_review_understat", F.lit(False)), F.lit("understat")), F.when(F.coalesce("needs_review_fbref", F.lit(False)), F.lit("fbref")), F.when(F.col("understat_name").isNull() | F.col("fbref_name").isNull(), F.lit("absent"))))
    return rows.select("row_id", F.array_join(flags, ",").alias("reasons"))


def leak_audit(spark: SparkSession, root: str) -> DataFrame:
    """Share of players whose stored trailing mean never changes, and first rows that have one."""
    rows = table(spark, root, "model_ready_dataset", "player_id", "fixture_id", "match_date", "roll5_minutes")
    w = W.history_of("player_id", "match_date", "fixture_id")
    first = F.row_number().over(w) == 1
    each = rows.withColumn("first", first).groupBy("player_id").agg(F.countDistinct("roll5_minutes").alias("n_values"), F.count("*").alias("n"), F.count_if(F.col("first") & F.col("roll5_minutes").isNotNull()).alias("leaks"))
    return each.where("n >= 3").agg(F.count("*").alias("players"), F.count_if(F.col("n_values") <= 1).alias("constant"), F.sum("leaks").alias("first_row_leaks"))


def json_props(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events", "event_type", "props")
    k = F.from_json("props", "k INT")["k"]
    return events.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).cast("bigint").alias("total"), F.max(k).cast("bigint").alias("most"))


def value_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "position_history", "position").where("position is not null").groupBy("position").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "position")


def describe(spark: SparkSession, root: str) -> DataFrame:
    """Number, mean, extremes and quartiles of minutes, by position."""
    rows = table(spark, root, "fpl_clean_dataset", "position", "minutes")
    q = S.exact_quantiles(rows, ["position"], "minutes", [0.25, 0.5, 0.75]).withColumnRenamed("position", "__position")
    out = rows.groupBy("position").agg(F.count("minutes").alias("n"), _ratio(F.sum("minutes"), F.count("minutes")).alias("mean"), F.round(F.stddev_samp("minutes"), 6).alias("std"), F.min("minutes").cast("bigint").alias("least"), F.max("minutes").cast("bigint").alias("most"))
    out = out.join(q, F.col("position").eqNullSafe(F.col("__position")), "left")
    return out.select("position", "n", "mean", "std", "least", "most", *[F.get("q", F.lit(k)).alias(f"q{25 * (k + 1)}") for k in range(3)])


def merge_coverage(spark: SparkSession, root: str) -> DataFrame:
    """How many rows with minutes have figures of either source, and of both."""
    rows = table(spark, root, "merged_player_gameweek", "minutes", "us_minutes", "fb_min").where("minutes > 0")
    return S.coverage(rows, {"n_us": F.col("us_minutes").isNotNull(), "n_fb": F.col("fb_min").isNotNull(), "n_both": F.col("us_minutes").isNotNull() & F.col("fb_min").isNotNull()})


def identical_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Parts of the same type, size and brand, with the first three of each group."""
    parts = table(spark, root, "part", "p_partkey", "p_type", "p_size", "p_brand").withColumn("key", F.concat_ws("-", "p_type", "p_size", "p_brand"))
    named = parts.withColumn("name", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return S.identical_groups(named, ["key"], "name")


def top_share(spark: SparkSession, root: str) -> DataFrame:
    """Share of all sales that the 15 largest customers hold."""
    orders = table(spark, root, "orders", "o_custkey", "o_totalprice").withColumn("c", cents("o_totalprice"))
    return S.top_share(orders, "o_custkey", "c", 15).select(F.round("share", 12).alias("share"))


def two_populations(spark: SparkSession, root: str) -> DataFrame:
    """Mean quantity of discounted and other lines by mode of status: difference and percent, in one aggregate."""
    lines = table(spark, root, "lineitem", "l_linestatus", "l_discount", "l_quantity")
    q, off = F.col("l_quantity").cast("bigint"), F.col("l_discount") >= 0.05
    mean = lambda c: _ratio(F.sum(F.when(c, q)), F.count_if(c))
    out = lines.groupBy("l_linestatus").agg(mean(off).alias("discounted"), mean(~off).alias("others"))
    return out.select("*", (F.col("discounted") - F.col("others")).alias("difference"), ((F.col("discounted") / F.col("others") - 1) * 100).alias("percent"))


def search_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents that mention a word, literally and in any case."""
    documents = table(spark, root, "documents", "doc_id", "text")
    return documents.where(X.contains_word(F.col("text"), "Wildcard")).select("doc_id")


def markup_stats(spark: SparkSession, root: str) -> DataFrame:
    """Tags in documents, and the numbers of the first link."""
    documents = table(spark, root, "documents", "doc_id", "text")
    out = documents.select("doc_id", F.regexp_count("text", F.lit("<span>")).cast("bigint").alias("spans"), F.regexp_count("text", F.lit("<a ")).cast("bigint").alias("links"), X.number_after(F.col("text"), r"<a href=\"#[a-z]+\">(\d+)</a>").alias("first_link"))
    return out.where("spans > 0")


QUERIES = {
    f.__name__: f
    for f in (
        split_metrics, multi_split, brier_calibration, qcut_buckets, disagreement_buckets, confusion_pr, confusion_pivot, spearman, corr_prune_inputs, ownership_consensus, top_n_overlap,
        concentration, underperformers, weighted_score, gc_penalty, platt_apply, bonus_fallback, explain_contributions, flag_lists, leak_audit, json_props, value_counts, describe,
        merge_coverage, identical_ranges, top_share, two_populations, search_documents, markup_stats,
    )
}

SQL = {
    "split_metrics": f"""with {_PREDICTED}, d as (select *, cast(o_orderdate as date) - date '1970-01-01' as day from p), t as (select * from d where day > (select quantile_cont(day, 0.75) from d))
select coalesce(c_mktsegment, 'all') as segment, cast(sum(abs(predicted - actual)) as double) / count(*) as mae, cast(sum(predicted - actual) as double) / count(*) as bias, count(*) as n from t group by rollup (c_mktsegment)""",
    "multi_split": """
with o as (select *, cast(round(o_totalprice * 100) as bigint) as actual, cast(o_orderdate as date) - date '1970-01-01' as day from orders),
q as (select day, actual, cast(floor(cast(sum(actual) over (w rows between unbounded preceding and 1 preceding) as double) / nullif(cast(count(actual) over (w rows between unbounded preceding and 1 preceding) as double), 0)) as bigint) as mean, lag(actual) over w as last
    from o window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
r as (select * from q where last is not null),
c as (select unnest([0, 1, 2, 3, 4, 5]) as split, unnest(quantile_cont(day, [0.55, 0.6, 0.65, 0.7, 0.75, 0.8])) as cut from r),
e as (select split, count(*) as n, cast(sum(abs(mean - actual)) as double) / count(*) as mae_mean, cast(sum(abs(last - actual)) as double) / count(*) as mae_last from r join c on day > cut group by split)
select cast(split as bigint) as split, n, mae_mean, mae_last, case when mae_mean <= mae_last then 'mean' else 'last' end as winner from e""",
    "brier_calibration": """
with l as (select cast(round(l_discount * 100) as bigint) as d, cast(l_returnflag = 'R' as bigint) as y from lineitem)
select d as bin, count(*) as n, cast(sum(d) as double) / (count(*) * 10) as mean_predicted, cast(sum(y) as double) / count(*) as mean_actual, cast(sum((d - 10 * y) * (d - 10 * y)) as double) / (count(*) * 100) as brier from l where d < 10 group by d""",
    "qcut_buckets": """
with e as (select list_sort(list_distinct(quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as e from lineitem),
b as (select cast(round(l_extendedprice * 100) as bigint) as c, case when l_quantity = e[1] then 0 else len(list_filter(e, lambda x: x < l_quantity)) - 1 end as bucket from lineitem, e)
select cast(bucket as bigint) as bucket, count(*) as n, cast(sum(c) as double) / count(*) as mean_c from b group by 1""",
    "disagreement_buckets": f"""with {_PREDICTED}, g as (select *, floor(abs(predicted - 25000000) * 100 / 25000000) as gap from p),
b as (select case when gap < 5 then '00-05' when gap < 10 then '05-10' when gap < 20 then '10-20' when gap < 30 then '20-30' else '30+' end as bin, abs(predicted - actual) < abs(25000000 - actual) as nearer from g)
select bin, count(*) as n, count(*) filter (where nearer) as n_first, case when count(*) filter (where nearer) * 2 > count(*) then 'first' else 'second' end as winner from b group by 1""",
    "confusion_pr": """
with l as (select l_returnflag = 'R' as a, l_quantity > 25 as p from lineitem), c as (select count(*) filter (where a and p) as tp, count(*) filter (where not a and p) as fp, count(*) filter (where a and not p) as fn, count(*) filter (where not a and not p) as tn from l)
select *, cast(tp as double) / greatest(tp + fp, 1) as precision, cast(tp as double) / greatest(tp + fn, 1) as recall from c""",
    "confusion_pivot": "select l_returnflag, count(*) filter (where l_linestatus = 'F') as \"F\", count(*) filter (where l_linestatus = 'O') as \"O\" from lineitem group by 1",
    "spearman": """
with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rx, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as ry from lineitem where l_quantity is not null and l_extendedprice is not null)
select round(corr(rx, ry), 8) as spearman, count(*) as n from r""",
    "corr_prune_inputs": " union all ".join(
        [f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as r from lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))]
        + [f"select '{a}', '{a}', round(var_samp({a}), 6) from lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    ),
    "ownership_consensus": """
with last as (select * from (select *, row_number() over (partition by player_id, gameweek order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1),
e as (select gameweek, position, cast(sum(selected) as double) / case position when 'GK' then 2 when 'DEF' then 5 when 'MID' then 5 when 'FWD' then 3 end as estimate from last group by 1, 2)
select gameweek, median(estimate) as median, min(estimate) as least, max(estimate) as most, (max(estimate) - min(estimate)) / median(estimate) as spread from e group by 1""",
    "top_n_overlap": """
with a as (select p_partkey from part order by p_retailprice desc, p_partkey limit 100), b as (select p_partkey from part order by p_size desc, p_partkey limit 100)
select count(*) as n_common, cast(count(*) as double) / 100 as share from a where p_partkey in (select p_partkey from b)""",
    "concentration": """
with s as (select s_nationkey, cast(round(s_acctbal * 100) as bigint) as c, row_number() over (partition by s_nationkey order by s_suppkey) as place from supplier)
select cast(s_nationkey as bigint) as s_nationkey, count(*) as n, cast(sum(c) filter (where place <= 5) as double) / count(*) filter (where place <= 5) as mean_first5 from s group by 1 having count(*) >= 3""",
    "underperformers": """with q as (select c_mktsegment, quantile_cont(c_acctbal, 0.35) as cut from customer group by 1) select c_custkey, c_mktsegment, round(cut, 6) as cut from customer join q using (c_mktsegment) where c_acctbal < cut""",
    "weighted_score": """select row_id, cast(floor(coalesce(minutes, 0) / 60.0) + 5 * coalesce(goals, 0) + 3 * coalesce(assists, 0) + floor(coalesce(saves, 0) / 3.0) - coalesce(yellow_cards, 0) - 3 * coalesce(red_cards, 0) + coalesce(bonus, 0) as bigint) as score from fpl_clean_dataset""",
    "gc_penalty": "with r as (select distinct l_quantity / 10 as rate from lineitem) select rate, round(exp(-rate), 10) as p_none, round(rate / 2 - (1 - exp(-2 * rate)) / 4, 10) as halves from r",
    "platt_apply": """
with l as (select distinct l_discount * 9 as p from lineitem), c as (select p, greatest(1e-6, least(1 - 1e-6, p)) as q from l)
select round(p, 6) as p, round(1 / (1 + exp(-(ln(q / (1 - q)) * 0.8 - 0.2))), 8) as calibrated, round(greatest(0.1, least(0.5, p)), 6) as clipped from c""",
    "bonus_fallback": """
with l as (select l_partkey, cast(l_quantity as bigint) as q from lineitem where l_returnflag = 'R'),
own as (select l_partkey, cast(sum(q) as double) / count(*) as own from l group by 1), kinds as (select p_type, count(*) as n, cast(sum(q) as double) / count(*) as kind from l join part on l_partkey = p_partkey group by 1),
every as (select cast(sum(q) as double) / count(*) as overall from l join part on l_partkey = p_partkey)
select part.p_partkey, coalesce(own, case when n >= 100 then kind end, overall) as bonus from part left join own on own.l_partkey = part.p_partkey left join kinds on kinds.p_type = part.p_type cross join every""",
    "explain_contributions": """
with w as (select l_orderkey, sum(cast(l_quantity as bigint)) as quantity, sum(-cast(round(l_discount * 100) as bigint)) as discount, sum(cast(round(l_tax * 100) as bigint)) as tax from lineitem group by 1),
u as (select l_orderkey, 'quantity' as part, cast(quantity as bigint) as value from w union all select l_orderkey, 'discount', cast(discount as bigint) from w union all select l_orderkey, 'tax', cast(tax as bigint) from w)
select * from (select *, row_number() over (partition by l_orderkey order by abs(value) desc, part) as place from u where abs(value) >= 15)""",
    "flag_lists": "select row_id, concat_ws(',', case when needs_review_understat then 'understat' end, case when needs_review_fbref then 'fbref' end, case when understat_name is null or fbref_name is null then 'absent' end) as reasons from entity_matching_table",
    "leak_audit": """
with m as (select player_id, nullif(roll5_minutes, 'nan'::double) as r, row_number() over (partition by player_id order by match_date, fixture_id) as place from model_ready_dataset),
e as (select player_id, count(distinct r) as n_values, count(*) as n, count(*) filter (where place = 1 and r is not null) as leaks from m group by 1)
select count(*) as players, count(*) filter (where n_values <= 1) as constant, cast(sum(leaks) as bigint) as first_row_leaks from e where n >= 3""",
    "json_props": "with e as (select event_type, cast(json_extract(props, '$.k') as int) as k from events) select event_type, count(k) as n, cast(sum(k) as bigint) as total, cast(max(k) as bigint) as most from e group by 1",
    "value_counts": "select position, count(*) as n from position_history where position is not null group by 1",
    "describe": """select position, count(minutes) as n, cast(sum(minutes) as double) / count(minutes) as mean, round(stddev_samp(minutes), 6) as std, cast(min(minutes) as bigint) as least, cast(max(minutes) as bigint) as most,
    quantile_cont(minutes, 0.25) as q25, quantile_cont(minutes, 0.5) as q50, quantile_cont(minutes, 0.75) as q75 from fpl_clean_dataset group by 1""",
    "merge_coverage": "select count(*) as n_rows, count(us_minutes) as n_us, count(fb_min) as n_fb, count(*) filter (where us_minutes is not null and fb_min is not null) as n_both from merged_player_gameweek where minutes > 0",
    "identical_ranges": """
with p as (select p_type || '-' || p_size || '-' || p_brand as key, lpad(cast(p_partkey as varchar), 9, '0') as name from part), r as (select *, row_number() over (partition by key order by name) as place from p)
select key, count(*) as n, string_agg(name, ',' order by name) filter (where place <= 3) as names from r group by 1 having count(*) >= 2""",
    "top_share": """
with e as (select o_custkey, sum(cast(round(o_totalprice * 100) as bigint)) as v from orders group by 1), t as (select v from e order by v desc, o_custkey limit 15)
select round(cast((select sum(v) from t) as double) / cast((select sum(v) from e) as double), 12) as share""",
    "two_populations": """
with l as (select l_linestatus, cast(l_quantity as bigint) as q, l_discount >= 0.05 as off from lineitem),
m as (select l_linestatus, cast(sum(q) filter (where off) as double) / count(*) filter (where off) as discounted, cast(sum(q) filter (where not off) as double) / count(*) filter (where not off) as others from l group by 1)
select *, discounted - others as difference, (discounted / others - 1) * 100 as percent from m""",
    "search_documents": "select doc_id from documents where contains(lower(text), 'wildcard')",
    "markup_stats": r"""
with d as (select doc_id, len(regexp_extract_all(text, '<span>')) as spans, len(regexp_extract_all(text, '<a ')) as links, try_cast(nullif(regexp_extract(text, '<a href="#[a-z]+">(\d+)</a>', 1), '') as double) as first_link from documents where text is not null)
select doc_id, cast(spans as bigint) as spans, cast(links as bigint) as links, first_link from d where spans > 0""",
}
