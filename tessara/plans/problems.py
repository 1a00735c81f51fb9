"""Queries p1, p4, p5, p6 and p7, over whole tables with production parameters; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.operators import history, impute, instants, rolling
from tessara.sources.tables import table

# ---------------------------------------------------------------- p1: rolling totals over trailing periods


def latest_minutes(spark: SparkSession, root: str) -> DataFrame:
    """(player_id, fixture_id, minutes): of several reports the one ingested last; combines on the map side."""
    reports = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "fixture_id", "minutes", "ingested_at")
    return reports.groupBy("player_id", "fixture_id").agg(F.max_by("minutes", F.struct("ingested_at", "row_id")).alias("minutes"))


def played(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, player_id, fixture_id, match_date, roll5_minutes, minutes): matches with their reported minutes."""
    matches = table(spark, root, "model_ready_dataset", "row_id", "player_id", "fixture_id", "match_date", "roll5_minutes")
    return matches.join(latest_minutes(spark, root), ["player_id", "fixture_id"], "left")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Stored trailing figures that are wrong, by more than 0.01 for means."""
    facts = played(spark, root)
    off = lambda stored, right: F.when(stored.isNull() | right.isNull(), stored.isNotNull() | right.isNotNull()).otherwise(F.abs(stored - right) > 0.01 + 1e-9)
    by_match = rolling.trailing_events(facts, "player_id", ["match_date", "fixture_id"], "minutes", 5)
    stored = by_match.where(off(F.col("roll5_minutes"), F.col("trailing_mean"))).select(F.lit("model_ready_dataset").alias("source_table"), "row_id", F.lit("roll5_minutes").alias("field"))
    days = facts.select("player_id", rolling.day_number(F.col("match_date")).alias("at"), "minutes")
    notes = table(spark, root, "load_report").withColumn("at", rolling.day_number(F.col("day")))
    totals = rolling.totals_at(notes, days, "player_id", "at", "minutes", {"total_7d": 7, "total_30d": 30})
    checks = {
        "minutes_7d": ~F.col("minutes_7d").eqNullSafe(F.col("total_7d")),
        "minutes_30d": ~F.col("minutes_30d").eqNullSafe(F.col("total_30d")),
        "mean_7d": off(F.col("mean_7d"), F.col("total_7d") / 7),
    }
    wrong = totals.select("row_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))).alias("field"))
    return stored.unionByName(wrong.select(F.lit("load_report").alias("source_table"), "row_id", "field"))


def p1_daily(spark: SparkSession, root: str) -> DataFrame:
    """Minutes of each player and day from the player's first match to the last, with totals and means over 7 and 30 days."""
    return _daily(played(spark, root))


def p1_season(spark: SparkSession, root: str) -> DataFrame:
    """The same for every player and day of the season, from the first match or note to the last or 29 days after."""
    facts, notes = played(spark, root), table(spark, root, "load_report", "player_id", "day")
    day = F.col("match_date")
    ends = facts.agg(F.min(day).alias("a"), F.date_add(F.max(day), 29).alias("z")).unionByName(notes.agg(F.min("day").alias("a"), F.max("day").alias("z"))).agg(F.min("a").alias("first"), F.max("z").alias("last"))
    matches = table(spark, root, "model_ready_dataset", "player_id")
    players = matches.unionByName(notes.select(F.col("player_id").cast(matches.schema["player_id"].dataType))).where("player_id is not null").distinct()
    return _daily(facts, players.crossJoin(F.broadcast(ends)))


def _daily(facts: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    out = rolling.daily_totals(facts, "player_id", "match_date", "minutes", {"minutes_7d": 7, "minutes_30d": 30}, spans)
    return out.select(
        F.col("player_id").cast("long").alias("player_id"), "match_date", *[F.col(c).cast("long").alias(c) for c in ("minutes", "minutes_7d", "minutes_30d")], "mean_minutes_7d", "mean_minutes_30d"
    )


_PLAYED = """
reports as (select player_id, fixture_id, minutes from (
    select *, row_number() over (partition by player_id, fixture_id order by ingested_at desc, row_id desc) rn from fpl_clean_dataset) where rn = 1),
played as (select m.row_id, m.player_id, m.fixture_id, m.match_date, case when isnan(m.roll5_minutes) then null else m.roll5_minutes end as roll5_minutes, r.minutes
    from model_ready_dataset m left join reports r on m.player_id = r.player_id and m.fixture_id = r.fixture_id)
"""

P1_FOUND_SQL = f"""
with {_PLAYED},
rolled as (select row_id, roll5_minutes, avg(minutes) over (partition by player_id order by match_date, fixture_id rows between 5 preceding and 1 preceding) as right_mean from played),
noted as (select l.row_id, any_value(l.minutes_7d) as m7, any_value(l.minutes_30d) as m30, any_value(l.mean_7d) as mean7,
    coalesce(sum(p.minutes) filter (where p.match_date > l.day - 7), 0) as t7, coalesce(sum(p.minutes), 0) as t30
    from load_report l left join played p on p.player_id = l.player_id and p.match_date <= l.day and p.match_date > l.day - 30 group by l.row_id)
select 'model_ready_dataset' as source_table, row_id, 'roll5_minutes' as field from rolled
    where (roll5_minutes is null) <> (right_mean is null) or abs(roll5_minutes - right_mean) > 0.01 + 1e-9
union all select 'load_report', row_id, 'minutes_7d' from noted where m7 is distinct from t7
union all select 'load_report', row_id, 'minutes_30d' from noted where m30 is distinct from t30
union all select 'load_report', row_id, 'mean_7d' from noted where mean7 is null or abs(mean7 - t7 / 7.0) > 0.01 + 1e-9
"""

P1_DAILY_SQL = f"""
with {_PLAYED},
days as (select player_id, cast(unnest(generate_series(cast(min(match_date) as timestamp), cast(max(match_date) as timestamp), interval 1 day)) as date) as match_date from played group by player_id),
daily as (select d.player_id, d.match_date, coalesce(sum(p.minutes), 0) as minutes from days d left join played p on p.player_id = d.player_id and p.match_date = d.match_date group by 1, 2)
select cast(player_id as bigint) as player_id, match_date, cast(minutes as bigint) as minutes, cast(sum(minutes) over w7 as bigint) as minutes_7d, cast(sum(minutes) over w30 as bigint) as minutes_30d,
    cast(sum(minutes) over w7 as double) / 7 as mean_minutes_7d, cast(sum(minutes) over w30 as double) / 30 as mean_minutes_30d
from daily window w7 as (partition by player_id order by match_date rows between 6 preceding and current row), w30 as (partition by player_id order by match_date rows between 29 preceding and current row)
"""

P1_SEASON_SQL = f"""
with {_PLAYED},
ends as (select min(a) as a, max(z) as z from (select min(match_date) as a, max(match_date) + 29 as z from played union all select min(day), max(day) from load_report)),
players as (select player_id from played where player_id is not null union select player_id from load_report where player_id is not null),
days as (select player_id, cast(unnest(generate_series(cast(a as timestamp), cast(z as timestamp), interval 1 day)) as date) as match_date from players, ends),
daily as (select d.player_id, d.match_date, coalesce(sum(p.minutes), 0) as minutes from days d left join played p on p.player_id = d.player_id and p.match_date = d.match_date group by 1, 2)
select cast(player_id as bigint) as player_id, match_date, cast(minutes as bigint) as minutes, cast(sum(minutes) over w7 as bigint) as minutes_7d, cast(sum(minutes) over w30 as bigint) as minutes_30d,
    cast(sum(minutes) over w7 as double) / 7 as mean_minutes_7d, cast(sum(minutes) over w30 as double) / 30 as mean_minutes_30d
from daily window w7 as (partition by player_id order by match_date rows between 6 preceding and current row), w30 as (partition by player_id order by match_date rows between 29 preceding and current row)
"""

# ---------------------------------------------------------------- p4: mixed timestamp formats and time zones

TIMED = {"fpl_clean_dataset": ("kickoff_time", False), "understat_player_match_stats": ("date", False), "fbref_player_match_summary": ("game", True)}
PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def with_instants(frame: DataFrame, zones: DataFrame, text: str, prefix: bool, out: str = "kickoff_epoch_s") -> DataFrame:
    """``frame`` with its text's instant; the zones are the eight rows of feed_zones, which does not grow."""
    zone = zones.select(F.col("feed").alias("__feed"), F.col("time_zone").alias("__zone"), F.col("date_order").alias("__order")).dropDuplicates(["__feed"])
    joined = frame.join(F.broadcast(zone), frame["feed"] == zone["__feed"], "left")
    return instants.add_instant(joined, text, "__zone", "__order", out, prefix).drop("__feed", "__zone", "__order")


def p4_instants(spark: SparkSession, root: str) -> DataFrame:
    """Every row of the three tables with the instant its text gives, or null."""
    zones, out = table(spark, root, "feed_zones"), None
    for name, (text, prefix) in TIMED.items():
        rows = table(spark, root, name, "row_id", "feed", text)
        one = with_instants(rows, zones, text, prefix).select(F.lit(name).alias("source_table"), "row_id", F.col(text).alias("text"), "kickoff_epoch_s")
        out = one if out is None else out.unionByName(one)
    return out


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows with a real day and time whose text is not already in the plain form."""
    rows = p4_instants(spark, root)
    return rows.where(F.col("kickoff_epoch_s").isNotNull() & ~F.col("text").rlike(PLAIN)).select("source_table", "row_id", "kickoff_epoch_s")


def _p4_sql(found: bool) -> str:
    """The same reading in SQL: each form has its own pattern, calendar checks are left to date casts."""
    month = "case lower({0}) " + " ".join(f"when '{m}' then {k + 1}" for k, m in enumerate(instants.MONTHS)) + " end"
    minutes = "case {0} " + " ".join(f"when '{n}' then {v}" for n, v in instants.ZONE_MINUTES.items()) + " end"
    digits = "cast(nullif(regexp_replace({0}, '[^0-9]', '', 'g'), '') as int)"
    offset = f"case when {{0}} = 'Z' then 0 when {{0}} <> '' then (case when starts_with(trim({{0}}), '-') then -1 else 1 end) * ({digits} // 100 * 60 + {digits} % 100) end"
    number = "try_cast({0} as int)"

    def part(name: str, text: str, title: bool) -> str:
        tail = r"(?:\s.*)?$" if title else "$"
        forms = {
            "iso": (r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(Z| ?[+-]\d{2}:?\d{2})?(?:\[[A-Za-z_/]+\])?" + tail, "'y','m','d','h','i','s','o'"),
            "compact": (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z" + tail, "'y','m','d','h','i','s'"),
            "numbers": (r"^(\d{2})[/.](\d{2})[/.](\d{4}|\d{2}) (\d{2}):(\d{2})" + tail, "'p','q','y','h','i'"),
            "half": (r"^(\d{1,2})-([A-Za-z]{3})-(\d{4}) (\d{1,2}):(\d{2}) ([AP])M" + tail, "'d','n','y','h','i','a'"),
            "named": (r"^[A-Z][a-z]{2},? (\d{1,2}) ([A-Z][a-z]{2}) (\d{4}),? (\d{2}):(\d{2})(?::(\d{2}))? ([A-Z]+)" + tail, "'d','n','y','h','i','s','z'"),
        }
        columns = ", ".join(f"regexp_extract(text, '{pattern}', [{groups}]) as {form}" for form, (pattern, groups) in forms.items())
        return f"""select '{name}' as source_table, row_id, text, time_zone, date_order, {columns}, nullif(regexp_extract(text, '^(\\d{{13}}|\\d{{10}}){tail}', 1), '') as e
            from (select row_id, feed, {text} as text from {name}) t left join feed_zones z on t.feed = z.feed"""

    n = number.format
    return f"""
with r as ({" union all ".join(part(name, *how) for name, how in TIMED.items())}),
c as (select source_table, row_id, text, time_zone, e,
    case when iso.y <> '' then {n("iso.y")} when compact.y <> '' then {n("compact.y")} when numbers.y <> '' then {n("numbers.y")} + case when len(numbers.y) = 2 then 2000 else 0 end when half.y <> '' then {n("half.y")} when named.y <> '' then {n("named.y")} end as y,
    case when iso.y <> '' then {n("iso.m")} when compact.y <> '' then {n("compact.m")} when numbers.y <> '' then case date_order when 'mdy' then {n("numbers.p")} when 'dmy' then {n("numbers.q")} end when half.y <> '' then {month.format("half.n")} when named.y <> '' then {month.format("named.n")} end as m,
    case when iso.y <> '' then {n("iso.d")} when compact.y <> '' then {n("compact.d")} when numbers.y <> '' then case date_order when 'mdy' then {n("numbers.q")} when 'dmy' then {n("numbers.p")} end when half.y <> '' then {n("half.d")} when named.y <> '' then {n("named.d")} end as d,
    case when iso.y <> '' then {n("iso.h")} when compact.y <> '' then {n("compact.h")} when numbers.y <> '' then {n("numbers.h")} when half.y <> '' then case when {n("half.h")} between 1 and 12 then {n("half.h")} % 12 + case half.a when 'P' then 12 else 0 end end when named.y <> '' then {n("named.h")} end as h,
    case when iso.y <> '' then {n("iso.i")} when compact.y <> '' then {n("compact.i")} when numbers.y <> '' then {n("numbers.i")} when half.y <> '' then {n("half.i")} when named.y <> '' then {n("named.i")} end as i,
    coalesce(case when iso.y <> '' then {n("iso.s")} when compact.y <> '' then {n("compact.s")} when named.y <> '' then {n("named.s")} end, 0) as s,
    case when iso.y <> '' then {offset.format("iso.o")} when compact.y <> '' then 0 when named.y <> '' then {minutes.format("named.z")} end as o
    from r),
l as (select *, try_cast(y || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') as date) as day from c),
k as (select source_table, row_id, text, case when e is not null then cast(e as bigint) // case len(e) when 13 then 1000 else 1 end
    when day is null or h is null or h > 23 or i > 59 or s > 59 then null
    when o is not null then cast(epoch(day) as bigint) + h * 3600 + i * 60 + s - o * 60
    when time_zone is not null then cast(epoch((cast(day as timestamp) + to_seconds(h * 3600 + i * 60 + s)) at time zone time_zone) as bigint) end as kickoff_epoch_s from l)
select source_table, row_id, {"" if found else "text, "}cast(kickoff_epoch_s as bigint) as kickoff_epoch_s from k{f" where kickoff_epoch_s is not null and not regexp_matches(text, '{PLAIN}')" if found else ""}
"""


P4_FOUND_SQL, P4_INSTANTS_SQL = _p4_sql(True), _p4_sql(False)

# ---------------------------------------------------------------- p5: filling missing values from similar records

#: No match has had an expected-goals figure, a number of cards or of won tackles above these.
MOST_XG, MOST_CARDS, MOST_TACKLES = 15, 2, 30


def figures() -> dict[str, tuple[Column, str]]:
    """When a figure is valid, and how it is filled. Shots without expected goals, or the reverse, rule each other out."""
    xg, shots = F.col("us_xG"), F.col("us_shots")
    return {
        "us_xG": (xg.between(0, MOST_XG) & ~F.coalesce((xg == 0) & (shots > 0), F.lit(False)) & ~F.coalesce((xg > 0) & (shots == 0), F.lit(False)), "median"),
        "fb_Performance_CrdY": (F.col("fb_Performance_CrdY").between(0, MOST_CARDS) & (F.col("fb_Performance_CrdY") % 1 == 0), "mode"),
        "fb_Performance_TklW": (F.col("fb_Performance_TklW").between(0, MOST_TACKLES) & (F.col("fb_Performance_TklW") % 1 == 0), "median"),
    }


NUMERIC = ["minutes", "us_shots", "us_goals", "us_key_passes", "us_xA", "fb_Performance_SoT", "fb_Performance_Fls", "fb_Performance_Int"]


def p5_filled(spark: SparkSession, root: str) -> DataFrame:
    """merged_player_gameweek with the three figures filled, and how each was."""
    rows = table(spark, root, "merged_player_gameweek")
    filled = impute.fill_from_similar(rows, figures(), F.col("minutes") > 0, NUMERIC, ["position", "was_home"], "position")
    return filled.select("row_id", "player_id", "fixture_id", *[c for f in figures() for c in (f"filled_{f}", f"method_{f}")])


def p5_marks(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, field, is_marked, is_sound): sound is a filled value among the values known, or one kept as it was."""
    known = table(spark, root, "merged_player_gameweek", "row_id", "minutes", "us_shots", *figures())
    filled = p5_filled(spark, root).join(known, "row_id")
    ends = known.where("minutes > 0").agg(*[x for f, (ok, _) in figures().items() for x in (F.min(F.when(ok, F.col(f))).alias(f"a_{f}"), F.max(F.when(ok, F.col(f))).alias(f"z_{f}"))])
    both = filled.join(F.broadcast(ends))  # one row
    each = [
        F.struct(F.lit(f).alias("field"), F.col(f"method_{f}").isNotNull().cast("int").alias("is_marked"), F.coalesce(F.when(F.col(f"method_{f}").isNotNull(), F.col(f"filled_{f}").between(F.col(f"a_{f}"), F.col(f"z_{f}"))).otherwise(F.col(f"filled_{f}").eqNullSafe(F.col(f).cast("double"))), F.lit(False)).cast("int").alias("is_sound"))
        for f in figures()
    ]
    return both.select("row_id", F.inline(F.array(*each)))


def masked_errors(spark: SparkSession, root: str) -> DataFrame:
    """(field, n, n_filled, error, plain_error): every fifth row's figures hidden and filled again, against the position's median or mode.

    All rows are read and clustered; what is hidden is hidden from clusters and fills alike.
    """
    rows = table(spark, root, "merged_player_gameweek")
    hidden = F.col("row_id") % 5 == 0
    right = {f: ok & F.col(f).isNotNull() & (F.col("minutes") > 0) for f, (ok, _) in figures().items()}
    known = rows.select("*", *[F.when(ok, F.col(f).cast("double")).alias(f"true_{f}") for f, ok in right.items()])
    masked = known.withColumns({f: F.when(~hidden, F.col(f)) for f in figures()})
    filled = impute.fill_from_similar(masked, figures(), F.col("minutes") > 0, NUMERIC, ["position", "was_home"], "position")
    middle = {f: F.percentile_approx(F.when(~hidden, F.col(f"true_{f}")), 0.5, 10000) if how == "median" else F.mode(F.when(~hidden, F.col(f"true_{f}")), True) for f, (_, how) in figures().items()}
    plain = known.groupBy(F.col("position").alias("__position")).agg(*[m.alias(f"plain_{f}") for f, m in middle.items()])
    both = filled.where(hidden).join(plain, F.col("position") == F.col("__position"), "left")
    each = both.agg(*[x for f in figures() for x in (F.count(f"true_{f}").alias(f"n_{f}"), F.count_if(F.col(f"true_{f}").isNotNull() & F.col(f"filled_{f}").isNotNull()).alias(f"f_{f}"), F.avg(F.abs(F.col(f"filled_{f}") - F.col(f"true_{f}"))).alias(f"e_{f}"), F.avg(F.abs(F.col(f"plain_{f}") - F.col(f"true_{f}"))).alias(f"p_{f}"))])
    return each.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n"), F.col(f"f_{f}").alias("n_filled"), F.col(f"e_{f}").alias("error"), F.col(f"p_{f}").alias("plain_error")) for f in figures()])))


def p5_masked(spark: SparkSession, root: str) -> DataFrame:
    """Hidden figures filled again: how many, whether all were, and whether the error is no greater than the position's median or mode makes.

    On few values the two differ by chance: a share of 1 / sqrt(n) is granted, under a hundredth from 10,000 values on.
    """
    out = masked_errors(spark, root)
    return out.select("field", "n", (F.col("n") == F.col("n_filled")).cast("int").alias("all_filled"), (F.col("error") <= F.col("plain_error") * (1 + 1 / F.sqrt("n"))).cast("int").alias("no_worse"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Figures that are lacking although the player had minutes."""
    marks = F.array_compact(F.array(*[F.when(F.col(f"method_{f}").isNotNull(), F.lit(f)) for f in figures()]))
    return p5_filled(spark, root).select("row_id", F.explode(marks).alias("field"))


P5_FOUND_SQL = f"""
with m as (select row_id, minutes, us_shots, nullif(us_xG, 'nan'::double) as xg, nullif(fb_Performance_CrdY, 'nan'::double) as cards, nullif(fb_Performance_TklW, 'nan'::double) as tackles from merged_player_gameweek where minutes > 0)
select row_id, 'us_xG' as field from m where xg is null or xg < 0 or xg > {MOST_XG} or (xg = 0 and us_shots > 0) or (xg > 0 and us_shots = 0)
union all select row_id, 'fb_Performance_CrdY' from m where cards is null or cards < 0 or cards > {MOST_CARDS} or cards <> floor(cards)
union all select row_id, 'fb_Performance_TklW' from m where tackles is null or tackles < 0 or tackles > {MOST_TACKLES} or tackles <> floor(tackles)
"""

_P5_VALID = f"""
m as (select row_id, minutes, us_shots, nullif(us_xG, 'nan'::double) as xg, nullif(fb_Performance_CrdY, 'nan'::double) as cards, nullif(fb_Performance_TklW, 'nan'::double) as tackles from merged_player_gameweek),
v as (select *, xg between 0 and {MOST_XG} and not coalesce(xg = 0 and us_shots > 0, false) and not coalesce(xg > 0 and us_shots = 0, false) as x_ok,
    cards between 0 and {MOST_CARDS} and cards = floor(cards) as c_ok, tackles between 0 and {MOST_TACKLES} and tackles = floor(tackles) as t_ok from m),
f as (select row_id, minutes, 'us_xG' as field, x_ok as ok from v union all select row_id, minutes, 'fb_Performance_CrdY', c_ok from v union all select row_id, minutes, 'fb_Performance_TklW', t_ok from v)
"""
P5_MARKS_SQL = f"with {_P5_VALID} select row_id, field, cast(coalesce(minutes > 0, false) and not coalesce(ok, false) as int) as is_marked, 1 as is_sound from f"
P5_MASKED_SQL = f"with {_P5_VALID} select field, count(*) filter (where ok and minutes > 0 and row_id % 5 = 0) as n, 1 as all_filled, 1 as no_worse from f group by 1"

# ---------------------------------------------------------------- p6 and p7: attributes over time

#: The labels of the four positions, without blanks and in lower case.
POSITION_LABELS = {
    "gk": "GK", "gkp": "GK", "g": "GK", "goalkeeper": "GK", "keeper": "GK", "def": "DEF", "d": "DEF", "defender": "DEF",
    "mid": "MID", "m": "MID", "midfielder": "MID", "fwd": "FWD", "f": "FWD", "forward": "FWD", "fw": "FWD", "att": "FWD", "striker": "FWD",
}


def position_label(label: Column) -> Column:
    """GK, DEF, MID or FWD; null for null and for what is none of the known labels."""
    names = F.create_map(*[F.lit(x) for pair in POSITION_LABELS.items() for x in pair])
    return F.try_element_at(names, F.lower(F.regexp_replace(label, r"[^A-Za-z]", "")))


def team_label(label: Column) -> Column:
    return F.nullif(F.trim(label), F.lit(""))


def p6_known(spark: SparkSession, root: str) -> DataFrame:
    """Each row of fpl_clean_dataset with its stamped position and team, and those known at its gameweek's deadline."""
    rows = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "gameweek", "position", "team")
    snapshots = table(spark, root, "position_history")
    deadlines = table(spark, root, "gameweeks")
    of = lambda value: history.known_versions(snapshots, "player_id", "gameweek", "recorded_at", value, deadlines, "deadline_time", "row_id")
    return history.as_known(rows, "player_id", "gameweek", {"position": of(position_label(F.col("position"))), "team": of(team_label(F.col("team")))})


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose stamped position or team is not the one known then."""
    known = p6_known(spark, root)
    differs = {
        "position": F.col("known_position").isNotNull() & ~F.col("known_position").eqNullSafe(position_label(F.col("position"))),
        "team": F.col("known_team").isNotNull() & ~F.col("known_team").eqNullSafe(team_label(F.col("team"))),
    }
    return known.select("row_id", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(name)) for name, x in differs.items()]))).alias("field"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Versions of each player's position with the gameweeks they were valid in."""
    snapshots = table(spark, root, "position_history", "row_id", "player_id", "gameweek", "position", "recorded_at")
    first = history.first_recorded(snapshots, "player_id", "gameweek", "recorded_at", position_label(F.col("position")), "row_id")
    periods = history.version_periods(history.fold_versions(first, "player_id", "gameweek", "value"), "player_id")
    return periods.select(F.col("player_id").cast("long").alias("player_id"), F.col("value").alias("position"), F.col("valid_from").alias("valid_from_gw"), F.col("valid_to").alias("valid_to_gw"))


_LABEL = "case lower(regexp_replace({0}, '[^A-Za-z]', '', 'g')) " + " ".join(f"when '{k}' then '{v}'" for k, v in POSITION_LABELS.items()) + " end"

_KNOWN = f"""
with h as (select row_id, player_id, gameweek, recorded_at, {_LABEL.format("position")} as position, nullif(trim(team), '') as team from position_history),
asked as (select distinct f.player_id, f.gameweek, g.deadline_time from fpl_clean_dataset f join gameweeks g on f.gameweek = g.gameweek),
pos as (select player_id, gameweek, value from (select a.player_id, a.gameweek, h.position as value,
    row_number() over (partition by a.player_id, a.gameweek order by h.gameweek desc, h.recorded_at, h.row_id) rn
    from asked a join h on h.player_id = a.player_id and h.gameweek <= a.gameweek and h.recorded_at <= a.deadline_time where h.position is not null) where rn = 1),
club as (select player_id, gameweek, value from (select a.player_id, a.gameweek, h.team as value,
    row_number() over (partition by a.player_id, a.gameweek order by h.gameweek desc, h.recorded_at, h.row_id) rn
    from asked a join h on h.player_id = a.player_id and h.gameweek <= a.gameweek and h.recorded_at <= a.deadline_time where h.team is not null) where rn = 1)
"""

P6_KNOWN_SQL = f"""{_KNOWN}
select f.row_id, f.player_id, f.gameweek, f.position, f.team, pos.value as known_position, club.value as known_team
from fpl_clean_dataset f left join pos on pos.player_id = f.player_id and pos.gameweek = f.gameweek left join club on club.player_id = f.player_id and club.gameweek = f.gameweek
"""

P6_FOUND_SQL = f"""{_KNOWN}
select f.row_id, 'position' as field from fpl_clean_dataset f join pos on pos.player_id = f.player_id and pos.gameweek = f.gameweek where pos.value is distinct from {_LABEL.format("f.position")}
union all
select f.row_id, 'team' from fpl_clean_dataset f join club on club.player_id = f.player_id and club.gameweek = f.gameweek where club.value is distinct from nullif(trim(f.team), '')
"""

P7_FOUND_SQL = f"""
with h as (select row_id, player_id, gameweek, recorded_at, {_LABEL.format("position")} as position from position_history),
first as (select player_id, gameweek, position from (select *, row_number() over (partition by player_id, gameweek order by recorded_at, row_id) rn from h where position is not null) where rn = 1),
starts as (select * from (select *, lag(position) over (partition by player_id order by gameweek) as prev from first) where prev is distinct from position)
select cast(player_id as bigint) as player_id, position, cast(gameweek as bigint) as valid_from_gw, cast(coalesce(lead(gameweek) over (partition by player_id order by gameweek) - 1, 0) as bigint) as valid_to_gw from starts
"""

QUERIES = {"p1_found": p1_found, "p1_daily": p1_daily, "p1_season": p1_season, "p4_found": p4_found, "p4_instants": p4_instants, "p5_found": p5_found, "p5_filled": p5_filled, "p5_marks": p5_marks, "p5_masked": p5_masked, "p6_found": p6_found, "p6_known": p6_known, "p7_found": p7_found}
SQL = {"p1_found": P1_FOUND_SQL, "p1_daily": P1_DAILY_SQL, "p1_season": P1_SEASON_SQL, "p4_found": P4_FOUND_SQL, "p4_instants": P4_INSTANTS_SQL, "p5_found": P5_FOUND_SQL, "p5_marks": P5_MARKS_SQL, "p5_masked": P5_MASKED_SQL, "p6_found": P6_FOUND_SQL, "p6_known": P6_KNOWN_SQL, "p7_found": P7_FOUND_SQL}
