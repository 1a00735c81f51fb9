"""Change histories of entity attributes, and attributes as known at the time of an event.

Both start with one row for each (entity, period): the first recorded. That aggregate combines on the map side, so a
hot entity shrinks to one row for each of its periods before anything is gathered, and the array folded for an entity is
no longer than its number of distinct periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_recorded(snapshots: DataFrame, entity: str, period: str, recorded: str, value: Column, tie: str | None = None) -> DataFrame:
    """(entity, period, value, recorded): of an entity's values of a period the first recorded.

    Rows without entity, period or value do not count. A null ``recorded`` comes after all others; rows recorded at
    the same time are ordered by ``tie`` (a unique column), else by their value.
    """
    last = F.to_timestamp(F.lit("9999-01-01 00:00:00"))
    order = F.struct(F.coalesce(F.col(recorded).cast("timestamp"), last), F.col(tie) if tie else value)
    return (
        snapshots.select(F.col(entity).alias("e"), F.col(period).cast("long").alias("p"), F.struct(value.alias("v"), F.col(recorded).cast("timestamp").alias("r")).alias("x"), order.alias("o"))
        .where(F.col("e").isNotNull() & F.col("p").isNotNull() & F.col("x.v").isNotNull())
        .groupBy("e", "p")
        .agg(F.min_by("x", "o").alias("x"))
        .select(F.col("e").alias(entity), F.col("p").alias(period), F.col("x.v").alias("value"), F.col("x.r").alias(recorded))
    )


def fold_versions(rows: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """(entity, versions): an array of (period, value), one element for each change, in order of the period.

    The sorted array of an entity is folded by a higher-order function that appends an element only if its value
    differs from the last one's.
    """
    kind = rows.schema[value].dataType.simpleString()
    empty = F.array().cast(f"array<struct<from:bigint,value:{kind}>>")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(period).cast("long").alias("from"), F.col(value).alias("value"))))
    fold = F.aggregate(
        "__all",
        empty,
        lambda kept, x: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["value"] == x["value"]), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return rows.groupBy(entity).agg(ordered.alias("__all")).select(entity, fold.alias("versions"))


def version_periods(folded: DataFrame, entity: str) -> DataFrame:
    """(entity, value, valid_from, valid_to): folded versions, exploded with their last period; 0 for the open one."""
    spans = F.transform(
        "versions",
        lambda x, i: F.struct(
            x["value"].alias("value"),
            x["from"].alias("valid_from"),
            F.coalesce(F.get(F.transform("versions", lambda y: y["from"]), i + 1) - 1, F.lit(0).cast("long")).alias("valid_to"),
        ),
    )
    return folded.select(entity, F.explode(spans).alias("x")).select(entity, "x.*")


def known_versions(snapshots: DataFrame, entity: str, period: str, recorded: str, value: Column, deadlines: DataFrame, deadline: str, tie: str | None = None) -> DataFrame:
    """(entity, versions): for one attribute, what was known from which period on.

    At the deadline of a period, of the snapshots not of a later period and recorded by then, the one of the greatest
    period counts, and of those the first recorded. A row thus becomes visible at the first period, not before its own,
    whose deadline is not before its recording. A version is kept only if it is visible before every row of a later
    period, and differs from the one before.

    ``deadlines``: (period, deadline), a small calendar that does not grow with the data; it is broadcast as one row.
    """
    first = first_recorded(snapshots, entity, period, recorded, value, tie)
    calendar = deadlines.select(F.col(period).cast("long").alias("p"), F.col(deadline).cast("timestamp").alias("d")).where("p is not null and d is not null").agg(F.array_sort(F.collect_list(F.struct("p", "d"))).alias("__calendar"))
    seen = F.filter("__calendar", lambda c: (c["p"] >= F.col(period)) & (c["d"] >= F.col(recorded)))
    visible = (
        first.join(F.broadcast(calendar))
        .select(entity, F.array_min(F.transform(seen, lambda c: c["p"])).alias("__from"), F.col(period).alias("__of"), "value")
        .where(F.col("__from").isNotNull())
    )
    kind = visible.schema["value"].dataType.simpleString()
    shape = f"struct<of:bigint,kept:array<struct<from:bigint,value:{kind}>>>"
    ordered = F.array_sort(F.collect_list(F.struct(F.col("__from").alias("from"), F.col("__of").alias("of"), F.col("value").alias("value"))))

    def step(s: Column, x: Column) -> Column:
        last = F.element_at(s["kept"], -1)
        new = F.struct(x["from"].alias("from"), x["value"].alias("value"))
        same = (F.size(s["kept"]) > 0) & (last["value"] == x["value"])
        again = (F.size(s["kept"]) > 0) & (last["from"] == x["from"])  # of rows that become visible together the later period's counts
        kept = F.when(same, s["kept"]).when(again, F.concat(F.slice(s["kept"], 1, F.size(s["kept"]) - 1), F.array(new))).otherwise(F.concat(s["kept"], F.array(new)))
        return F.when(x["of"] > s["of"], F.struct(x["of"].alias("of"), kept.alias("kept")).cast(shape)).otherwise(s)

    start = F.struct(F.lit(-(2**62)).cast("long").alias("of"), F.array().cast(f"array<struct<from:bigint,value:{kind}>>").alias("kept")).cast(shape)
    return visible.groupBy(entity).agg(ordered.alias("__all")).select(entity, F.aggregate("__all", start, step, lambda s: s["kept"]).alias("versions"))


def as_known(events: DataFrame, entity: str, period: str, histories: dict[str, DataFrame]) -> DataFrame:
    """``events`` with a column for each attribute in ``histories``: its value as known at the event's period.

    Each attribute has its own change history (``known_versions``), which is matched by itself: the periods that an
    entity's events ask for are gathered once, as a set no longer than the calendar, and each gets the last version that
    began by then. What was matched is one long table (entity, period, attribute), pivoted into columns and joined back
    to the events; no wide version of an entity is ever made. A hot entity asks for each period once, and its events are
    split by AQE's skew join. An event without entity, period or earlier value gets null. Other columns stay, whatever
    their names; columns named ``known_<attribute>`` are replaced.
    """
    names = {f"known_{n}": folded for n, folded in histories.items()}
    events = events.drop(*names)
    if not names:
        return events
    asked = events.select(F.col(entity).alias("__e"), F.col(period).cast("long").alias("__p")).where("__e is not null and __p is not null").groupBy("__e").agg(F.collect_set("__p").alias("__asked"))

    def matched(name: str, folded: DataFrame) -> DataFrame:
        def last(p: Column) -> Column:
            passed = F.filter("__versions", lambda x: x["from"] <= p)
            return F.struct(p.alias("__p"), F.get(passed, F.size(passed) - 1)["value"].alias(name))

        own = folded.select(F.col(entity).alias("__of"), F.col("versions").alias("__versions"))
        return asked.join(own, asked["__e"] == own["__of"]).select("__e", F.inline(F.transform("__asked", last))).where(F.col(name).isNotNull())

    long = None
    for name, folded in names.items():
        one = matched(name, folded)
        long = one if long is None else long.unionByName(one, allowMissingColumns=True)
    wide = long.groupBy("__e", "__p").agg(*[F.any_value(n, True).alias(n) for n in names])
    out = events.join(wide, (events[entity] == wide["__e"]) & (events[period].cast("long") == wide["__p"]), "left")
    return out.select(*[events[c] for c in events.columns], *[wide[n] for n in names])
