"""Trailing totals by block decomposition.

The integer time axis of an entity (days, or the ordinal of its events) is cut into blocks as long as the window. In
each block a prefix sum and a suffix sum is kept for every position. A window of ``length`` that ends at position p of
block b is then ``prefix[b][p] + suffix[b - 1][p + 1]``: one addition for any window length, and no row for a day
without activity is ever shuffled.

Scale: the facts are first summed per (entity, position), with map-side combine, so a hot entity sends one row for
each of its days. What is collected for one (entity, block) has at most ``length`` elements. All exchanges are hashed
on (entity, block), so that even the history of one entity spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_number(day: Column) -> Column:
    """Days since 1970 of a date."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")


def block_sums(facts: DataFrame, entity: str, at: str, value: str, length: int) -> DataFrame:
    """(entity, block, prefix, before): what windows of ``length`` that end in a block are made of.

    ``facts``: rows with an entity, an integer position ``at`` and a number ``value``; several rows of one position
    add up; rows without entity or position are dropped, a null value counts as 0.
    ``prefix[i]``: the sum of positions 0..i of the block; ``before[i]``: the sum of positions i.. of the block before.
    Either is null if its block has no facts. Blocks with neither are absent: their totals are 0.
    """
    if length < 1:
        raise ValueError("a window has at least one position")
    n = F.lit(length).cast("long")
    daily = (
        facts.select(F.col(entity).alias("e"), F.col(at).cast("long").alias("i"), F.col(value).alias("v"))
        .where(F.col("e").isNotNull() & F.col("i").isNotNull())
        .groupBy("e", F.floor(F.col("i") / n).cast("long").alias("b"), F.pmod("i", n).cast("int").alias("p"))
        .agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    )
    zero = F.lit(0).cast(daily.schema["v"].dataType)
    kind = daily.schema["v"].dataType.simpleString()

    def running(ordered: Column, place) -> Column:  # noqa: ANN001
        """The sum of the elements up to each of ``length`` places: a fold over the elements, which fills the places between them."""
        start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), zero.alias("sum"))

        def step(s: Column, x: Column) -> Column:
            return F.struct(F.concat(s["out"], F.array_repeat(s["sum"], place(x["p"]) - F.size(s["out"]))).alias("out"), (s["sum"] + x["v"]).cast(kind).alias("sum"))

        return F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.array_repeat(s["sum"], F.lit(length) - F.size(s["out"]))))

    rising, falling = F.array_sort("c"), F.reverse(F.array_sort("c"))
    prefix, suffix = running(rising, lambda p: p), F.reverse(running(falling, lambda p: F.lit(length - 1) - p))
    none = F.lit(None).cast(f"array<{kind}>")
    blocks = daily.groupBy("e", "b").agg(F.collect_list(F.struct("p", "v")).alias("c"))
    ends = blocks.select("e", F.explode(F.array(F.struct(F.col("b"), prefix.alias("prefix"), none.alias("before")), F.struct((F.col("b") + 1).alias("b"), none.alias("prefix"), suffix.alias("before")))).alias("x")).select("e", "x.*")
    return ends.groupBy("e", "b").agg(F.max("prefix").alias("prefix"), F.max("before").alias("before")).select(F.col("e").alias(entity), F.col("b").alias("block"), "prefix", "before")


def window_total(position: Column, length: int, prefix: Column | str = "prefix", before: Column | str = "before") -> Column:
    """The total of the ``length`` positions that end at ``position``, from the sums of its block (null sums are 0)."""
    p = F.pmod(position.cast("long"), F.lit(length).cast("long")).cast("int")
    prefix, before = (F.col(x) if isinstance(x, str) else x for x in (prefix, before))
    return F.coalesce(F.get(prefix, p), F.lit(0)) + F.coalesce(F.get(before, p + 1), F.lit(0))


def totals_at(asked: DataFrame, facts: DataFrame, entity: str, at: str, value: str, lengths: dict[str, int], own: str | None = None) -> DataFrame:
    """``asked`` with one total for each name in ``lengths``: of the window that ends at the row's ``at``.

    ``asked`` and ``facts`` share the columns ``entity`` and ``at``. Every asked row comes back once, with its other
    columns whatever their names; without facts in the window, and for a null entity, the total is 0; for a null
    position it is null. ``own``: a name for the total of the row's position alone, which the first window's sums give.
    """
    out = asked
    for name, length in lengths.items():
        sums = block_sums(facts, entity, at, value, length).select(F.col(entity).alias("__e"), F.col("block").alias("__b"), F.col("prefix").alias("__prefix"), F.col("before").alias("__before"))
        block = F.floor(out[at].cast("long") / F.lit(length)).cast("long")
        out = out.join(sums, (out[entity] == sums["__e"]) & (block == sums["__b"]), "left")
        out = out.withColumn(name, F.when(F.col(at).isNotNull(), window_total(F.col(at), length, "__prefix", "__before")))
        if own:
            p = F.pmod(F.col(at).cast("long"), F.lit(length).cast("long")).cast("int")
            out, own = out.withColumn(own, F.coalesce(F.get("__prefix", p), F.lit(0)) - F.when(p > 0, F.coalesce(F.get("__prefix", p - 1), F.lit(0))).otherwise(F.lit(0))), None
        out = out.drop("__e", "__b", "__prefix", "__before")
    return out


def daily_totals(facts: DataFrame, entity: str, day: str, value: str, lengths: dict[str, int], spans: DataFrame | None = None) -> DataFrame:
    """(entity, day, value of the day, totals and means): every day of an entity from its first to its last active one.

    ``spans``: (entity, first, last) with dates, one row for each entity whose days are wanted instead.
    Days without activity have rows too. For each name in ``lengths`` there are ``name`` and ``mean_name``, the total
    and the mean over that many days (a mean divides by the length, whether there was activity or not).
    """
    at = "__at"
    numbered = facts.select(F.col(entity), day_number(F.col(day)).alias(at), F.col(value).alias("__v")).where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    if spans is None:
        span = numbered.groupBy(entity).agg(F.min(at).alias("a"), F.max(at).alias("z"))
    else:
        span = spans.select(entity, day_number(F.col("first")).alias("a"), day_number(F.col("last")).alias("z"))
    out = span.select(entity, F.explode(F.sequence("a", "z")).alias(at))
    out = totals_at(out, numbered, entity, at, "__v", lengths, own="__day")
    return out.select(
        entity,
        F.date_add(F.lit("1970-01-01").cast("date"), F.col(at).cast("int")).alias(day),
        F.col("__day").alias(value),
        *[c for name, n in lengths.items() for c in (F.col(name), (F.col(name) / F.lit(n)).alias(f"mean_{name}"))],
    )


#: Days, or units of an integer axis, of the buckets that event numbers are counted in.
BUCKET = 64


def event_numbers(events: DataFrame, entity: str, order: list[str], out: str) -> DataFrame:
    """``events`` with the number (from 0) of each event of its entity in order.

    Numbers are counted inside buckets of the first order column, a date or an integer, and shifted by the counts of the
    entity's earlier buckets: no task sorts all events of a hot entity. Null order values come first; a column of
    another type makes one bucket. An event without entity has no number.
    """
    from pyspark.sql import Window

    kind = events.schema[order[0]].dataType.simpleString()
    axis = day_number(F.col(order[0])) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(order[0]).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(0).cast("long")
    bucketed = events.withColumn("__bucket", F.coalesce(F.floor(axis / BUCKET).cast("long"), F.lit(-(2**62)).cast("long")))
    counts = bucketed.groupBy(F.col(entity).alias("__ne"), F.col("__bucket").alias("__nb")).agg(F.count("*").alias("__count"))
    before = F.coalesce(F.sum("__count").over(Window.partitionBy("__ne").orderBy("__nb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__ne", "__nb", before.alias("__before_bucket"))
    inside = bucketed.withColumn("__in", F.row_number().over(Window.partitionBy(entity, "__bucket").orderBy(*order)).cast("long") - 1)
    # plain equality: the rows lie by entity and bucket already, and are not exchanged again
    joined = inside.join(shifts, (F.col(entity) == F.col("__ne")) & (F.col("__bucket") == F.col("__nb")), "left")
    return joined.withColumn(out, F.col("__in") + F.col("__before_bucket")).drop("__bucket", "__in", "__ne", "__nb", "__before_bucket")


def trailing_events(events: DataFrame, entity: str, order: list[str], value: str, length: int) -> DataFrame:
    """``events`` with ``trailing_n`` and ``trailing_mean``: of up to ``length`` events of the entity before this one.

    Order ties are broken by the later names in ``order``; the mean is null for an entity's first event, and number
    and mean are for an event without entity. The ordinal of an event is the axis that is cut into blocks. A null value counts as 0.
    """
    numbered = event_numbers(events, entity, order, "__at")
    sums = block_sums(numbered, entity, "__at", value, length).select(F.col(entity).alias("__e"), F.col("block").alias("__b"), F.col("prefix").alias("__prefix"), F.col("before").alias("__before"))
    last = F.col("__at") - 1
    out = numbered.join(sums, (numbered[entity] == sums["__e"]) & (F.floor(last / F.lit(length)).cast("long") == sums["__b"]), "left")
    n = F.when(F.col("__at").isNotNull(), F.least(F.col("__at"), F.lit(length).cast("long")))
    return out.withColumns({"trailing_n": n, "trailing_mean": F.when(n > 0, window_total(last, length, "__prefix", "__before") / n)}).drop("__e", "__b", "__prefix", "__before", "__at")
