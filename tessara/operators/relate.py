"""Joins: mirrors, lookups, expansions, snapshots, staged reconciliation and bounded searches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mirror(frame: DataFrame, key: list[str], side: str, values: list[str], prefix: str = "opp_") -> DataFrame:
    """``frame`` (one row for each key and side) with the other side's values; null where it has none.

    Both sides meet in one aggregate window over the key instead of a self-join: a key has two rows. Rows with a null in
    the key or without side have no other side; of several rows of the other side the least values count.
    """
    w = Window.partitionBy(*key)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, side]])
    sides = F.collect_list(F.when(known, F.struct(F.col(side).alias("s"), *values))).over(w)
    picked = F.filter("__sides", lambda x: x["s"] != F.col(side))
    out = frame.withColumn("__sides", sides).withColumn("__other", F.when(known, F.array_min(picked)))
    return out.select(*frame.columns, *[F.col(f"__other.{v}").alias(f"{prefix}{v}") for v in values])


def outer_with_indicator(left: DataFrame, right: DataFrame, on: list[str], out: str = "found_in") -> DataFrame:
    """Full outer join with ``both``, ``left`` or ``right``."""
    joined = left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), on, "full_outer")
    return joined.withColumn(out, F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), "both").when(F.col("__l").isNotNull(), "left").otherwise("right")).drop("__l", "__r")


def union_lookup(frames: list[tuple[DataFrame, str, str]], key: str, value: str) -> DataFrame:
    """(key, value) from several tables, each key once (the least value)."""
    parts = [f.select(F.col(k).alias(key), F.col(v).alias(value)) for f, k, v in frames]
    return reduce(DataFrame.unionByName, parts).where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def expand_sides(frame: DataFrame, sides: dict[str, dict[str, str]], label: str) -> DataFrame:
    """Each row once for each side: ``sides`` maps a side's label to {new column: column of the frame}."""
    structs = [F.struct(F.lit(name).alias(label), *[F.col(c).alias(n) for n, c in columns.items()]) for name, columns in sides.items()]
    used = {c for columns in sides.values() for c in columns.values()}
    keep = [c for c in frame.columns if c not in used]
    return frame.select(*keep, F.explode(F.array(*structs)).alias("__x")).select(*keep, "__x.*")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """(key, change, column, before, after): keys that came or went, and columns that changed. Values as strings."""
    key = [key] if isinstance(key, str) else key
    a = old.select(*key, *[F.col(c).cast("string").alias(f"__a_{c}") for c in columns])
    b = new.select(*key, *[F.col(c).cast("string").alias(f"__b_{c}") for c in columns])
    both = outer_with_indicator(a, b, key)
    none = F.lit(None).cast("string")
    record = lambda change, column, x, y: F.struct(F.lit(change).alias("change"), F.lit(column).alias("column"), x.alias("before"), y.alias("after"))
    changed = [F.when((F.col("found_in") == "both") & ~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), record("changed", c, F.col(f"__a_{c}"), F.col(f"__b_{c}"))) for c in columns]
    came = F.when(F.col("found_in") == "right", record("new", "", none, none))
    went = F.when(F.col("found_in") == "left", record("gone", "", none, none))
    return both.select(*key, F.explode(F.array_compact(F.array(came, went, *changed))).alias("x")).select(*key, "x.*")


def first_write_wins(history: DataFrame, update: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Union of a history and an update; a key that the history has keeps the history's row."""
    both = history.withColumn("__source", F.lit(0)).unionByName(update.withColumn("__source", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key and c != "__source"]
    return both.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("__source", *order)).alias("__x")).select(*key, "__x.*")


def frozen_override(frame: DataFrame, frozen: DataFrame, key: list[str], column: str) -> DataFrame:
    """``frame`` with ``column`` replaced by the frozen value where there is one."""
    fixed = frozen.select(*key, F.col(column).alias("__frozen"))
    return frame.join(fixed, key, "left").withColumn(column, F.coalesce("__frozen", column)).drop("__frozen").select(*frame.columns)


def staged_reconcile(left: DataFrame, right: DataFrame, left_id: str, right_id: str, stages: list[list[str]]) -> DataFrame:
    """(left_id, right_id, stage): each left row by the first stage that names exactly one right entity.

    ``stages``: lists of columns, by rising detail; a key with null parts matches nothing. A left entity for which no
    stage is unique is absent. Every stage is one aggregate and one join on its key.
    """
    found = None
    for number, key in enumerate(stages, 1):
        known = [F.col(c).isNotNull() for c in key]
        once = right.where(reduce(lambda a, b: a & b, known)).groupBy(*key).agg(F.countDistinct(right_id).alias("__n"), F.min(right_id).alias(right_id)).where("__n = 1").drop("__n")
        rest = left if found is None else left.join(found.select(left_id), left_id, "left_anti")
        hit = rest.join(once, key).groupBy(left_id).agg(F.min(right_id).alias(right_id), F.countDistinct(right_id).alias("__n")).where("__n = 1").select(left_id, right_id, F.lit(number).alias("stage"))
        found = hit if found is None else found.unionByName(hit)
    return found


def top_k_below(asked: DataFrame, offered: DataFrame, group: str, limit: str, price: str, value: str, item: str, k: int, width: int) -> DataFrame:
    """``asked`` with ``best``: of the offers of the group at no higher price than the limit the ``k`` of greatest value.

    ``best`` is an array of (value, price, item) in falling order, empty if there are none; ties go to the lower price,
    then to the lower item. Of each group and price only the k best offers are kept, before anything is exchanged. The
    price axis is cut into blocks of ``width``: a fold over a block's prices gives the k best up to each of them, a fold
    over a group's blocks the k best before each. An asked row looks up its block. So no pairs are emitted, and what is
    gathered for a block or a group grows with the range of prices, not with the offers.
    """
    rank = [F.col("v"), F.col("p"), F.col("i")]  # v is the negative value, so that the natural order is the wanted one
    offers = offered.select(F.col(group).alias("g"), (-F.col(value)).alias("v"), F.col(price).alias("p"), F.col(item).alias("i")).where("g is not null and p is not null and v is not null")
    offers = offers.withColumn("n", F.row_number().over(Window.partitionBy("g", "p").orderBy(*rank))).where(F.col("n") <= k).withColumn("b", F.floor(F.col("p") / width).cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in offers.schema.fields}
    top_kind = f"array<struct<v:{kinds['v']},p:{kinds['p']},i:{kinds['i']}>>"
    best = lambda a, b: F.slice(F.array_sort(F.concat(a, b)), 1, k)

    def running(sorted_rows: Column, at: str, kind: str, of: Callable[[Column], Column]) -> Column:
        """An array of (at, top): the k best of all elements up to each."""
        start = F.struct(F.array().cast(top_kind).alias("top"), F.array().cast(f"array<struct<at:{kind},top:{top_kind}>>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            top = best(s["top"], of(x))
            return F.struct(top.alias("top"), F.concat(s["out"], F.array(F.struct(x[at].alias("at"), top.alias("top")))).alias("out"))

        return F.aggregate(sorted_rows, start, step, lambda s: s["out"])

    in_block = F.array_sort(F.collect_list(F.struct("p", "v", "i")))
    blocks = offers.groupBy("g", "b").agg(in_block.alias("x")).select("g", "b", running(F.col("x"), "p", kinds["p"], lambda x: F.array(F.struct(x["v"], x["p"], x["i"]))).alias("inside"))
    ends = blocks.select("g", F.struct("b", F.element_at("inside", -1)["top"].alias("top")).alias("x")).groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("x"))
    upto = ends.select("g", running(F.col("x"), "b", "bigint", lambda x: x["top"]).alias("upto"))
    rows = asked.withColumn("__b", F.floor(F.col(limit) / width).cast("long"))
    out = rows.join(upto.select(F.col("g").alias("__ug"), "upto"), F.col(group) == F.col("__ug"), "left")
    before = F.filter("upto", lambda x: x["at"] < F.col("__b"))
    out = out.withColumn("__before", F.get(before, F.size(before) - 1)["top"]).drop("upto", "__ug")
    out = out.join(blocks.select(F.col("g").alias("__bg"), F.col("b").alias("__bb"), "inside"), (F.col(group) == F.col("__bg")) & (F.col("__b") == F.col("__bb")), "left")
    near = F.filter("inside", lambda x: x["at"] <= F.col(limit))
    none = F.array().cast(top_kind)
    merged = best(F.coalesce(F.col("__before"), none), F.coalesce(F.get(near, F.size(near) - 1)["top"], none))
    return out.select(*[rows[c] for c in asked.columns], F.transform(merged, lambda x: F.struct((-x["v"]).alias("value"), x["p"].alias("price"), x["i"].alias("item"))).alias("best"))


def coalesce_lookup(frame: DataFrame, lookup: DataFrame, on: list[str], value: str, default: Column) -> DataFrame:
    """Left join on a unique key; a miss gets the default."""
    return frame.join(lookup, on, "left").withColumn(value, F.coalesce(F.col(value), default))


#: Rows of a lookup up to which it is sent whole to the executors.
SMALL = 200_000


def small_lookup(frame: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", most: int = SMALL) -> DataFrame:
    """Join with a narrow lookup: broadcast if it has at most ``most`` rows, else left to the planner.

    The lookup is counted first, so give one that is cut from its sources (a checkpoint). The rows are the same.
    """
    return frame.join(F.broadcast(lookup) if lookup.count() <= most else lookup, on, how)


def find_one(frame: DataFrame, name: str, asked: str, plain: Callable[[Column], Column]) -> DataFrame:
    """The rows of the one name that is meant: by the whole plain form, else by a part of it.

    Raises LookupError for no name and for several different ones (of which the first few are told).
    """
    form, wanted = plain(F.col(name)), plain(F.lit(asked))
    for hit in (form == wanted, F.contains(form, wanted)):
        names = [r[name] for r in frame.where(hit).select(name).distinct().orderBy(name).limit(6).collect()]
        if len(names) == 1:
            return frame.where(F.col(name) == names[0])
        if names:
            raise LookupError(f"{asked!r} may be any of {names}")
    raise LookupError(f"nobody is called {asked!r}")
