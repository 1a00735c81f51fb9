"""Aggregates: labels, correlations, error metrics, calibration tables, rank statistics, overlaps and consensus."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessara.session import checkpoint_dir


def total(value: Column) -> Column:
    """A sum that is 0 for a group without values."""
    return F.coalesce(F.sum(value), F.lit(0))


def mode_labels(frame: DataFrame, by: list[str], label: str, out: str) -> DataFrame:
    """(by, out, n, n_other): the most frequent label of a key (ties: the least), its rows and the rows with another.

    Labels are counted first, so a hot key sends one row for each of its labels.
    """
    counted = frame.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("__n"))
    best = F.min_by(F.struct(F.col(label).alias("l"), F.col("__n").alias("n")), F.struct((-F.col("__n")).alias("a"), F.col(label).alias("b")))
    return counted.groupBy(*by).agg(best.alias("__x"), F.sum("__n").alias("__all")).select(*by, F.col("__x.l").alias(out), F.col("__x.n").alias("n"), (F.col("__all") - F.col("__x.n")).alias("n_other"))


def pair_correlations(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r): Pearson for every pair of columns and their variances (x = y), all in one aggregate.

    A pair uses the rows where both are known. The columns are few; the result has one row for each pair.
    """
    pairs = list(combinations(columns, 2))
    one = frame.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)], *[F.var_samp(c).alias(f"v{k}") for k, c in enumerate(columns)])
    records = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)]
    records += [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.col(f"v{k}").alias("r")) for k, c in enumerate(columns)]
    return one.select(F.inline(F.array(*records)))


def _counted(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, __v, __n, __lo, __all): each distinct value with its count, the number of lesser ones and of all in its group.

    Values are counted first, then dealt to tasks by ranges of (group, value): however they are spread, a task has its
    share of them, and no group or outlier goes to one. Counts of ranges are few rows. The ranges are cut by a
    checkpoint, so that they are the same wherever they are read.
    """
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    checkpoint_dir(frame.sparkSession)
    ranged = counts.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()).checkpoint()
    # a row for each group and range
    parts = ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__m"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part")
    before = F.coalesce(F.sum("__m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__of"), before.alias("__before"), F.sum("__m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    joined = ranged.withColumn("__in", inside).join(shifts, [F.col("__part") == F.col("__of"), *same])
    return joined.select(*by, "__v", "__n", (F.col("__before") + F.col("__in")).alias("__lo"), "__all")


def average_ranks(frame: DataFrame, value: str, out: str) -> DataFrame:
    """``frame`` with the rank of a value, ties sharing their mean rank; null values have none."""
    ranks = _counted(frame, [], value).select("__v", (F.col("__lo") + (F.col("__n") + 1) / 2).alias(out))
    return frame.join(ranks, frame[value] == ranks["__v"], "left").drop("__v")


def exact_quantiles(frame: DataFrame, by: list[str], value: str, shares: list[float], out: str = "q") -> DataFrame:
    """(by, out): for each group an array of exact quantiles with linear interpolation; groups without values are absent.

    The same numbers as an exact percentile, which would hold all distinct values of a group in one task.
    """
    rows = _counted(frame, by, value).withColumn("__v", F.col("__v").cast("double"))
    ends = []
    for k, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("__all") - 1)
        has = lambda i: (F.col("__lo") <= i) & (i < F.col("__lo") + F.col("__n"))
        ends += [F.max(F.when(has(F.floor(at)), F.col("__v"))).alias(f"__a{k}"), F.max(F.when(has(F.ceil(at)), F.col("__v"))).alias(f"__z{k}")]
    each = rows.groupBy(*by).agg(F.max("__all").alias("__all"), *ends).where("__all is not null")

    def between(k: int, share: float) -> Column:
        at = F.lit(float(share)) * (F.col("__all") - 1)
        return F.when(F.col(f"__a{k}") == F.col(f"__z{k}"), F.col(f"__a{k}")).otherwise((F.ceil(at) - at) * F.col(f"__a{k}") + (at - F.floor(at)) * F.col(f"__z{k}"))

    return each.select(*by, F.array(*[between(k, s) for k, s in enumerate(shares)]).alias(out))


def spearman(frame: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the rank correlation of two columns, over the rows where both are known."""
    known = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return average_ranks(average_ranks(known, "x", "rx"), "y", "ry").agg(F.corr("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def error_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """Mean absolute error, bias and correlation."""
    return {"mae": F.avg(F.abs(predicted - actual)), "bias": F.avg(predicted - actual), "r": F.corr(predicted, actual)}


def brier(actual: Column, probability: Column) -> Column:
    return F.avg(F.pow(probability - actual, 2))


def fixed_bins(frame: DataFrame, probability: str, actual: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_predicted, mean_actual): [k/bins, (k+1)/bins); 1.0 falls in none, empty bins have no row."""
    p = F.col(probability)
    return frame.where((p >= 0) & (p < 1)).groupBy(F.floor(p * bins).cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_predicted"), F.avg(actual).alias("mean_actual"))


def quantile_edges(frame: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation, as a handful of numbers."""
    row = exact_quantiles(frame.select(value), [], value, shares).first()
    return [] if row is None else [float(x) for x in row["q"]]


def quantile_buckets(frame: DataFrame, value: str, n: int, out: str) -> DataFrame:
    """``frame`` with the right-closed bucket (0 ..) of a value among ``n`` quantile buckets; equal edges are merged."""
    edges = sorted(set(quantile_edges(frame, value, [k / n for k in range(n + 1)])))
    bucket = F.lit(None).cast("bigint")
    for k in reversed(range(len(edges) - 1)):
        lower = F.col(value) >= edges[k] if k == 0 else F.col(value) > edges[k]
        bucket = F.when(lower & (F.col(value) <= edges[k + 1]), F.lit(k).cast("bigint")).otherwise(bucket)
    return frame.withColumn(out, bucket)


def confusion(frame: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: the four cells, precision and recall of a binary prediction; without positives these are 0."""
    a, p = F.col(actual), F.col(predicted)
    cells = {"tp": a & p, "fp": ~a & p, "fn": a & ~p, "tn": ~a & ~p}
    one = frame.agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    return one.select("*", (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"))


def top_overlap(frame: DataFrame, key: str, first: Column, second: Column, n: int) -> DataFrame:
    """One row: how many of the first ``n`` keys by one order are among those by the other."""
    a = frame.orderBy(first, key).limit(n).select(key)
    b = frame.orderBy(second, key).limit(n).select(key)
    return a.join(b, key, "left_semi").agg(F.count("*").alias("n_common")).withColumn("share", F.col("n_common") / n)


def consensus(frame: DataFrame, by: str, value: Column, slots: dict[str, int]) -> DataFrame:
    """(estimate per group, median, mean, spread): sums of the groups divided by their slots, as cross-checking estimates."""
    divisor = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])
    each = frame.where(F.col(by).isin(*slots)).groupBy(by).agg((F.sum(value) / F.element_at(divisor, F.col(by))).alias("estimate"))
    overall = each.agg(F.median("estimate").alias("median"), F.avg("estimate").alias("mean"), ((F.max("estimate") - F.min("estimate")) / F.median("estimate")).alias("spread"))
    return each.join(F.broadcast(overall))  # one row


def coverage(frame: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row of conditional counts, all in one aggregate."""
    return frame.agg(F.count("*").alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counters.items()])


def identical_groups(frame: DataFrame, by: list[str], name: str, least: int = 2, shown: int = 3) -> DataFrame:
    """Keys that several rows share, with their number and the first few names.

    Rows are counted on the map side; of the names only the first few of each task are exchanged.
    """
    counts = frame.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = frame.where(F.col(name).isNotNull()).withColumn("__p", F.row_number().over(Window.partitionBy(*by).orderBy(name))).where(F.col("__p") <= shown)
    names = first.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"))
    return counts.join(names, by, "left").withColumn("names", F.coalesce("names", F.lit("")))


def top_share(frame: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """One row: the share of a total that its ``n`` largest keys hold."""
    each = frame.groupBy(key).agg(F.sum(value).alias("v"))
    largest = each.orderBy(F.col("v").desc(), key).limit(n).agg(F.sum("v").alias("top"))
    return largest.join(F.broadcast(each.agg(F.sum("v").alias("all")))).select((F.col("top") / F.col("all")).alias("share"))
