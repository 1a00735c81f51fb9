"""Matching entities of several sources that share no key.

An entity is a profile: a name and the set of what it was seen in (events with details). Candidates come from MinHash
bands over two attributes: bands of two hashes of the exact details, and bands that join one hash of the events with one
hash of the name. A pair that never shares an event is no candidate, so a bucket holds no more than the entities of one
event, however many bear the same name or belong to the same group. Each candidate pair gets similarity features; a
logistic classifier is trained on weak labels, its scores are calibrated on others, and the best mutual pairs above an
even chance are kept.

Scale: profiles are one aggregate each; the sets combine on the map side. Bands are joined on their hash; one that many
share is cut into a grid of small parts and loses no pair. Features are JVM expressions over short integer arrays. The classifier sees a sample of
labelled pairs bounded by ``TRAIN`` (taken in the order of a hash); everything else covers all rows. Nothing but model
coefficients reaches the driver.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessara.session import checkpoint_dir

EXACT_BANDS, MIXED_BANDS, TRAIN = 14, 16, 40_000
FEATURES = ("exact_right", "exact_left", "events_right", "events_left", "details", "detail_count", "name_pairs", "name_words", "last_word", "pairs_right", "shared")


def _folding() -> tuple[str, str]:
    """Accented Latin letters and the plain ones under them, by decomposition; and those that do not decompose."""
    plain = {"ß": "s", "æ": "a", "œ": "o", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "t", "ı": "i"}
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(n).lower()
        base = unicodedata.normalize("NFKD", ch)[0]
        if len(ch) == 1 and base != ch and base.isascii():
            plain[ch] = base
    return "".join(plain), "".join(plain.values())


_FROM, _TO = _folding()


def folded(name: Column) -> Column:
    """Lower case without accents, only letters and single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), _FROM, _TO), r"[^\p{L}]+", " "))


def words_of(plain: str | Column) -> Column:
    """The words of a folded name."""
    plain = F.col(plain) if isinstance(plain, str) else plain
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def name_words(name: Column) -> Column:
    return words_of(folded(name))


def letter_pairs(words: Column) -> Column:
    """Short hashes of the pairs of adjacent letters of each word, its edges marked, without repetition."""
    def of(word: Column) -> Column:
        marked = F.concat(F.lit("_"), word, F.lit("_"))
        return F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.shiftright(F.hash(F.substr(marked, i, F.lit(2))), 16).cast("smallint"))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def upper(seen: str | Column) -> Column:
    """The events of a set of seen events."""
    return F.array_distinct(F.transform(seen, lambda x: F.shiftright(x, 32).cast("int")))


def lower(seen: str | Column) -> Column:
    """Their hashes with the exact columns."""
    return F.array_distinct(F.transform(seen, lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")))


#: Of the packed form of a seen event the lower bits are of the exact columns, the others of the event.
EXACT_BITS = 12


def packed(seen: str | Column) -> Column:
    """A set of seen events in integers, half as long: some bits of an event's hash, some of that of its exact columns."""
    low = (1 << EXACT_BITS) - 1
    return F.array_distinct(F.transform(seen, lambda x: F.shiftright(x, 32).cast("int").bitwiseAND(F.lit(~low)).bitwiseOR(x.bitwiseAND(F.lit(low)).cast("int"))))


def profiles(seen: DataFrame, key: str, name: str, event: str, exact: list[str], details: list[str]) -> DataFrame:
    """(id, plain, pairs, seen, detail_*): one row for each key with at least one event.

    ``seen``: rows (key, name, event, columns of ``exact`` and of ``details``). Hashes stand for events, for events with
    their exact columns, and for events in which a detail is above 0 (its value counts too). Repeated rows change
    nothing; of several names the last in order is taken; rows without key are dropped, rows without event give only
    their name. ``plain``: the folded name. The result is cut from its sources by a checkpoint: candidates and features
    both read it.
    """
    known = lambda x: F.when(F.col(event).isNotNull(), x)
    hashed = seen.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("id"),
        F.col(name).alias("name"),
        # one set holds both: the event's hash above, that of the event with its exact columns below
        known(F.shiftleft(F.hash(event).cast("long"), 32).bitwiseOR(F.hash(event, *exact).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("seen"),
        *[known(F.when(F.coalesce(F.col(d), F.lit(0)) > 0, F.hash(F.lit(d), F.col(event), F.col(d).cast("int")))).alias(f"detail_{d}") for d in details],
    )
    sets = [F.collect_set(c).alias(c) for c in ("seen", *[f"detail_{d}" for d in details])]
    grouped = hashed.groupBy("id").agg(F.max("name").alias("name"), *sets).where(F.size("seen") > 0)
    named = grouped.select("id", folded(F.coalesce(F.col("name"), F.lit(""))).alias("plain"), *[c for c in grouped.columns if c not in ("id", "name")])
    checkpoint_dir(seen.sparkSession)
    return named.withColumn("pairs", letter_pairs(words_of("plain"))).checkpoint()


def _least(values: Column, seeds: range) -> list[Column]:
    """One MinHash of a set of integers for each seed; null for an empty set."""

    def one(seed: int) -> Column:
        return F.array_min(F.transform(values, lambda v: F.xxhash64(v, F.lit(seed))))

    return [one(seed) for seed in seeds]


def band_keys(profile: DataFrame) -> DataFrame:
    """(id, band): the bands an entity falls in."""
    sets = profile.select("id", "pairs", lower("seen").alias("exact"), upper("seen").alias("events"))
    exact = _least(F.col("exact"), range(2 * EXACT_BANDS))
    events = _least(F.col("events"), range(100, 100 + MIXED_BANDS))
    names = _least(F.col("pairs"), range(200, 200 + MIXED_BANDS))
    bands = [F.xxhash64(F.lit(k), exact[2 * k], exact[2 * k + 1]) for k in range(EXACT_BANDS)]
    bands += [F.when(names[k].isNotNull(), F.xxhash64(F.lit(1000 + k), events[k], names[k])) for k in range(MIXED_BANDS)]
    return sets.select("id", F.explode(F.array(*bands)).alias("band")).where("band is not null")


#: A band, or an event, that would give more pairs than this is spread over several tasks; no pair is lost.
HOT_PAIRS = 10_000
#: Entities of one side in a part of a hot band.
PART = 100


def hot_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """(event): those with so many entities of both sides that a band of them may be hot."""
    count = lambda side, n: side.select(F.explode(upper("seen")).alias("event")).groupBy("event").agg(F.count("*").alias(n))
    return count(left, "n").join(count(right, "m"), "event").where(F.col("n") * F.col("m") > HOT_PAIRS).select("event")


def _parts(bands: DataFrame, hot: DataFrame, own: str, other: str, place: str, row: bool) -> DataFrame:
    """``bands`` with (i, j): an entity's part of its own side by its hash, and each part of the other side."""
    mine, theirs = F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
    i, j = (mine, theirs) if row else (theirs, mine)
    return bands.join(hot, "band", "left").select(F.col("id").alias(place), "band", i.alias("i"), j.alias("j"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): each pair that shares a band, once, however many share it.

    All who share a band share an event, so there is no hot band without a hot event; whether there are hot events at
    all is the one thing that the driver asks. A hot band is cut into a grid of parts of about ``PART`` entities of each
    side: every pair of it meets in one cell, and no task holds the band. The pairs are the same at every size.
    """
    a, b = band_keys(left), band_keys(right)
    if hot_events(left, right).limit(1).collect():
        parts = lambda bands, n: bands.groupBy("band").agg(F.ceil(F.count("*") / PART).alias(n), F.count("*").alias(f"count_{n}"))
        hot = parts(a, "n").join(parts(b, "m"), "band").where(F.col("count_n") * F.col("count_m") > HOT_PAIRS).select("band", "n", "m")
        a, b = _parts(a, hot, "n", "m", "left_id", True), _parts(b, hot, "m", "n", "right_id", False)
        return a.join(b, ["band", "i", "j"]).select("left_id", "right_id").distinct()
    return a.withColumnRenamed("id", "left_id").join(b.withColumnRenamed("id", "right_id"), "band").select("left_id", "right_id").distinct()


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidate pairs with their features; pairs without a common event have no evidence and are left out.

    Details count as far as both sides have them.
    """
    details = [c for c in left.columns if c.startswith("detail_") and c in right.columns]
    # what goes with every pair is kept short: packed events, a name's text and short hashes of its letter pairs
    known = F.concat(*details) if details else F.array().cast("array<int>")
    short = lambda side, s: side.select(F.col("id").alias(f"{s}_id"), *[c.alias(f"__{s}_{n}") for n, c in (("exact", packed("seen")), ("plain", F.col("plain")), ("pairs", F.col("pairs")), ("details", known))])
    both = pairs.join(short(left, "left"), "left_id").join(short(right, "right"), "right_id")
    event = lambda c: F.array_distinct(F.transform(c, lambda x: F.shiftright(x, EXACT_BITS)))
    both = both.select("left_id", "right_id", F.col("__right_plain").alias("b_plain"), *[F.col(f"__{s}_{n}").alias(f"{t}_{n}") for s, t in (("left", "a"), ("right", "b")) for n in ("exact", "pairs", "details")], *[c.alias(f"{t}_{n}") for s, t in (("left", "a"), ("right", "b")) for n, c in (("events", event(f"__{s}_exact")), ("words", words_of(f"__{s}_plain")))])
    size = lambda c: F.size(c).cast("double")
    common = lambda c: size(F.array_intersect(f"a_{c}", f"b_{c}"))
    both = both.withColumns({"n_exact": common("exact"), "n_events": common("events"), "n_details": common("details"), "n_pairs": common("pairs")}).where("n_events > 0")
    share = lambda n, of: F.coalesce(n / F.nullif(of, F.lit(0.0)), F.lit(0.0))
    union = lambda c, n: size(f"a_{c}") + size(f"b_{c}") - F.col(n)
    # an initial, or a short form, stands for a word that begins with it
    found = F.filter("b_words", lambda w: F.exists("a_words", lambda v: (v == w) | ((F.length(w) <= 4) & F.startswith(v, w)) | ((F.length(w) > 4) & (F.levenshtein(v, w, 2) >= 0))))
    last = F.array_max(F.transform("a_words", lambda v: 1 - F.levenshtein(v, F.element_at("b_words", -1)) / F.greatest(F.length(v), F.length(F.element_at("b_words", -1)), F.lit(1))))
    inside = share(F.col("n_pairs"), size("b_pairs"))
    return both.select(
        "left_id", "right_id", "b_plain",
        share(F.col("n_exact"), size("b_exact")).alias("exact_right"),
        share(F.col("n_exact"), size("a_exact")).alias("exact_left"),
        share(F.col("n_events"), size("b_events")).alias("events_right"),
        share(F.col("n_events"), size("a_events")).alias("events_left"),
        share(F.col("n_details"), union("details", "n_details")).alias("details"),
        F.log1p(union("details", "n_details") - F.col("n_details")).alias("detail_count"),
        share(F.col("n_pairs"), union("pairs", "n_pairs")).alias("name_pairs"),
        F.greatest(share(size(found), size("b_words")), F.when(inside >= 0.75, inside)).alias("name_words"),  # words may be run together
        F.when(F.size("b_words") > 0, F.coalesce(last, F.lit(0.0))).otherwise(F.lit(0.0)).alias("last_word"),
        inside.alias("pairs_right"),
        F.log1p("n_exact").alias("shared"),
    )


def classify(features: DataFrame, label: str) -> DataFrame:
    """``features`` with ``probability``: logistic, trained on the weak labels (null where there is none), calibrated.

    Of the labelled pairs at most ``TRAIN`` are used, in the order of a hash of their ids: four fifths train, one fifth
    calibrates (Platt). Without labels of both kinds the probability is the mean of the similarities.
    """
    labelled = features.where(F.col(label).isNotNull()).withColumn("__h", F.xxhash64("left_id", "right_id"))
    sample = labelled.orderBy("__h").limit(TRAIN).withColumn("__fold", F.pmod(F.xxhash64("__h"), F.lit(5)))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="__x")
    sample = assembler.transform(sample).select("__x", F.col(label).cast("double").alias("__y"), "__fold").checkpoint()
    kinds = {(r["t"], r["__y"]) for r in sample.select((F.col("__fold") > 0).alias("t"), "__y").distinct().collect()}
    if len(kinds) < 4:
        similar = reduce(lambda a, b: a + b, [F.col(f) for f in ("exact_right", "exact_left", "name_pairs", "name_words")]) / 4
        return features.withColumn("probability", similar)
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1e-3, maxIter=50).fit(sample.where("__fold > 0"))
    weights, bias = model.coefficients.toArray().tolist(), float(model.intercept)
    held = sample.where("__fold = 0").select("__y", vector_to_array("__x").alias("__v"))
    raw = reduce(lambda a, b: a + b, [F.get("__v", F.lit(k)) * w for k, w in enumerate(weights)]) + F.lit(bias)
    platt = LogisticRegression(featuresCol="__z", labelCol="__y", regParam=1e-6, maxIter=50).fit(VectorAssembler(inputCols=["__s"], outputCol="__z").transform(held.select("__y", raw.alias("__s"))))
    slope, shift = float(platt.coefficients[0]), float(platt.intercept)
    if slope <= 0:  # the held-out labels say nothing
        slope, shift = 1.0, 0.0
    logit = reduce(lambda a, b: a + b, [F.col(f) * F.lit(w) for f, w in zip(FEATURES, weights)]) + F.lit(bias)
    return features.withColumn("probability", 1 / (1 + F.exp(-(logit * slope + shift))))


def best_pairs(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs that are each other's best, with at least this probability; ties go to more common evidence, then ids."""
    order = lambda other: [F.col("probability").desc(), F.col("shared").desc(), F.col("name_pairs").desc(), F.col(other)]
    likely = scored.where(F.col("probability") >= least)
    ranked = likely.withColumn("__l", F.row_number().over(Window.partitionBy("left_id").orderBy(*order("right_id"))))
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy("right_id").orderBy(*order("left_id"))))
    return ranked.where("__l = 1 and __r = 1").drop("__l", "__r")


def match(left: DataFrame, right: DataFrame, hints: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Scored mutual matches of two sets of profiles.

    ``hints``: (left_id, hinted) with a name that somebody proposed for a left entity. A candidate with the hinted name
    is a weak positive label, a candidate with another name a weak negative one; a left entity without hint gives none.
    Hints decide no match.
    """
    features = pair_features(candidates(left, right), left, right)
    if hints is None:
        labelled = features.withColumn("label", F.lit(None).cast("int"))
    else:
        one = hints.groupBy("left_id").agg(F.max("hinted").alias("hinted"))
        labelled = features.join(one, "left_id", "left").withColumn("label", (folded(F.col("hinted")) == F.col("b_plain")).cast("int")).drop("hinted")
    kept = labelled.drop("b_plain").checkpoint()
    return best_pairs(classify(kept, "label"), least)
