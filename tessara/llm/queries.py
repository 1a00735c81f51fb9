"""Queries of the text operators, over whole tables with production parameters; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.llm import bpe, canonical, matching, packing, quality
from tessara.operators.instants import add_day
from tessara.operators.relate import small_lookup
from tessara.session import checkpoint_dir
from tessara.sources.tables import table

# ---------------------------------------------------------------- p2: visually identical text

NAMED = {"fpl_clean_dataset": "player_name", "entity_matching_table": "fbref_name"}


def _names(spark: SparkSession, root: str) -> DataFrame:
    out = None
    for name, column in NAMED.items():
        one = table(spark, root, name, "row_id", column).select(F.lit(name).alias("source_table"), "row_id", F.col(column).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def p2_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Every name of the two tables in its one form."""
    return canonical.canonicalize(_names(spark, root), "name")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose name holds other characters than its ordinary spelling."""
    return canonical.canonicalize(_names(spark, root), "name", changed_only=True).select("source_table", "row_id")


# ---------------------------------------------------------------- p3: matching entities without keys


def club_key(club: Column) -> Column:
    """The first word of a club's name, without accents; abbreviations of the rest and club forms don't matter."""
    return F.nullif(F.split(F.regexp_replace(matching.folded(club), r"^(?:afc|fc) ", ""), " ")[0], F.lit(""))


def fixtures(spark: SparkSession, root: str) -> DataFrame:
    """(fixture_id, home, away, day): club keys and day of each fixture; a side's opponent is stamped right on every row."""
    days = table(spark, root, "model_ready_dataset", "fixture_id", "match_date").groupBy("fixture_id").agg(F.max("match_date").alias("day"))
    rows = table(spark, root, "fpl_clean_dataset", "fixture_id", "was_home", "opponent_team")
    sides = rows.groupBy("fixture_id").agg(F.max(F.when(~F.col("was_home"), F.col("opponent_team"))).alias("home"), F.max(F.when(F.col("was_home"), F.col("opponent_team"))).alias("away"))
    return sides.join(days, "fixture_id").select("fixture_id", club_key(F.col("home")).alias("home"), club_key(F.col("away")).alias("away"), "day").where("home is not null and away is not null")


def player_appearances(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the game with minutes, and a row with the name alone; of several reports the one ingested last."""
    rows = table(spark, root, "fpl_clean_dataset", "row_id", "player_id", "full_name", "fixture_id", "was_home", "minutes", "goals", "assists", "yellow_cards", "ingested_at")
    figures = ["minutes", "goals", "assists", "yellow_cards"]
    # names are long and few: they don't go with every report
    last = rows.groupBy("player_id", "fixture_id").agg(F.max_by(F.struct("was_home", *figures), F.struct("ingested_at", "row_id")).alias("x"))
    seen = last.where("x.minutes > 0").select("player_id", F.lit(None).cast("string").alias("full_name"), F.concat_ws("/", "fixture_id", F.col("x.was_home")).alias("event"), *[f"x.{c}" for c in figures])
    names = rows.groupBy("player_id").agg(F.max("full_name").alias("full_name"))
    return seen.unionByName(names, allowMissingColumns=True)


#: A foreign source's day is local, and a few matches were moved.
MOST_DAYS = 6


def with_day(rows: DataFrame, zones: DataFrame, text: str, prefix: bool) -> DataFrame:
    """``rows`` with ``day``: the day that a text gives, in any of the known forms; those with an ISO day are read at once."""
    order = zones.select(F.col("feed").alias("__feed"), F.col("date_order").alias("__order")).dropDuplicates(["__feed"])
    iso = F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    # eight feeds
    joined = rows.join(F.broadcast(order), rows["feed"] == order["__feed"], "left").withColumns({"__iso": iso, "__rest": F.when(iso.isNull(), F.col(text))})
    return add_day(joined, "__rest", "__order", "day", prefix).withColumn("day", F.coalesce("__iso", "day")).drop("__feed", "__order", "__iso", "__rest")


def _with_fixture(games: DataFrame, known: DataFrame) -> DataFrame:
    """(game, home, away, fixture_id): of the fixtures of a game's clubs the nearest in time.

    A game whose texts give no day at all has the only fixture of its clubs, if there is just one.
    """
    near = games.join(known.withColumnRenamed("day", "__day"), ["home", "away"]).withColumn("__gap", F.abs(F.datediff("day", "__day")))
    some = near.where((F.col("__gap") <= MOST_DAYS) | F.col("day").isNull())
    found = some.groupBy("game").agg(F.min_by("fixture_id", F.struct("__gap", "fixture_id")).alias("fixture_id"), F.max("home").alias("home"), F.max("away").alias("away"), F.min("__gap").alias("__gap"), F.countDistinct("fixture_id").alias("__n"))
    checkpoint_dir(games.sparkSession)
    return found.where("__gap is not null or __n = 1").drop("__gap", "__n").checkpoint()


def understat_appearances(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "understat_player_match_stats", "understat_player_id", "player_name", "team", "understat_match_id", "date", "feed", "side", "minutes", "goals", "assists")
    rows = rows.withColumnsRenamed({"understat_player_id": "id", "player_name": "name", "understat_match_id": "game"})
    # the club of a side is the one most of its players have; a transferred player's row names two
    home, single = F.col("side") == "h", ~F.col("team").contains(",")
    dated = with_day(rows.select("game", "team", "side", "date", "feed"), table(spark, root, "feed_zones"), "date", False)
    games = dated.groupBy("game").agg(F.mode(F.when(home & single, F.col("team")), True).alias("h"), F.mode(F.when(~home & single, F.col("team")), True).alias("a"), F.mode("day", True).alias("day"))
    games = games.select("game", club_key(F.col("h")).alias("home"), club_key(F.col("a")).alias("away"), "day")
    mapped = _with_fixture(games, fixtures(spark, root)).select("game", "fixture_id")
    one = rows.select("id", "name", "game", home.alias("side_home"), "minutes", "goals", "assists")
    return small_lookup(one, mapped, ["game"]).withColumn("event", F.concat_ws("/", "fixture_id", "side_home"))


def fbref_appearances(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "fbref_player_match_summary", "fbref_id", "player", "game_id", "game", "feed", "team", "min", "Performance_Gls", "Performance_CrdY")
    # a game's rows have few different texts, which are counted before they are taken apart
    texts = with_day(rows.groupBy(F.col("game_id").alias("id"), "game", "feed").agg(F.count("*").alias("n")), table(spark, root, "feed_zones"), "game", True)
    tail = F.element_at(F.split("game", "[0-9]"), -1)
    title = F.regexp_replace(tail, r"^(?:\s*\[[^\]]*\]|Z|\s*[AP]M(?=\s)|\s*(?:GMT|UTC|BST|WES?T|CES?T|E[SD]T|C[SD]T|BRT|IST|AE[SD]T)(?=\s))?\s*", "")
    cut = texts.select("id", "n", "day", F.explode(F.array(F.split(title, r"\s+v\s+|\s*[–—-]\s*"))).alias("clubs"))
    most = lambda c: F.max_by(c, F.struct(F.col("n"), c))
    games = cut.groupBy("id", "clubs", "day").agg(F.sum("n").alias("n")).groupBy("id").agg(most(F.col("clubs")).alias("clubs"), F.max_by("day", F.when(F.col("day").isNotNull(), F.struct("n", "day"))).alias("day"))
    games = games.select(F.col("id").alias("game"), club_key(F.get("clubs", F.lit(0))).alias("home"), club_key(F.get("clubs", F.lit(1))).alias("away"), "day")
    one = rows.select(F.col("fbref_id").alias("id"), F.col("player").alias("name"), F.col("game_id").alias("game"), "team", F.col("min").alias("minutes"), F.col("Performance_Gls").alias("goals"), F.col("Performance_CrdY").alias("yellow_cards"))
    both = small_lookup(one, _with_fixture(games, fixtures(spark, root)), ["game"]).select("*", F.explode(F.array(club_key(F.col("team")))).alias("club"))
    side = F.when(F.col("club") == F.col("home"), True).when(F.col("club") == F.col("away"), False)
    return both.withColumn("event", F.when(side.isNotNull(), F.concat_ws("/", "fixture_id", side))).drop("home", "away", "club", "team")


def p3_matches(spark: SparkSession, root: str) -> DataFrame:
    """Matched pairs of players and foreign persons with their probability."""
    hints = table(spark, root, "entity_matching_table", "player_id", "understat_name", "needs_review_understat", "fbref_name", "needs_review_fbref")
    left = matching.profiles(player_appearances(spark, root), "player_id", "full_name", "event", ["minutes"], ["goals", "assists", "yellow_cards"])
    people = {"understat": (understat_appearances(spark, root), ["goals", "assists"]), "fbref": (fbref_appearances(spark, root), ["goals", "yellow_cards"])}
    out = None
    for source, (seen, details) in people.items():
        right = matching.profiles(seen, "id", "name", "event", ["minutes"], details)
        sure = hints.where(F.col(f"{source}_name").isNotNull() & ~F.col(f"needs_review_{source}")).select(F.col("player_id").cast("string").alias("left_id"), F.col(f"{source}_name").alias("hinted"))
        pairs = matching.match(left, right, sure)
        one = pairs.select(F.col("left_id").cast("long").alias("player_id"), F.lit(source).alias("source"), F.col("right_id").alias("source_id"), "probability")
        out = one if out is None else out.unionByName(one)
    return out


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of a player and a person that are the same human being."""
    return p3_matches(spark, root).select("player_id", "source", "source_id")


# ---------------------------------------------------------------- p8 and p9: tokens and containers


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, root, "documents", "doc_id", "text"))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    """Where every document with text went, in containers of 2,048 tokens."""
    documents = table(spark, root, "documents", "doc_id", "text")
    return packing.pack(bpe.encode(documents, counts=True), documents.count())


# ---------------------------------------------------------------- p10: text quality


def p10_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Statistics, z-scores and verdict of every document."""
    return quality.score(table(spark, root, "documents", "doc_id", "text", "lang"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that are for the most part a list, a table or junk."""
    return p10_statistics(spark, root).where(~F.col("prose")).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical, "p3_found": p3_found, "p3_matches": p3_matches, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_statistics": p10_statistics}
