"""Queries that check text results by what must hold of them, and the SQL of the text queries.

Where SQL cannot compute a result, it states it another way: a text's tokens decode to its bytes, a container is no
larger than its capacity, a person is matched once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessara.llm import bpe, canonical, packing, quality, queries
from tessara.llm.matching import folded
from tessara.session import ship
from tessara.sources.tables import table


def decode(frame: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = bpe.VOCABULARY) -> DataFrame:
    """(key, bytes): what the token ids of a row stand for; a null list stands for nothing."""
    ship(frame.sparkSession)
    kind = frame.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {n: piece for piece, n in bpe.encoder(path).ranks.items()}
        for batch in batches:
            raw = [b"".join(pieces[n] for n in one or []) for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[key, "bytes"])

    return frame.select(key, ids).mapInArrow(run, f"`{key}` {kind}, bytes binary")


def p8_decoded(spark: SparkSession, root: str) -> DataFrame:
    """The size and digest of what each document's tokens decode to: those of its text."""
    raw = decode(queries.p8_ids(spark, root))
    return raw.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.md5("bytes").alias("digest"))


def p8_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many documents have no token, and whether each token stands for a byte at least."""
    ids = queries.p8_ids(spark, root).join(table(spark, root, "documents", "doc_id", "text"), "doc_id")
    n = F.size("ids")
    return ids.agg(F.count("*").alias("n"), F.count_if(n == 0).alias("empty"), F.count_if(n > F.octet_length(F.coalesce("text", F.lit("")))).alias("more_than_bytes"))


def p9_placed(spark: SparkSession, root: str) -> DataFrame:
    """Each document that has tokens: whether its pieces follow each other without gap and hold all its tokens."""
    placed = queries.p9_containers(spark, root)
    w = Window.partitionBy("doc_id").orderBy("start")
    joined = placed.withColumn("__next", F.coalesce(F.lag(F.col("start") + F.col("n_tokens")).over(w), F.lit(0)))
    whole = joined.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count_if(F.col("__next") != F.col("start")).alias("gaps"))
    sizes = bpe.encode(table(spark, root, "documents", "doc_id", "text"), counts=True).where("n_tokens > 0")
    out = sizes.join(whole, "doc_id", "left")
    return out.select("doc_id", (F.col("placed") == F.col("n_tokens")).cast("int").alias("is_whole"), F.col("gaps"))


def p9_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers over capacity, places that overlap, pieces cut without need, and whether nearly all space is used."""
    placed = queries.p9_containers(spark, root)
    w = Window.partitionBy("container").orderBy("place")
    marked = placed.withColumn("__end", F.coalesce(F.lag(F.col("place") + F.col("n_tokens")).over(w), F.lit(0)))
    each = marked.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count_if(F.col("__end") != F.col("place")).alias("overlaps"), F.count_if((F.col("piece") > 0) & (F.col("start") % packing.CAPACITY != 0)).alias("cuts"))
    full = F.sum("n") > 0.99 * packing.CAPACITY * (F.count("*") - 1)
    return each.agg(F.count_if(F.col("n") > packing.CAPACITY).alias("over"), F.sum("overlaps").alias("overlaps"), F.sum("cuts").alias("cuts"), full.cast("int").alias("is_full"))


def p3_once(spark: SparkSession, root: str) -> DataFrame:
    """By source: matches, how many sides occur twice, probabilities out of range, and whether matches agree with sure hints."""
    found = queries.p3_matches(spark, root)
    names = {"understat": ("understat_player_match_stats", "understat_player_id", "player_name"), "fbref": ("fbref_player_match_summary", "fbref_id", "player")}
    out = None
    hints = table(spark, root, "entity_matching_table", "player_id", "understat_name", "needs_review_understat", "fbref_name", "needs_review_fbref")
    for source, (name, key, column) in names.items():
        people = table(spark, root, name, key, column).groupBy(F.col(key).alias("source_id")).agg(F.max(column).alias("name"))
        sure = hints.where(~F.col(f"needs_review_{source}")).groupBy("player_id").agg(F.max(f"{source}_name").alias("hinted"))
        one = found.where(F.col("source") == source).join(people, "source_id", "left").join(sure, "player_id", "left")
        same = folded(F.col("name")) == folded(F.col("hinted"))
        each = one.agg(F.count("*").alias("n"), F.countDistinct("player_id").alias("players"), F.countDistinct("source_id").alias("people"), F.count_if(~F.col("probability").between(0.5, 1)).alias("out_of_range"), F.count_if(F.col("name").isNull()).alias("unknown"), (F.count_if(same) / F.count(same)).alias("agree"))
        row = each.select(F.lit(source).alias("source"), (F.col("n") - F.col("players")).alias("players_twice"), (F.col("n") - F.col("people")).alias("people_twice"), "out_of_range", "unknown", (F.col("agree") > 0.8).cast("int").alias("mostly_as_hinted"))
        out = row if out is None else out.unionByName(row)
    return out


def p10_counts(spark: SparkSession, root: str) -> DataFrame:
    """The counts that a document's statistics rest on."""
    stats = quality.text_statistics(table(spark, root, "documents", "doc_id", "text", "lang"))
    whole = lambda c: F.round(c, 9)
    return stats.select("doc_id", F.col("visible").cast("int").alias("is_visible"), F.col("words").cast("long").alias("words"), whole(F.col("digits")).alias("digits"), F.col("longest").cast("long").alias("longest"))


def p10_tails(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts against the labelled documents: how many of each, and whether at least 99 in a hundred agree."""
    found = queries.p10_statistics(spark, root).select("doc_id", "prose").join(table(spark, root, "doc_labels").where("label is not null"), "doc_id")
    return found.groupBy((F.col("label") == "prose").cast("int").alias("is_prose")).agg(F.count("*").alias("n"), (F.avg((F.col("prose") == (F.col("label") == "prose")).cast("int")) >= 0.99).cast("int").alias("mostly_right"))


QUERIES = {f.__name__: f for f in (p8_decoded, p8_counts, p9_placed, p9_fill, p3_once, p10_counts, p10_tails)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _p2_sql(changed_only: bool) -> str:
    """The same reading in SQL, over whole names: widths, spaces, hyphens, composition, then look-alikes by script."""
    # full-width, letterlike and mathematical letters; then ligatures and digraphs, which stand for several letters
    forms = {ch: unicodedata.normalize("NFKC", ch) for n in [*range(0x1C4, 0x1CD), *range(0x2100, 0x2150), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)] for ch in [chr(n)]}
    single = {x: y for x, y in forms.items() if len(y) == 1 and x != y}
    wide, plain = "".join(single), "".join(single.values())
    joined = "t"
    for x, y in forms.items():
        if len(y) > 1 and y.isalpha():
            joined = f"replace({joined}, '{x}', '{y}')"
    to_latin = canonical.TO_LATIN

    def table_of(script: str) -> tuple[str, str]:
        back = canonical.FROM_LATIN[script]
        pairs = dict(back) | {x: back[y] for x, y in to_latin.items() if y in back and canonical.script(x) not in (script, "")}
        return "".join(pairs), "".join(pairs.values())

    unlike = {s: "".join(x for x in to_latin if canonical.script(x) == s.upper()) for s in ("Cyrillic", "Greek")}
    latin_like = "".join(sorted({*canonical.FROM_LATIN["CYRILLIC"], *canonical.FROM_LATIN["GREEK"], *(x for x in to_latin if canonical.script(x) == "LATIN")}))
    count = lambda script, but: f"length(regexp_replace(translate(b, {_quoted(but)}, ''), '[^\\p{{{script}}}]', '', 'g'))"
    cut = lambda letters: f"translate(b, {', '.join(map(_quoted, letters))})"
    source = " union all ".join(f"select '{t}' as source_table, row_id, {c} as name from {t}" for t, c in queries.NAMED.items())
    hyphens, apostrophes = "".join(sorted(canonical.HYPHENS)), "".join(sorted(canonical.APOSTROPHES))
    return f"""
with n as ({source}),
a as (select *, translate(translate(regexp_replace(regexp_replace(name, '\\p{{Zs}}', ' ', 'g'), '[\\p{{Cf}}\\x{{034F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{180B}}-\\x{{180F}}]', '', 'g'), {_quoted(hyphens)}, '{"-" * len(hyphens)}'), {_quoted(apostrophes)}, {_quoted("'" * len(apostrophes))}) as t from n),
w as (select *, nfc_normalize(translate({joined}, {_quoted(wide)}, {_quoted(plain)})) as b from a),
s as (select *, {count("Latin", latin_like)} as latin, {count("Cyrillic", unlike["Cyrillic"])} as cyrillic, {count("Greek", unlike["Greek"])} as greek from w),
c as (select *, case when cyrillic > latin and cyrillic >= greek then {cut(table_of("CYRILLIC"))} when greek > latin then {cut(table_of("GREEK"))} else {cut(("".join(to_latin), "".join(to_latin.values())))} end as f from s),
d as (select source_table, row_id, name, trim(regexp_replace(f, '\\s+', ' ', 'g')) as canonical, coalesce(f <> name, false) as changed from c)
select source_table, row_id{"" if changed_only else ", name, canonical, changed"} from d{" where changed" if changed_only else ""}"""


_TEXT = "select doc_id, coalesce(text, '') as t from documents"
SQL = {
    "p2_found": _p2_sql(True),
    "p2_canonical": _p2_sql(False),
    "p8_decoded": f"select doc_id, cast(strlen(t) as bigint) as n_bytes, md5(t) as digest from ({_TEXT})",
    "p8_counts": "select count(*) as n, count(*) filter (where coalesce(text, '') = '') as empty, cast(0 as bigint) as more_than_bytes from documents",
    "p9_placed": "select doc_id, 1 as is_whole, cast(0 as bigint) as gaps from documents where text <> ''",
    "p9_fill": "select cast(0 as bigint) as over, cast(0 as bigint) as overlaps, cast(0 as bigint) as cuts, 1 as is_full",
    "p3_once": "select unnest(['understat', 'fbref']) as source, cast(0 as bigint) as players_twice, cast(0 as bigint) as people_twice, cast(0 as bigint) as out_of_range, cast(0 as bigint) as unknown, 1 as mostly_as_hinted",
    "p10_counts": rf"""
with d as ({_TEXT}),
r as (select *, regexp_extract_all(t, '[^\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+') as runs from d)
select doc_id, cast(len(runs) > 0 as int) as is_visible,
    case when len(runs) = 0 then 0 else cast(len(regexp_extract_all(t, '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:[''’][\p{{L}}\p{{Nl}}\p{{No}}]+)*')) as bigint) end as words,
    case when len(runs) = 0 then 0 else round(cast(length(regexp_replace(t, '[^\p{{Nd}}²³¹⁰-⁹₀-₉]', '', 'g')) as double) / list_sum(list_transform(runs, lambda x: length(x))), 9) end as digits,
    cast(coalesce(list_max(list_transform(runs, lambda x: length(x))), 0) as bigint) as longest from r""",
    "p10_tails": "select cast(label = 'prose' as int) as is_prose, count(*) as n, 1 as mostly_right from doc_labels join documents using (doc_id) where label is not null group by 1",
}
