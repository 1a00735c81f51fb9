"""Text quality statistics of documents, and the tails of their distributions.

Each text gets its statistics in one pass. Over the documents that show their language by its common words a mergeable
quantile sketch of each statistic is built, language by language; with its quartiles a value becomes a robust z-score,
its distance from the median in units of the spread. Documents with several values in the tails are flagged: most lists,
tables and junk have hardly any common words, and other symbols, digits, sentence ends, runs or repetitions than prose.

Scale: the statistics are a narrow map over whole texts. Their few numbers are cut from the texts by a checkpoint, so
that texts are read once. A sketch has a bounded size and merges on the map side; the table of quartiles has one row for
each language, of which there are at most ``len(COMMON) + 1``, and is the only thing broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessara.session import checkpoint_dir, ship

# Common words of four languages.
COMMON = {
    "en": "a about after all although an and any anyone are as at away back be been before between but by can come could do does down each early even every everyone few for from full had has have he her his how i if in into is it its just less like many more most much no nobody nor not now of off on once one only or other our out over own she should since so some still such than that the their them then there these they this those though three through to too two under until up was we were what when where which while who will with without would you your",
    "es": "a al algo antes así aunque bien cada casi como con contra cuando de del desde después dos durante el ella en entre era es esta está este esto fue ha hace hacia hasta hay la las le les lo los mal me mejor menos mi mientras mucho muy más nada nadie ni no nos o otra otro para pero poco por porque pues que quien se sea ser si sin sobre solo son su sus también tan tanto tiene todo tras tres tu un una unos vez y ya",
    "de": "aber alle als am an auch auf aus bei bis da damit dann das dass dem den der des die dies diese dieser doch du durch ein eine einem einen einer er es etwas für gegen hat hatte ihr ihre im immer in ist ja jede kann kaum kein keine man mehr mit muss nach nicht nichts noch nun nur ob oder ohne sehr sein seine sich sie sind so sollte um und uns unter vom von vor war was weil wenn wer wie wir wird wurde zu zum zur zwei über",
    "fr": "a ai ainsi alors après au aucun aussi autre aux avant avec bien c'est car ce cela ces cette chaque comme contre d'un d'une dans de des deux donc dont du elle en encore entre est et fait fois il ils je la le les leur lui là mais mieux moins même n'a ne ni nos nous on ont ou où par pas pendant peu plus pour près qu'il que quel qui quoi rien sa sans se ses si son sont sous sur tous tout toute très trop trois un une vers vous à était été",
}
WORD_SETS = {language: frozenset(words.split()) for language, words in COMMON.items()}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = tuple(".!?…。！？\"”»)")
#: A sentence ends here: a mark before white space, a closing quote or the end; in some scripts the mark alone.
_SENTENCE = re.compile(r"[.!?…](?=[\s\"'”’»)\]]|$)|[。！？]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]")
_LETTER = re.compile(r"[^\W\d_]")
#: Marks of sentences in scripts that write no spaces; in other scripts these are symbols like any other.
_WIDE_MARKS = re.compile(r"[、。「」『』，！？：；]")
#: The share of common words from which a text shows its language by itself; names alone have less.
DETECTED = 0.15
STATISTICS = ("words", "mean_word", "symbols", "digits", "ended_lines", "common", "words_a_line", "longest", "distinct", "marks")
#: The language of a text mostly in letters that none of the known languages writes: its common words say nothing.
OTHER = "other"


def statistics(text: str) -> tuple[str | None, tuple[float, ...]]:
    """The language whose common words the text has most of (``OTHER`` or None if they are few), and its statistics.

    words: number of words. mean_word: their mean length. symbols, digits: shares of the visible characters that are
    neither letters nor digits, or digits. ended_lines: share of lines that end in punctuation. common: share of words
    that are common in the language. words_a_line: mean words of a line. longest: the longest run without white space.
    distinct: share of different words. marks: sentence ends for each word. A text without visible characters has 0 for
    all.
    """
    words = _WORD.findall(text.lower())
    lines = [x for x in (y.strip() for y in text.splitlines()) if x]
    runs = text.split()
    visible = sum(map(len, runs))
    if not visible:
        return None, (0.0,) * len(STATISTICS)
    n = len(words)
    letters, digits = sum(map(len, words)), sum(map(str.isdigit, text))
    hits = {language: sum(w in known for w in words) for language, known in WORD_SETS.items()}
    language: str | None = max(hits, key=lambda x: hits[x])
    share = hits[language] / n if n else 0.0
    marks_of_script = 0
    if share < DETECTED:
        foreign = 2 * len(_LATIN.findall(text)) < len(_LETTER.findall(text))
        language = OTHER if foreign else None
        marks_of_script = len(_WIDE_MARKS.findall(text)) if foreign else 0
    return language, (
        float(n),
        letters / n if n else 0.0,
        max(0.0, (visible - letters - digits - marks_of_script) / visible),
        digits / visible,
        sum(x.endswith(_END) for x in lines) / len(lines),
        share,
        n / len(lines),
        float(max(map(len, runs))),
        len(set(words)) / n if n else 0.0,
        len(_SENTENCE.findall(text)) / n if n else 0.0,
    )


def text_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, language, visible, statistics): one row for each document.

    ``language``: the detected one, ``OTHER`` for other letters, else the document's own if known, else ``und``. A null text counts as an empty one;
    ``visible`` is false for both and for white space only.
    """
    ship(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key), F.lower(F.col(language)).alias("__l"), F.coalesce(F.col(text), F.lit("")).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x if x in COMMON else "und" for x in batch.column(1).to_pylist()]
            found = [statistics(x) for x in batch.column(2).to_pylist()]
            columns = [pa.array(c, pa.float64()) for c in zip(*(s for _, s in found))] if found else [pa.array([], pa.float64())] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d or o for (d, _), o in zip(found, own)], pa.string()), pa.array([s[STATISTICS.index("longest")] > 0 for _, s in found], pa.bool_()), *columns],
                names=[key, "language", "visible", *STATISTICS],
            )

    return rows.mapInArrow(run, f"`{key}` {kind}, language string, visible boolean, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A sketch's size: with 4,096 a rank is off by less than one in a thousand.
SKETCH = 4096
#: The least scale of a statistic; below it a language's documents are so alike that any difference would be a tail.
LEAST_SCALE = {"common": 0.045, "words_a_line": 3.0, "symbols": 0.01, "digits": 0.01, "mean_word": 0.3, "marks": 0.01, "longest": 2.0, "distinct": 0.05}
#: Quartiles of prose, for want of any document that shows its language.
USUAL = {"words": (50, 100, 200), "mean_word": (4.2, 4.5, 5.0), "symbols": (0.02, 0.025, 0.03), "digits": (0, 0.003, 0.01), "ended_lines": (0.5, 1, 1), "common": (0.45, 0.5, 0.55), "words_a_line": (12, 50, 80), "longest": (11, 13, 16), "distinct": (0.5, 0.65, 0.8), "marks": (0.04, 0.055, 0.08)}
#: A z-score beyond this is in the tail (the customary limit of robust z-scores); beyond twice this it counts double.
TAIL = 3.5
#: Signs from which a document isn't prose; few common words are two of them.
SIGNS = 3


def quantiles(rows: DataFrame) -> DataFrame:
    """(language, n, q_<statistic>): quartiles of each statistic over all documents that show their language.

    Other documents are left out: else quartiles would follow the share of junk that a source labels as a language. The
    row of ``und`` comes from the merged sketches of all languages, or is ``USUAL`` if no document shows a language.
    """
    points = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    sketched = rows.where(F.col("visible") & (F.col("common") >= DETECTED)).groupBy("language").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(s, F.lit(SKETCH)).alias(s) for s in STATISTICS])
    merged = sketched.agg(F.lit("und").alias("language"), F.sum("n").alias("n"), *[F.kll_merge_agg_double(F.col(s), F.lit(SKETCH)).alias(s) for s in STATISTICS])
    read = lambda frame: frame.select("language", F.coalesce("n", F.lit(0)).alias("n"), *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(s), points)).alias(f"q_{s}") for s in STATISTICS])
    usual = {s: F.array(*[F.lit(float(x)) for x in USUAL[s]]) for s in STATISTICS}
    return read(sketched).unionByName(read(merged).withColumns({f"q_{s}": F.coalesce(f"q_{s}", usual[s]) for s in STATISTICS}))


def z_score(statistic: str) -> Column:
    """Robust z-score: distance from the median in units of the spread of its half, or of the least scale if larger."""
    low, middle, high = (F.get(F.col(f"q_{statistic}"), F.lit(k)) for k in range(3))
    gap = F.col(statistic) - middle
    spread = F.when(gap < 0, middle - low).otherwise(high - middle) / 0.6745
    return gap / F.greatest(spread, F.lit(LEAST_SCALE.get(statistic, 1e-6)))


def signs() -> Column:
    """How many signs of a list, a table or junk the z-scores are.

    Two for few common words; one each for many symbols or digits, a long run, few sentence ends and repetition, and two
    if far out; long words are signs of the same kind only where common words are not few (a language that is taken for
    another, or has no list, has few of them and words of another length). Null z-scores are no signs.
    """
    few = F.coalesce(F.col("z_common") < -TAIL, F.lit(False))
    out = F.when(few, 2).otherwise(0)
    for statistic, side in (("symbols", 1), ("digits", 1), ("longest", 1), ("marks", -1), ("distinct", -1), ("mean_word", 1)):
        z = F.coalesce(F.col(f"z_{statistic}") * side, F.lit(0.0))
        mark = F.when(z > 2 * TAIL, 2).when(z > TAIL, 1).otherwise(0)
        out = out + (F.when(~few, mark).otherwise(0) if statistic == "mean_word" else mark)
    return out


def score(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, language, visible, statistics, z_<statistic>, prose): ``prose`` is false in the tails.

    Not prose: ``SIGNS`` signs in the tails, and fewer common words than the language's median by a spread at least.
    A text in letters of no known language has no z-scores of its words and is judged by the other signs. Short lines
    are no sign: prose may be broken anywhere. Documents without visible characters have no z-scores and count as prose,
    as nothing in them is a list, a table or junk.
    """
    checkpoint_dir(documents.sparkSession)
    rows = text_statistics(documents, key, text, language).checkpoint()
    known = quantiles(rows)
    of = known.withColumnRenamed("language", "__of").drop("n")
    every = [F.col(f"q_{s}").alias(f"__u_{s}") for s in STATISTICS]
    # a row for each language, and one for documents of a language without a row of its own
    joined = rows.join(F.broadcast(of), F.col("language") == F.col("__of"), "left").join(F.broadcast(known.where("language = 'und'").select(*every)))
    joined = joined.withColumns({f"q_{s}": F.coalesce(f"q_{s}", f"__u_{s}") for s in STATISTICS})
    seen = {s: F.col("visible") & (F.col("language") != OTHER) if s in ("common", "mean_word") else F.col("visible") for s in STATISTICS}
    scored = joined.withColumns({f"z_{s}": F.when(seen[s], z_score(s)) for s in STATISTICS})
    tail = F.col("visible") & (F.coalesce("z_common", F.lit(-2.0)) < -1) & (signs() >= SIGNS)
    return scored.select(key, "language", "visible", *STATISTICS, *[f"z_{s}" for s in STATISTICS], (~F.coalesce(tail, F.lit(False))).alias("prose"))
