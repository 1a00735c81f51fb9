"""Text statistics, sketches and tails."""

from __future__ import annotations

import random

from tessara.llm import quality as Q
from tessara.sources.tables import table


def test_statistics_of_a_text():
    language, s = Q.statistics("The ball was lost.\nIt was 3 minutes into the game!")
    got = dict(zip(Q.STATISTICS, s))
    assert language == "en" and got["words"] == 10 and got["ended_lines"] == 1.0 and got["words_a_line"] == 5
    assert abs(got["digits"] - 1 / 40) < 1e-9 and abs(got["symbols"] - 2 / 40) < 1e-9


def test_texts_without_anything_visible():
    for text in ("", " \n\t ", "\u3000"):
        assert Q.statistics(text) == (None, (0.0,) * len(Q.STATISTICS))


def test_labelled_documents(spark, tiny):
    out = Q.score(table(spark, tiny, "documents", "doc_id", "text", "lang")).join(table(spark, tiny, "doc_labels").where("label is not null"), "doc_id").collect()
    assert out and all(r["prose"] == (r["label"] == "prose") for r in out)


SENTENCE = "After the break the side kept the ball and was close to the goal, but it was not enough for them to win."


def test_tails(spark):
    r = random.Random(1)
    words = SENTENCE.split()
    rows = [(k, " ".join(r.sample(words, len(words))) + ". " + SENTENCE, "en", 0) for k in range(60)]
    rows += [(100, "\n".join(f"- Name{k}: out!" for k in range(20)), "en", 0), (101, "a,b,c\n" + "\n".join(f"{k},{k * 7},x" for k in range(30)), None, 0), (102, "ha" * 500, "xx", 0), (103, None, "en", 0), (104, " \n", "en", 0), (105, SENTENCE * 2000, "EN", 0), (105, SENTENCE * 2000, "EN", 0), (106, "\n".join(words), "en", 0)]
    out = Q.score(spark.createDataFrame(rows, "doc_id int, text string, lang string, words int")).collect()
    assert len(out) == len(rows)
    assert {x["doc_id"] for x in out if not x["prose"]} == {100, 101, 102}
    assert {x["doc_id"]: x["z_common"] for x in out}[103] is None


def test_sketch_quantiles_are_near_exact_ones(spark):
    rows = [(k, " ".join(["the"] * (k % 97 + 1)), "en") for k in range(1000)]
    q = Q.quantiles(Q.text_statistics(spark.createDataFrame(rows, "doc_id int, text string, lang string"))).where("language = 'en'").first()
    exact = sorted(k % 97 + 1 for k in range(1000))
    assert all(abs(a - exact[int(1000 * p)]) <= 2 for a, p in zip(q["q_words"], (0.25, 0.5, 0.75)))


def test_empty(spark):
    assert Q.score(spark.createDataFrame([], "doc_id int, text string, lang string")).count() == 0


def test_a_language_that_is_mostly_junk(spark):
    """Four fifths of German, and all of French, are exports without a common word; Spanish isn't there at all."""
    prose = "Nach der Pause war er mit dem Ball auf der linken Seite und sah, dass sie nicht mehr in das Spiel kam. "
    table_ = "a1;b2;c3\n" + "\n".join(f"{k};{k * 7};x{k}" for k in range(30))
    rows = [(k, prose * 3, "de") for k in range(20)] + [(100 + k, table_ + f"\n{k};0", "de") for k in range(80)] + [(300 + k, f"x{k}-" * 40, "fr") for k in range(9)]
    out = Q.score(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()
    assert {x["doc_id"] for x in out if not x["prose"]} == {r[0] for r in rows if r[0] >= 100}


def test_junk_alone(spark):
    rows = [(k, f"x{k}-" * 40, "fr") for k in range(9)]
    out = Q.score(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()
    assert len(out) == 9 and not any(x["prose"] for x in out)


FOREIGN = {
    "ru": "После перерыва хозяева забили два мяча и больше не отдавали инициативу. Тренер сказал, что команда сыграла лучше, чем неделю назад.",
    "pl": "W drugiej połowie gospodarze zdobyli dwie bramki i nie oddali już prowadzenia. Trener powiedział, że drużyna zagrała lepiej niż tydzień temu.",
    "ja": "後半に入ると地元のチームは二点を取り、最後まで主導権を渡さなかった。監督は先週よりも良い試合だったと話した。",
    "pt": "Na segunda parte a equipa da casa marcou dois golos e não voltou a perder o controlo. O treinador disse que jogaram melhor do que na semana passada.",
    "fi": "Toisella puoliajalla kotijoukkue teki kaksi maalia eikä enää luopunut johdostaan. Valmentaja sanoi, että joukkue pelasi paremmin kuin viikko sitten.",
}


def test_prose_in_languages_without_a_list(spark, tiny):
    """Sentences stay prose whatever their language and label, beside the documents of the corpus; their junk does not."""
    corpus = table(spark, tiny, "documents", "doc_id", "text", "lang")
    rows = [(10**6 + 10 * k + j, text, label) for k, (own, text) in enumerate(FOREIGN.items()) for j, label in enumerate((own, None, "en", "xx"))]
    junk = "#!@%$;{}[]|~" * 30 + " 1204;99182;1;77 " * 30
    rows += [(2 * 10**6 + k, junk + text.split()[0], own) for k, (own, text) in enumerate(FOREIGN.items())]
    out = Q.score(corpus.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).where("doc_id >= 1000000").collect()
    assert len(out) == len(rows) and {r["doc_id"] for r in out if not r["prose"]} == {r[0] for r in rows if r[0] >= 2 * 10**6}


def test_labels_of_another_scale(spark):
    """Half of the labelled documents of tables that the limits were not looked at on."""
    from pathlib import Path

    from pyspark.sql import functions as F

    root = "/root/testdata/sf0.1"
    if not Path(root).exists():
        return
    labels = table(spark, root, "doc_labels").where("label is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    out = Q.score(table(spark, root, "documents", "doc_id", "text", "lang")).join(labels, "doc_id").select("prose", "label").collect()
    assert len(out) > 150 and sum(r["prose"] != (r["label"] == "prose") for r in out) <= 0.01 * len(out)
