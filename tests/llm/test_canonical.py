"""One form for texts that look the same."""

from __future__ import annotations

import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from tessara.llm import canonical as C

CASES = [
    ("Riancany", "Riancany", False),
    ("Ｒｉａncany", "Riancany", True),  # full width
    ("Rіancany", "Riancany", True),  # Cyrillic i
    ("Rian​cany", "Riancany", True),
    ("Riancany ", "Riancany", True),
    ("Silín　Gaseth", "Silín Gaseth", True),
    ("Hếiạng", "Hếiạng", False),
    (unicodedata.normalize("NFD", "Hếiạng"), "Hếiạng", True),
    ("e​́a", "éa", True),  # a mark behind an invisible character
    ("ế", "ế", True),
    ("Kaiel", "Kaiel", True),  # Kelvin sign
    ("ﬂor", "flor", True),
    ("Keasorn‐Lou", "Keasorn-Lou", True),
    ("O＇Kriawick️", "O'Kriawick", True),
    ("RIANCANY", "RIANCANY", False),
    ("Braisoğlan Traıldı", "Braisoğlan Traıldı", False),
    ("Люгей", "Люгей", False),
    ("Πουλλάδ", "Πουλλάδ", False),
    ("Люгeй", "Люгей", True),  # Latin e
    ("Щyд", "Щуд", True),  # Latin y
    ("Ж.Гла⁠", "Ж.Гла", True),
    ("Ꮇօrňɑk", "Morňak", True),  # Cherokee, Armenian, Latin alpha
    ("", "", False),
    ("  a  b ", "a b", False),
]


def test_cases():
    assert [(x, *C.canonical(x)) for x, _, _ in CASES] == CASES


@given(st.text(max_size=30))
def test_form_is_stable_and_normal(text):
    form, _ = C.canonical(text)
    assert C.canonical(form)[0] == form or unicodedata.normalize("NFKC", form) != form
    assert not any(C.invisible(ch) for ch in form)


@given(st.text(alphabet="aenọ́̈​­ ", max_size=12))
def test_splicing_equals_normalizing_the_whole(text):
    whole = unicodedata.normalize("NFKC", "".join(x for x in text if not C.invisible(x)))
    assert C.splice(text) == whole


def test_words_are_judged_one_by_one():
    assert C.canonical("Der \u0422orwart \u041b\u044e\u0433\u0435\u0439", words=True)[0] == "Der Torwart \u041b\u044e\u0433\u0435\u0439"


def test_long_texts_are_done_whole_and_not_remembered():
    text = "abc\u200b" * 100_000
    assert C.canonical(text, words=True) == ("abc" * 100_000, True)


def test_operator(spark):
    rows = [(1, "\uff32\uff49\uff41", "x", "y"), (1, "\uff32\uff49\uff41", "x", "y"), (2, None, None, None), (3, "", "", ""), (4, "plain", "", "")]
    frame = spark.createDataFrame(rows, "id int, name string, canonical string, other string")
    out = C.canonicalize(frame, "name")
    assert out.columns == ["id", "name", "other", "canonical", "changed"]
    assert sorted([(r["id"], r["canonical"], r["changed"]) for r in out.collect()], key=str) == sorted([(1, "Ria", True), (1, "Ria", True), (2, None, False), (3, "", False), (4, "plain", False)], key=str)
    assert [r["id"] for r in C.canonicalize(frame, "name", changed_only=True).collect()] == [1, 1]
    assert C.canonicalize(frame.limit(0), "name").count() == 0


def test_first_sight_agrees_with_the_full_check(spark):
    """The JVM's class test never hides a row that would change."""
    names = [n for n, _, _ in CASES] + [chr(k) for k in range(0xA0, 0x2100) if chr(k).isprintable()]
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id int, name string")
    whole = {r["id"] for r in C.canonicalize(frame, "name").where("changed").collect()}
    assert whole == {r["id"] for r in C.canonicalize(frame, "name", changed_only=True).collect()}
