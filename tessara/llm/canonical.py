"""One consistent form for texts that look the same.

A text is *stable* if every character passes the normalization quick check: it is composed, of ordinary width, visible,
and no look-alike. Plain ASCII and the composed letters of the Latin script pass without further thought, which the JVM
tests by one character class. In other texts the unstable characters are found; each becomes a segment together with
its boundary context (the starter before it, the marks and invisible characters around it), only segments are
normalized, and the results are spliced into the unchanged rest. Letters of a foreign script that look like letters of
the text's own script are then replaced.

Scale: a narrow map without shuffle; for ``changed`` rows only, the JVM's class test keeps nearly all rows from Python.
In Python a batch is dictionary-encoded, so that a name repeated in it is treated once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessara.session import ship

# Letters that look like a Latin letter, by script. First the foreign letter, then the Latin one.
LOOKALIKES = {
    "CYRILLIC": "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv үy АA ВB ЕE НH ІI ЈJ КK МM ОO РP ЅS СC ТT УY ҮY ХX ԌG ԚQ ԜW ѴV ӀI",
    "GREEK": "αa οo νv ιi ρp υu κk χx γy ηn ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX",
    "ARMENIAN": "օo սu հh ոn ցg զq ղn ՍU ՕO ԼL Տs",
    "CHEROKEE": "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏂH ᏃZ ᏎA ᏏB ᏒR ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏧJ ᏴB ᏻG ᏮB",
    "LATIN": "ɑa ɡg ɩi",
}
TO_LATIN = {pair[0]: pair[1] for pairs in LOOKALIKES.values() for pair in pairs.split()}
#: The same the other way, for a Latin letter in a Cyrillic or Greek text; the first letter listed for it counts.
FROM_LATIN = {script: {pair[1]: pair[0] for pair in reversed(LOOKALIKES[script].split())} for script in ("CYRILLIC", "GREEK")}
HYPHENS = frozenset("‐‑‒–−﹣－")
APOSTROPHES = frozenset("’ʼ‘＇ʹ")
#: Composed Latin letters that normalization leaves alone; with visible ASCII they make a text stable at first sight.
STABLE = r"\t\n\x0b\x0c\r -~À-ÖØ-öø-ıĴ-ľŁ-ňŊ-žƠơƯưǍ-ǜȘ-țḀ-ẙẠ-ỹ"
_FIRST_SIGHT = re.compile(f"[^{STABLE}]")


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    """LATIN, CYRILLIC ... of a letter, '' of anything else."""
    return unicodedata.name(ch, "").split(" ")[0].replace("FULLWIDTH", "LATIN").replace("KELVIN", "LATIN") if ch.isalpha() else ""


@lru_cache(maxsize=65536)
def invisible(ch: str) -> bool:
    """Has no width of its own and is no mark of a letter: format characters, joiners, variation selectors, controls."""
    c, n = unicodedata.category(ch), ord(ch)
    return c == "Cf" or (c == "Cc" and ch not in "\t\n\r\x0b\x0c\x85") or n in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= n <= 0x180F or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF


@lru_cache(maxsize=65536)
def unstable(ch: str) -> bool:
    """Fails the quick check: may change under composition, has another width or form, is invisible or no plain space."""
    if ch < "\x80":
        return invisible(ch)
    c = unicodedata.category(ch)
    return c[0] == "M" or c == "Zs" or ch in HYPHENS or ch in APOSTROPHES or invisible(ch) or not unicodedata.is_normalized("NFKC", ch)


def _segment(text: str) -> str:
    kept = "".join("-" if x in HYPHENS else "'" if x in APOSTROPHES else " " if unicodedata.category(x) == "Zs" else x for x in text if not invisible(x))
    return "".join("-" if x in HYPHENS else x for x in unicodedata.normalize("NFKC", kept))


def splice(text: str) -> str:
    """``text`` with its unstable segments normalized."""
    out, done, n, i = [], 0, len(text), 0
    while i < n:
        if not unstable(text[i]):
            i += 1
            continue
        begin, end = i, i + 1
        while begin > done and unicodedata.combining(text[begin]):
            begin -= 1  # the starter that a mark may compose with
        while end < n and (unstable(text[end]) or unicodedata.combining(text[end])):
            end += 1
        segment = text[begin:end]
        # a mark after an invisible character composes with the letter before that
        rest = "".join(x for x in segment if not invisible(x))
        if begin > done and rest and unicodedata.combining(rest[0]):
            begin -= 1
            segment = text[begin:end]
        out += [text[done:begin], _segment(segment)]
        done = i = end
    out.append(text[done:])
    return "".join(out)


def own_script(text: str) -> str:
    """The script of most of the letters that look like no letter of another script; LATIN if there are none."""
    seen: dict[str, int] = {}
    for ch in text:
        s = script(ch)
        if not s or ch in TO_LATIN:
            continue
        if s == "LATIN" and (ch in FROM_LATIN["CYRILLIC"] or ch in FROM_LATIN["GREEK"]):
            continue
        seen[s] = seen.get(s, 0) + 1
    return max(seen, key=lambda s: (seen[s], s == "LATIN")) if seen else "LATIN"


def replace_lookalikes(text: str) -> str:
    """Letters of another script than the text's own become the letters of that script that they look like."""
    own = own_script(text)
    if own == "LATIN":
        return "".join(TO_LATIN.get(ch, ch) for ch in text)
    table = FROM_LATIN.get(own)
    if table is None:
        return text
    back = lambda ch: ch if script(ch) == own else table.get(TO_LATIN.get(ch, ch), ch)
    return "".join(back(ch) for ch in text)


_WORDS = re.compile(r"(\s+)")


def canonical(text: str, words: bool = False) -> tuple[str, bool]:
    """The one form of a text, and whether it held other characters than that form's own.

    ``words``: the script is judged word by word (running text) instead of once (a name). Runs of white space inside a
    name become one space and its ends are trimmed; that alone doesn't count as a change. '' stays ''.
    """
    return _short(text, words) if len(text) <= KEPT else _canonical(text, words)


def _canonical(text: str, words: bool) -> tuple[str, bool]:
    if not _FIRST_SIGHT.search(text):
        plain, changed = text, False
    else:
        plain = splice(text)
        plain = "".join(replace_lookalikes(w) for w in _WORDS.split(plain)) if words else replace_lookalikes(plain)
        changed = plain != text
    return (plain if words else " ".join(plain.split())), changed


#: Only short texts are remembered, so that a worker's memory stays bounded.
KEPT = 200
_short = lru_cache(maxsize=100_000)(_canonical)


def maybe_unstable(text: Column) -> Column:
    """False for texts that are surely stable: one character class, in the JVM."""
    return text.rlike(f"[^{STABLE}]")


def canonicalize(frame: DataFrame, text: str, words: bool = False, changed_only: bool = False) -> DataFrame:
    """``frame`` with ``canonical`` (string) and ``changed`` (boolean) for the column ``text``.

    A null text has a null form and isn't changed; an empty one stays empty. Existing columns of these two names are
    replaced. ``changed_only``: only rows with other characters come back; most others never leave the JVM.
    """
    keep = [c for c in frame.columns if c not in ("canonical", "changed")]
    ship(frame.sparkSession)
    frame = frame.select(*keep)
    if changed_only:
        frame = frame.where(maybe_unstable(F.col(text)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(at).dictionary_encode()
            forms = [canonical(x, words) for x in coded.dictionary.to_pylist()]
            one = pa.array([f[0] for f in forms], pa.string()).take(coded.indices)
            other = pa.array([f[1] for f in forms], pa.bool_()).take(coded.indices).fill_null(False)
            out = pa.RecordBatch.from_arrays([*batch.columns, one, other], names=[*keep, "canonical", "changed"])
            yield out.filter(other) if changed_only else out

    return frame.mapInArrow(run, f"{kinds}, canonical string, changed boolean")
