"""Scalar text functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters that decompose into a Latin letter and marks, and that letter; others (ø, ß, ł) stay as they are."""
    pairs = {}
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(n))[0]
        if base != chr(n) and base.isascii() and base.isalpha():
            pairs[chr(n)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def strip_accents(text: Column) -> Column:
    """Composed Latin letters without their marks; a native ``translate``, no UDF."""
    return F.translate(text, _FROM, _TO)


def simple_name(text: Column) -> Column:
    """Lower case without accents, white space collapsed; '' for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(strip_accents(text)), r"\s+", " ")), F.lit(""))


def strict_name(text: Column, nicknames: dict[str, str] | None = None) -> Column:
    """``simple_name`` with letters and digits only; a nickname as first word becomes its full form."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(simple_name(text), r"[^a-z0-9\s]", ""), r"\s+", " "))
    if not nicknames:
        return plain
    names = F.create_map(*[F.lit(x) for pair in nicknames.items() for x in pair])
    words = F.split(plain, " ")
    return F.array_join(F.concat(F.array(F.coalesce(F.try_element_at(names, F.get(words, F.lit(0))), F.get(words, F.lit(0)))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))), " ")


def alias(text: Column, names: dict[str, str]) -> Column:
    """A value's alias, or the value itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), text), text)


def parts(text: Column, separator: str = ",") -> Column:
    """Trimmed parts of a list in a text, empty ones left out."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def number_after(text: Column, pattern: str, group: int = 1) -> Column:
    """The number that a pattern's group finds; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def contains_word(text: Column, asked: str) -> Column:
    """Literal, case-insensitive; a null text contains nothing."""
    return F.coalesce(F.contains(F.lower(text), F.lit(asked.lower())), F.lit(False))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity from 0 to 100 of two names with their words in sorted order, by edit distance."""
    def key(x: Column) -> Column:
        return F.array_join(F.array_sort(F.split(strict_name(x), " ")), " ")

    x, y = key(a), key(b)
    return 100 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))


def feature_family(feature: Column, merged: dict[str, str] | None = None) -> Column:
    """A generated feature's family: its name without side and window prefixes; related families may share a name."""
    family = F.regexp_replace(feature, r"^(?:opp_|own_)?(?:team_)?(?:roll\d+_|season_)?", "")
    return alias(family, merged) if merged else family
