"""Instants from mixed timestamp texts.

All formats are compiled into one regular expression whose alternatives have named groups. One pass over a text puts
its components in fixed order into one string; they are checked against the calendar, and the instant is assembled
through integer day arithmetic. A text without zone or offset is read in its feed's zone. Everything is a Column
expression: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their minutes from UTC.
ZONE_MINUTES = {
    "GMT": 0, "UTC": 0, "Z": 0, "BST": 60, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "BRT": -180, "IST": 330, "AEST": 600, "AEDT": 660,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_TIME = r"(?<h{k}>\d{{1,2}}):(?<i{k}>\d{{2}})(?::(?<s{k}>\d{{2}})(?:[.,]\d{{1,9}})?)?"
_HALF = r"(?:\s?(?<a{k}>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s?(?<o{k}>[+-]\d{{2}}:?\d{{2}}|" + "|".join(sorted(ZONE_MINUTES, key=len, reverse=True)) + r")(?![A-Za-z0-9])(?:\[[A-Za-z_/+-]+\])?)?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_MONTH = r"(?<n{k}>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
#: Alternatives, first match wins. y m d: date by numbers; x y2: numbers in the feed's order; n: month name; e: epoch.
FORMATS = (
    r"(?<y{k}>\d{{4}})[-/.](?<m{k}>\d{{1,2}})[-/.](?<d{k}>\d{{1,2}})(?:[T ]\s*" + _TIME + _HALF + _ZONE + r")?",
    r"(?<y{k}>\d{{4}})(?<m{k}>\d{{2}})(?<d{k}>\d{{2}})T(?<h{k}>\d{{2}})(?<i{k}>\d{{2}})(?<s{k}>\d{{2}})?" + _ZONE,
    r"(?<p{k}>\d{{1,2}})[/.-](?<q{k}>\d{{1,2}})[/.-](?<y{k}>\d{{4}}|\d{{2}})(?:,?\s+" + _TIME + _HALF + _ZONE + r")?",
    _WEEKDAY + r"(?<d{k}>\d{{1,2}})(?:st|nd|rd|th)?[ -]" + _MONTH + r",?[ -](?<y{k}>\d{{4}}|\d{{2}})(?:,?\s+" + _TIME + _HALF + _ZONE + r")?",
    _WEEKDAY + _MONTH + r"\s+(?<d{k}>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y{k}>\d{{4}})(?:,?\s+" + _TIME + _HALF + _ZONE + r")?",
    r"(?<e{k}>\d{{13}}|\d{{9,10}})",
)
_PARTS = ("y", "m", "d", "p", "q", "n", "h", "i", "s", "a", "o", "e")
_MARK = "\u0001"


def pattern(prefix: bool) -> str:
    """The alternation. ``prefix``: a text may go on after white space (a match title after its time)."""
    alternatives = "|".join(f"(?:{f.format(k=chr(97 + k))})" for k, f in enumerate(FORMATS))
    return r"(?is)^\s*(?:" + alternatives + r")" + (r"(?:\s.*)?$" if prefix else r"\s*$")


def _replacement() -> str:
    groups = [[chr(97 + k) for k, f in enumerate(FORMATS) if f"(?<{part}{{k}}>" in f] for part in _PARTS]
    return _MARK + _MARK.join("".join(f"${{{part}{k}}}" for k in ks) for part, ks in zip(_PARTS, groups))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar, in integers only."""
    year = F.when(m <= 2, y - 1).otherwise(y)
    shifted = F.when(m > 2, m - 3).otherwise(m + 9)
    of_year = F.expr("0") + F.floor((shifted * 153 + 2) / 5) + d - 1
    return (year * 365 + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + of_year - 719468).cast("long")


def month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _components(frame: DataFrame, text: str, date_order: str, prefix: bool) -> DataFrame:
    """``frame`` with the numbers that a text gives: __y __m __d __h __i __s __o __named __e, each null where absent."""
    # an unmatched text stays as it is and has no parts, unless it held the mark itself
    given = F.when(~F.contains(F.col(text), F.lit(_MARK)), F.col(text))
    parts = F.split(F.regexp_replace(given, F.lit(pattern(prefix)), F.lit(_replacement())), _MARK)
    # A generator is a border that the optimizer neither collapses nor pushes a filter through: one match for each text.
    step = frame.select("*", F.explode(F.array(parts)).alias("__x"))
    at = {part: F.nullif(F.get("__x", F.lit(k + 1)), F.lit("")) for k, part in enumerate(_PARTS)}
    number = lambda part: at[part].try_cast("long")
    month_first = F.col(date_order) == "mdy"
    months = F.create_map(*[F.lit(x) for k, name in enumerate(MONTHS) for x in (name, k + 1)])
    year = F.when(F.length(at["y"]) == 2, number("y") + 2000).otherwise(number("y"))
    month = F.coalesce(number("m"), F.get(F.map_values(F.map_filter(months, lambda k, _: k == F.lower(at["n"]))), F.lit(0)).cast("long"), F.when(month_first, number("p")).when(F.col(date_order) == "dmy", number("q")))
    day = F.coalesce(number("d"), F.when(month_first, number("q")).when(F.col(date_order) == "dmy", number("p")))
    half = F.lower(at["a"])
    hour = F.when(half.isNull(), number("h")).when(number("h").between(1, 12), number("h") % 12 + F.when(half == "p", 12).otherwise(0))
    sign = F.when(at["o"].startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(at["o"], "[^0-9]", "")
    names = F.create_map(*[F.lit(x) for name, n in ZONE_MINUTES.items() for x in (name, n)])
    offset = F.when(F.length(digits) == 4, sign * (F.substring(digits, 1, 2).try_cast("long") * 60 + F.substring(digits, 3, 2).try_cast("long"))).otherwise(F.try_element_at(names, F.upper(at["o"])).cast("long"))
    fields = {"y": year, "m": month, "d": day, "h": hour, "i": number("i"), "s": F.coalesce(number("s"), F.lit(0).cast("long")), "o": offset, "named": at["o"].isNotNull(), "e": at["e"]}
    return step.select("*", F.inline(F.array(F.struct(*[c.alias(f"__{n}") for n, c in fields.items()])))).drop("__x")


def _real_day(y: Column, m: Column, d: Column) -> Column:
    return y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= month_days(y, m))


_COMPONENTS = tuple(f"__{c}" for c in ("y", "m", "d", "h", "i", "s", "o", "named", "e"))


def _epoch() -> Column:
    return F.when(F.length("__e") == 13, F.floor(F.col("__e").try_cast("long") / 1000)).otherwise(F.col("__e").try_cast("long"))


def add_day(frame: DataFrame, text: str, date_order: str, out: str, prefix: bool = False) -> DataFrame:
    """``frame`` with ``out``: the date that a text names as its own clock wrote it, with or without a time of day.

    An epoch gives its day in UTC. Null for a null, empty or unknown text, a day that isn't in the calendar, and a
    number-only date without a date order. A column named ``out`` is replaced; all other columns stay.
    """
    step = _components(frame.drop(out) if out != text else frame, text, date_order, prefix)
    y, m, d = (F.col(f"__{c}") for c in "ymd")
    number = F.when(F.col("__e").isNotNull(), F.floor(_epoch() / 86400)).when(_real_day(y, m, d), days_from_civil(y, m, d))
    return step.select("*", F.explode(F.array(F.date_add(F.lit("1970-01-01").cast("date"), number.cast("int")))).alias(out)).drop(*_COMPONENTS)


def add_instant(frame: DataFrame, text: str, zone: str, date_order: str, out: str, prefix: bool = False) -> DataFrame:
    """``frame`` with ``out``: seconds since 1970 in UTC, or null.

    ``zone``: a column with an IANA zone for texts without zone or offset; ``date_order``: a column with dmy or mdy for
    all-number dates that do not begin with the year. Null results: a null, empty or unknown text; a date without a
    time of day; a day or time that does not exist in the calendar; a local time without a zone; a number-only date
    without a date order. A local time that a clock change repeats is the earlier instant; one that it skips is moved
    forward by the change. Fractions of a second are cut off. A column named ``out`` is replaced; all other columns stay,
    whatever their names (those that begin with two underscores are the operator's own).
    """
    step = _components(frame.drop(out) if out != text else frame, text, date_order, prefix)
    y, m, d, h, i, s = (F.col(f"__{c}") for c in "ymdhis")
    real = _real_day(y, m, d) & h.between(0, 23) & i.between(0, 59) & s.between(0, 59)
    local = days_from_civil(y, m, d) * 86400 + h * 3600 + i * 60 + s
    step = step.withColumn("__local", F.when(real, local))
    zoned = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("__local"), F.col(zone)))
    instant = F.when(F.col("__e").isNotNull(), _epoch()).when(F.col("__named"), F.col("__local") - F.col("__o") * 60).when(F.col("__local").isNotNull() & F.col(zone).isNotNull(), zoned)
    return step.select("*", F.explode(F.array(instant.cast("long"))).alias(out)).drop(*_COMPONENTS, "__local")
