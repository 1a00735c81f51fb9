"""Scalar numeric functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def safe_ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    """A ratio, or the default where it has no value."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(default))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def platt(p: Column, a: float, b: float) -> Column:
    """A probability after Platt scaling."""
    return sigmoid(logit(p) * a + b)


def none_of_poisson(rate: Column) -> Column:
    """P(N = 0)."""
    return F.exp(-rate)


def expected_halves(rate: Column) -> Column:
    """E[floor(N / 2)] of a Poisson count, in closed form."""
    return rate / 2 - (1 - F.exp(-2 * rate)) / 4


def either(*p: Column) -> Column:
    """Probability of at least one of independent events; missing ones can't happen."""
    return 1 - reduce(lambda a, b: a * b, [1 - F.coalesce(x, F.lit(0.0)) for x in p])


def weighted_rule(terms: list[tuple[Column, float, int]]) -> Column:
    """Sum of weight * floor(value / step): a scorer whose rule is data. Null values count as 0."""
    return reduce(lambda a, b: a + b, [F.floor(F.coalesce(v, F.lit(0)) / step) * weight for v, weight, step in terms])


@dataclass(frozen=True)
class Term:
    """A term of a scoring rule: ``points`` for each full ``step`` of a value, or once if it reaches ``least``.

    ``points`` and ``least`` may differ by group: a group that is not named gets none. ``gate``: another column and the
    value from which the term counts at all.
    """

    value: str
    points: float | dict[str, float]
    step: int = 1
    least: float | dict[str, float] | None = None
    gate: tuple[str, float] | None = None


def _by_group(group: Column, what: float | dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in what.items() for x in (pair[0], float(pair[1]))]), group) if isinstance(what, dict) else F.lit(float(what))


def scored(rule: list[Term], group: Column) -> Column:
    """The sum of a rule's terms: gates, thresholds, steps and groups are data. Null values count as 0."""

    def one(term: Term) -> Column:
        value = F.coalesce(F.col(term.value), F.lit(0))
        units = F.floor(value / term.step) if term.least is None else (value >= _by_group(group, term.least)).cast("int")
        points = F.coalesce(units * _by_group(group, term.points), F.lit(0.0))
        return points if term.gate is None else F.when(F.coalesce(F.col(term.gate[0]), F.lit(0)) >= term.gate[1], points).otherwise(0.0)

    return reduce(lambda a, b: a + b, [one(t) for t in rule])


def error_label(error: Column, noise: float) -> Column:
    """A forecast's error in words: noise below a size, else too low or too high a forecast (error: actual - forecast)."""
    return F.when(F.abs(error) < noise, "noise").when(error > 0, "too low").otherwise("too high")


def gap_label(gap: Column, small: float, large: float) -> Column:
    """AGREE, DISAGREE or MAJOR by the size of a gap."""
    return F.when(F.abs(gap) >= large, "MAJOR").when(F.abs(gap) >= small, "DISAGREE").otherwise("AGREE")


def number_or(text: Column, default: float = 0.0) -> Column:
    """A number in a text, or the default where there is none."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def reaches(value: Column, group: Column, thresholds: dict[str, float]) -> Column:
    """1 where a value reaches its group's threshold, 0 where not, null for another group or a null value."""
    least = F.try_element_at(F.create_map(*[F.lit(x) for pair in thresholds.items() for x in (pair[0], float(pair[1]))]), group)
    return (value >= least).cast("int")
