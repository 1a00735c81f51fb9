"""Comparing rows."""

from __future__ import annotations

import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    """Sorted rows with columns in order of their names."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


def as_rows(frame) -> list[tuple]:
    return rows_of(frame.columns, [tuple(r) for r in frame.collect()])
