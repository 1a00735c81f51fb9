"""A plain, row-at-a-time reading of timestamp texts, to hold the operator against."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

MINUTES = {"GMT": 0, "UTC": 0, "BST": 60, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "BRT": -180, "IST": 330, "AEST": 600, "AEDT": 660}
MONTH = {m: k + 1 for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}


def seconds(text: str | None, zone: str | None, order: str | None, title: bool = False) -> int | None:
    """Seconds since 1970, or None, of the formats that the tables have."""
    if text is None:
        return None
    end = r"(?:\s.*)?$" if title else "$"

    def build(y, mo, d, h, mi, s, offset=None):
        try:
            t = datetime(int(y), int(mo), int(d), int(h), int(mi), int(s or 0))
        except ValueError:
            return None
        if offset is not None:
            return int(t.replace(tzinfo=timezone.utc).timestamp()) - offset * 60
        if zone is None:
            return None
        # a time that the clocks skip moves forward, one that they repeat is the first
        return int(t.replace(tzinfo=ZoneInfo(zone), fold=0).timestamp())

    if m := re.match(r"(\d{10}|\d{13})" + end, text):
        return int(m[1]) // (1000 if len(m[1]) == 13 else 1)
    if m := re.match(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)Z" + end, text):
        return build(*m.groups(), 0)
    if m := re.match(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?(?:(Z)| ?([+-])(\d\d):?(\d\d)(?:\[[\w/]+\])?)?" + end, text):
        y, mo, d, h, mi, s, z, sign, oh, om = m.groups()
        return build(y, mo, d, h, mi, s, 0 if z else None if sign is None else (-1 if sign == "-" else 1) * (int(oh) * 60 + int(om)))
    if m := re.match(r"(\d\d)[/.](\d\d)[/.](\d{4}|\d\d) (\d\d):(\d\d)" + end, text):
        a, b, y, h, mi = m.groups()
        y = y if len(y) == 4 else "20" + y
        return None if order is None else build(y, a, b, h, mi, 0) if order == "mdy" else build(y, b, a, h, mi, 0)
    if m := re.match(r"(\d{1,2})-([A-Z][a-z]{2})-(\d{4}) (\d{1,2}):(\d\d) ([AP])M" + end, text):
        d, mo, y, h, mi, half = m.groups()
        return build(y, MONTH[mo], d, int(h) % 12 + 12 * (half == "P"), mi, 0) if 1 <= int(h) <= 12 else None
    if m := re.match(r"[A-Z][a-z]{2},? (\d{1,2}) ([A-Z][a-z]{2}) (\d{4}),? (\d\d):(\d\d)(?::(\d\d))? ([A-Z]+)" + end, text):
        d, mo, y, h, mi, s, name = m.groups()
        return build(y, MONTH[mo], d, h, mi, s, MINUTES[name])
    return None


assert timedelta
