"""Times as users type them: a literal, read once where the plan is made."""

from __future__ import annotations

import datetime as dt
import re

_RELATIVE = re.compile(r"^([+-])\s*((?:\d+(?:\.\d+)?\s*(?:ms|[dhms])\s*)+)$", re.I)
_PART = re.compile(r"(\d+(?:\.\d+)?)\s*(ms|[dhms])", re.I)
_DAYTIME = re.compile(r"^(\d{1,2}):(\d{2})(?::(\d{2}(?:[.,]\d{1,7})?))?$")
_FULL = re.compile(r"^(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,7}))?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$", re.I)
_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_time_query(text: str | None, reference: dt.datetime | None = None) -> dt.datetime | None:
    """The instant that text means, None if it means none.

    -5m, +1h30m, -250ms: relative to reference (none without it). 14:05[:30[,123]]: on reference's date (without it:
    today). A full date and time: in its own offset, else in that of reference, else in UTC.
    """
    text = (text or "").strip()
    zone = reference.tzinfo if reference is not None and reference.tzinfo else dt.timezone.utc
    if m := _RELATIVE.match(text):
        if reference is None:
            return None
        delta = dt.timedelta(seconds=sum(float(n) * _SECONDS[u.lower()] for n, u in _PART.findall(m[2])))
        return reference - delta if m[1] == "-" else reference + delta
    if m := _DAYTIME.match(text):
        hours, minutes, seconds = int(m[1]), int(m[2]), float((m[3] or "0").replace(",", "."))
        if hours > 23 or minutes > 59 or seconds >= 60:
            return None
        day = (reference or dt.datetime.now(zone)).date()
        return dt.datetime.combine(day, dt.time(), zone) + dt.timedelta(hours=hours, minutes=minutes, seconds=seconds)
    if m := _FULL.match(text):
        if m[8]:
            sign = -1 if m[8][0] == "-" else 1
            digits = m[8][1:].replace(":", "")
            zone = dt.timezone.utc if m[8] in "Zz" else dt.timezone(sign * dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:])))
        try:
            at = dt.datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), tzinfo=zone)
        except ValueError:
            return None
        return at + dt.timedelta(microseconds=int(((m[7] or "") + "000000")[:6]))
    return None
