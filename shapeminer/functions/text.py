"""Parsing of options and formatting of results, on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from fractions import Fraction
from math import inf

# the words that units of durations go by: fixed values; months and years have no fixed length and are kept apart
_SECOND = "s sec secs second seconds".split()
_UNITS = {
    "microseconds": ["micro", "micros", *(p + w for p in ("micro", "u", "µ") for w in _SECOND)],
    "milliseconds": ["milli", "millis", *(p + w for p in ("milli", "m") for w in _SECOND)],
    "seconds": _SECOND,
    "minutes": "mi min mins minute minutes".split(),
    "hours": "h hr hrs hour hours".split(),
    "days": "d day days".split(),
    "weeks": "w wk wks week weeks".split(),
    "months": "m mth mths month months mon mons".split(),
    "years": "y yr yrs year years".split(),
}
_UNIT_OF = {word: unit for unit, words in _UNITS.items() for word in words}
_AMOUNT = re.compile(r"([+-]?\d+)\s*([^\W\d_]+)(?!\w)\s*,?\s*")


def duration_parts(s: str) -> dict[str, int]:
    """'1 week, 2 days' as {'weeks': 1, 'days': 2}; ValueError if anything is left over or a unit comes twice."""
    out, rest = {}, s.strip(" \t\n,")
    while rest:
        m = _AMOUNT.match(rest)
        unit = _UNIT_OF.get(m[2]) if m else None
        if unit is None or unit in out:
            raise ValueError(f"invalid duration {s}")
        out[unit], rest = int(m[1]), rest[m.end() :]
    if not out:
        raise ValueError(f"invalid duration {s}")
    return out


def parse_duration(s: str) -> timedelta:
    parts = duration_parts(s)
    if parts.keys() & {"months", "years"}:
        raise ValueError(f"{s} has no fixed length")
    return timedelta(**parts)


def parse_timestamp(s: str) -> datetime:
    from dateutil.parser import parse

    return parse(s)


def shift(now: datetime, s: str, sign: int) -> datetime:
    """A timestamp, or now moved by a duration."""
    try:
        parts = duration_parts(s)
    except ValueError:
        return parse_timestamp(s)
    months = now.year * 12 + now.month - 1 + sign * (parts.pop("years", 0) * 12 + parts.pop("months", 0))
    day = min(now.day, (datetime(months // 12 + (months % 12 == 11), (months % 12 + 1) % 12 + 1, 1) - timedelta(days=1)).day)
    return now.replace(year=months // 12, month=months % 12 + 1, day=day) + sign * timedelta(**parts)


def num(s: str):
    """'1%', '1/2', '0.5' or '3'."""
    s = s.strip()
    if s.endswith("%"):
        return Fraction(s[:-1].strip()) / 100
    if "/" in s:
        return Fraction(s.replace(" ", ""))
    return float(s) if "." in s or "e" in s.lower() else int(s)


def size(s: str) -> int:
    """'2K' is 2048."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgte]?)b?\s*", s.lower())
    if not m:
        raise ValueError(f"invalid size {s}")
    return int(m[1]) << 10 * " kmgte".index(m[2] or " ")


def timestamps(s: str) -> tuple[timedelta, datetime]:
    """(unit, epoch) of 'unix', 'excel', 'UNIT since EPOCH' or EPOCH."""
    named = {"unix": "seconds since 1970-01-01", "excel": "days since 1899-12-30"}
    unit, since, epoch = named.get(s.strip(), s).partition(" since ")
    if not since:
        return timedelta(seconds=1), parse_timestamp(s)
    return parse_duration(unit if unit[:1].isdigit() else f"1 {unit}"), parse_timestamp(epoch)


def format_int(i: int) -> str:
    """With one decimal and a suffix from a thousand on: 1600 is 1.6K."""
    power = min(5, (len(str(abs(int(i)))) - 1) // 3)
    return f"{i / 1000**power:.1f}{' KMGTP'[power]}" if power else str(i)


def format_value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return format_int(v)
    if isinstance(v, float):
        return f"{v:.7g}"
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, str):
        return '"' + v.replace('"', '""') + '"'
    raise ValueError(f"no literal form for {type(v).__name__}")


def format_chars(chars, range_sep: str = "-", list_sep: str = "") -> str:
    """Sorted characters, runs of three and more as ranges: abcdh is a-dh."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return list_sep.join(chr(a) if a == b else chr(a) + list_sep + chr(b) if b == a + 1 else chr(a) + range_sep + chr(b) for a, b in runs)


def format_epoch(offset: float, scale: float) -> str:
    """'days since 1899-12-30'."""
    epoch = datetime(1970, 1, 1) + timedelta(seconds=offset)
    since = epoch.isoformat() if offset % 86400 else epoch.date().isoformat()
    for name in ("microseconds", "milliseconds", "seconds", "minutes", "hours", "days", "weeks"):
        if timedelta(**{name: 1}).total_seconds() == scale:
            return f"{name} since {since}"
    return f"seconds since {since} " + (f"/ {scale:g}" if scale >= 1 else f"* {1 / scale:g}")


def sparkline(low, q1, q2, q3, high, cells: int = 10) -> str:
    """Where the quartiles lie between the ends; a later one overwrites an earlier one."""
    out, span = ["."] * cells, high - low
    for k, q in enumerate((q1, q2, q3), 1):
        at = 0 if not span or span == inf else int((cells - 1) * ((q - low) / span))
        out[at] = str(k)
    return "".join(out)
