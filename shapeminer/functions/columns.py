"""Conversions of strings as Column expressions; NULL stands for a bad value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# formats and pairs that are tried, in order: fixed values
BOOL_PAIRS = ("0|1", "f|t", "n|y", "false|true", "no|yes", "off|on", "|x")
INT_BASES = {"o": 8, "d": 10, "x": 16}
FIXED_FORMATS = (
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d",
    "%a, %d %b %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S %Z",
)
VARIABLE_FORMATS = (
    "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M%z",
    "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%d %H:%M%z",
)
_PIECES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%f": "SSSSSS", "%b": "MMM", "%z": "[XXX][XX]", "T": "'T'"}
#: What a format's strings look like; guards against leniency of the parser.
_SHAPES = {"%Y": r"\d{4}", "%m": r"\d{1,2}", "%d": r"\d{1,2}", "%H": r"\d{1,2}", "%M": r"\d{1,2}", "%S": r"\d{1,2}", "%f": r"\d{1,6}", "%b": "[A-Za-z]{3}", "%z": r"(?:Z|[+-]\d{2}:?\d{2})", "%a": "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)", "%Z": "(?:UTC|GMT)"}


def stripped(c: Column) -> Column:
    # most values have neither white space nor a line's end (before which $ matches, too) to lose
    return F.when(F.btrim(c, F.lit(" \t\n\x0b\f\r\x85\u2028\u2029")) == c, c).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def parse_bool(c: Column, pair: str) -> Column:
    no, yes = pair.split("|")
    v = F.lower(stripped(c))
    return F.when(v == no, F.lit(False)).when(v == yes, F.lit(True))


def is_bool(c: Column, pair: str) -> Column:
    no, yes = pair.split("|")
    return c.rlike(rf"^\s*(?i:{no}|{yes})\s*$")


def _int_shape(base: int) -> str:
    digit = {8: "[0-7]", 10: "[0-9]", 16: "[0-9a-fA-F]"}[base]
    prefix = {8: "(?:0[oO]_?)?", 10: "", 16: "(?:0[xX]_?)?"}[base]
    return rf"^\s*([+-]?){prefix}({digit}(?:_?{digit})*)\s*$"


_NUMBER = r"[0-9](?:_?[0-9])*"
_FLOAT_SHAPE = rf"^\s*[+-]?(?:(?:{_NUMBER}\.?(?:{_NUMBER})?|\.{_NUMBER})(?:[eE][+-]?{_NUMBER})?|(?i:inf|infinity))\s*$"
#: What any of the datetime formats begins with.
DATETIME_LEAD = r"^(?:\d{4}-\d|[A-Z][a-z]{2}, )"


def is_int(c: Column, base: int) -> Column:
    """Shape alone; up to 30 characters it is enough."""
    return c.rlike(_int_shape(base))


def is_float(c: Column) -> Column:
    return c.rlike(_FLOAT_SHAPE)


def parse_int(c: Column, base: int) -> Column:
    """As decimal(38,0): sign, surrounding space, single underscores between digits and the base's prefix are fine."""
    shape = _int_shape(base)
    digits = F.regexp_replace(F.regexp_extract(c, shape, 2), "_", "")
    if base == 10:
        value = digits.try_cast("decimal(38,0)")
    else:  # conv is exact for 15 digits
        wide = F.lpad(digits, 30, "0")
        half = lambda at: F.conv(F.substring(wide, at, 15), base, 10).cast("decimal(38,0)")
        value = F.when(F.length(digits) <= 30, half(1) * F.lit(base**15).cast("decimal(19,0)") + half(16)).cast("decimal(38,0)")
    return F.when(c.rlike(shape), F.when(F.regexp_extract(c, shape, 1) == "-", -value).otherwise(value).cast("decimal(38,0)"))


def parse_float(c: Column) -> Column:
    """As double; NaN is bad, infinities are fine."""
    return F.when(is_float(c), F.regexp_replace(stripped(c), "_", "").try_cast("double"))


def parse_datetime(c: Column, fmt: str) -> Column:
    """As timestamp; naive values and zone names are taken as UTC, offsets are applied."""
    pattern = shape = fmt
    for k, v in _SHAPES.items():
        shape = shape.replace(k, v)
    body = c
    if fmt.startswith("%a, "):  # the parser has no weekdays and needs no zone names
        body = F.regexp_replace(F.regexp_replace(c, "^[A-Za-z]{3}, ", ""), " (?:UTC|GMT)$", "")
        pattern = fmt.removeprefix("%a, ").removesuffix(" %Z")
    pattern = pattern.replace("T", "\0")
    for k, v in _PIECES.items():
        pattern = pattern.replace(k, v)
    pattern = pattern.replace("\0", "'T'")
    return F.when(c.rlike(f"^{shape}$"), F.try_to_timestamp(body, F.lit(pattern)))


def from_number(c: Column, offset: float, scale: float) -> Column:
    """The timestamp that a number stands for: scale seconds a unit, from offset seconds after 1970 on."""
    return F.timestamp_micros(F.round((c.cast("double") * scale + offset) * 1e6).cast("bigint"))


def is_url(c: Column) -> Column:
    return c.rlike("^https?://")


def _one_decimal(c: Column) -> Column:
    """A double of at least 1 and under 10,000 in magnitude, as Python's '.1f': its exact value, ties to even."""
    size = F.abs(c)
    # both shifts are exact, and the products fit a long
    bits = F.when(size < 1000, F.lit(52)).otherwise(F.lit(48))
    n = F.when(size < 1000, (size * float(1 << 52)).cast("bigint")).otherwise((size * float(1 << 48)).cast("bigint"))
    one = F.when(size < 1000, F.lit(1 << 52)).otherwise(F.lit(1 << 48))
    tenths = n % one * 10
    whole = F.call_function("shiftright", n, bits) * 10 + F.call_function("shiftright", tenths, bits)
    rest = tenths % one * 2
    whole = whole + F.when((rest > one) | ((rest == one) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string"))


def format_int(c: Column) -> Column:
    """As text.format_int; beyond 2^53 the quotient is that of the nearest double."""
    out = c.cast("string")
    for power, suffix in enumerate("KMGTP", 1):
        out = F.when(F.abs(c) >= F.lit(1000**power), F.concat(_one_decimal(c.cast("double") / F.lit(float(1000**power))), F.lit(suffix))).otherwise(out)
    return out


def sparkline(low: Column, q1: Column, q2: Column, q3: Column, high: Column, cells: int = 10) -> Column:
    at = lambda q: F.when(high == low, 0).otherwise(F.floor((cells - 1) * ((q - low) / (high - low))))
    mark = lambda k: F.when(at(q3) == k, "3").when(at(q2) == k, "2").when(at(q1) == k, "1").otherwise(".")
    return F.concat(*(mark(k) for k in range(cells)))
