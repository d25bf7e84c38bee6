"""Character classes of fixed-width strings: sets of characters by position, their algebra and patterns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_chars


def char_range(start: str, stop: str) -> CharClass:
    return CharClass(map(chr, range(ord(start), ord(stop) + 1)))


class CharClass(frozenset):
    """A set of characters; ANY in an operation is the whole universe."""

    def __new__(cls, chars=()):
        return chars if isinstance(chars, _Any) else super().__new__(cls, chars)

    def _with(self, other, op):
        return CharClass(op(self, CharClass(other))) if not isinstance(other, _Any) else NotImplemented

    def __or__(self, other):
        return self._with(other, frozenset.__or__)

    def __and__(self, other):
        return self._with(other, frozenset.__and__)

    def __xor__(self, other):
        return self._with(other, frozenset.__xor__)

    def __sub__(self, other):
        return self._with(other, frozenset.__sub__)

    union = lambda self, *o: CharClass(frozenset.union(self, *o))
    intersection = lambda self, *o: CharClass(frozenset.intersection(self, *o))
    difference = lambda self, *o: CharClass(frozenset.difference(self, *o))
    symmetric_difference = lambda self, o: CharClass(frozenset.symmetric_difference(self, o))

    def __str__(self):
        if len(self) < 2:
            return format_chars(self) if self else "∅"
        return next((s for s, c in NAMED.items() if c == self), f"[{format_chars(self)}]")

    def regex(self) -> str:
        return "[" + "".join(map(re.escape, sorted(self))) + "]" if self else "(?!)"


class _Any:
    """All characters there are."""

    def __repr__(self):
        return "ANY"

    __str__ = lambda self: "."
    __hash__ = lambda self: hash("any character")
    __contains__ = lambda self, c: isinstance(c, str) and len(c) == 1
    __len__ = lambda self: 0x110000
    __iter__ = lambda self: map(chr, range(0x110000))
    __eq__ = lambda self, o: isinstance(o, _Any)
    __ne__ = lambda self, o: not isinstance(o, _Any)
    __le__ = lambda self, o: isinstance(o, _Any)
    __ge__ = lambda self, o: True
    __lt__ = lambda self, o: False
    __gt__ = lambda self, o: not isinstance(o, _Any)
    __or__ = __ror__ = lambda self, o: self
    __and__ = __rand__ = lambda self, o: o
    regex = lambda self: "."

    def __sub__(self, other):
        if isinstance(other, _Any):
            return CharClass()
        raise ValueError("what is left of all characters is no class")

    def __rsub__(self, other):
        return CharClass()


ANY = _Any()
OCT, DEC = char_range("0", "7"), char_range("0", "9")
HEX = DEC | char_range("a", "f") | char_range("A", "F")
IDENT_FIRST = char_range("a", "z") | char_range("A", "Z") | {"_"}
IDENT = IDENT_FIRST | DEC
#: Symbols of the classes in patterns; hexadecimal ones are written in either case or one.
NAMED = {"o": OCT, "d": DEC, "x": HEX, "I": IDENT_FIRST, "i": IDENT}


def positions(hist: DataFrame, *path: str, value: str = "v") -> DataFrame:
    """(path, pos, chars): the distinct characters at each position of the distinct values."""
    spread = hist.select(*path, F.posexplode(F.split(value, "")).alias("pos", "c")).where("c != ''")
    spread = spread.groupBy(*path, "pos", "c").agg(F.lit(1))  # few, and counted by hash
    return spread.groupBy(*path, "pos").agg(F.array_sort(F.collect_set("c")).alias("chars"))


def mined(sets: list[str | frozenset]) -> tuple:
    """The pattern of a fixed-width string from its characters by position.

    Single characters are literal. Other sets of digits all get the largest base that any of them needs. What is
    left is an identifier's class if the whole string could be one, else any character.
    """
    sets = [CharClass(s) for s in sets]
    digits = [len(s) > 1 and s <= HEX for s in sets]
    base = next((c for c in (HEX, DEC, OCT) if any(d and not s <= smaller for d, s, smaller in ((d, s, {HEX: DEC, DEC: OCT, OCT: frozenset()}[c]) for d, s in zip(digits, sets)))), OCT)
    whole = [base if d else s for s, d in zip(sets, digits)]
    ident = bool(whole) and whole[0] <= IDENT_FIRST and all(s <= IDENT for s in whole[1:])
    rest = lambda k: (IDENT_FIRST if not k else IDENT) if ident else ANY
    return tuple(s if d or len(s) == 1 else rest(k) for k, (s, d) in enumerate(zip(whole, digits)))
