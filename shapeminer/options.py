"""Thresholds and conventions of an analysis; `library()` and `cli()` are the two usual sets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone
from fractions import Fraction


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def years_from(now: datetime, years: int) -> datetime:
    try:
        return now.replace(year=now.year + years)
    except ValueError:  # 29 February
        return now.replace(year=now.year + years, day=28)


@dataclass(frozen=True)
class Options:
    bad_threshold: Fraction = Fraction(2, 100)
    empty_threshold: Fraction = Fraction(98, 100)
    null_threshold: Fraction = Fraction(98, 100)
    field_threshold: int = 20
    merge_threshold: Fraction = Fraction(50, 100)
    max_numeric_len: int = 30
    strip_whitespace: bool = False
    #: Numbers within this window may be timestamps; the session's zone plays no part, all is UTC.
    min_timestamp: datetime = field(default_factory=lambda: years_from(_now(), -20))
    max_timestamp: datetime = field(default_factory=lambda: years_from(_now(), 10))
    epoch: datetime = datetime(1970, 1, 1)
    epoch_unit: timedelta = timedelta(seconds=1)
    #: Levels of nesting that are followed.
    max_depth: int = 50

    @classmethod
    def library(cls, **changes) -> Options:
        return cls(**changes)

    @classmethod
    def cli(cls, **changes) -> Options:
        one = Fraction(1, 100)
        return replace(cls(bad_threshold=one, empty_threshold=1 - one, null_threshold=1 - one, strip_whitespace=True), **changes)

    @property
    def scale(self) -> float:
        return self.epoch_unit.total_seconds()

    @property
    def offset(self) -> float:
        return (self.epoch - datetime(1970, 1, 1)).total_seconds()

    def window(self) -> tuple[float, float]:
        """The numbers that stand for the window's ends."""
        zero = datetime(1970, 1, 1)
        return tuple(((t - zero).total_seconds() - self.offset) / self.scale for t in (self.min_timestamp, self.max_timestamp))
