"""The type of the strings at each path, by conversions of their distinct values.

All candidate conversions are tried in one aggregation over the histogram; a bad value costs its count against a
budget. What comes back to the driver is one row per path.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..options import Options
from . import charclass

#: Longest text that any datetime format can have.
_DATETIME_LEN = 40


@dataclass(frozen=True)
class Candidate:
    """A conversion: the type it gives, the pattern that names it."""

    kind: str
    pattern: str

    def valid(self, c: Column) -> Column:
        """Whether a value converts, of values short enough to be tried."""
        if self.kind == "bool":
            return C.is_bool(c, self.pattern)
        if self.kind == "int":
            return C.is_int(c, C.INT_BASES[self.pattern])
        if self.kind == "float":
            return C.is_float(c)
        return C.parse_datetime(c, self.pattern).isNotNull()

    def __call__(self, c: Column) -> Column:
        if self.kind == "bool":
            return C.parse_bool(c, self.pattern)
        if self.kind == "int":
            return C.parse_int(c, C.INT_BASES[self.pattern])
        if self.kind == "float":
            return C.parse_float(c)
        return C.parse_datetime(c, self.pattern)


CASCADE = (
    *(Candidate("bool", p) for p in C.BOOL_PAIRS), *(Candidate("int", p) for p in C.INT_BASES), Candidate("float", "f"),
    *(Candidate("datetime", p) for p in C.VARIABLE_FORMATS),
)
FIXED = tuple(Candidate("datetime", p) for p in C.FIXED_FORMATS)
ALL = CASCADE + FIXED


def try_conversion(hist: DataFrame, convert, budget: int = 0) -> DataFrame:
    """Per path, whether convert (a function of a Column that is NULL for bad values) suits the histogram
    (path_id, v, n): bad values cost their count, at most `budget` in all, and one value at least must convert."""
    got = convert(F.col("v"))
    tried = hist.groupBy("path_id").agg(F.coalesce(F.sum(F.when(got.isNull(), F.col("n"))), F.lit(0)).alias("bad"), F.count_if(got.isNotNull()).alias("good"))
    return tried.withColumn("converts", (F.col("bad") <= budget) & (F.col("good") > 0))


def prepared(hist: DataFrame, options: Options) -> DataFrame:
    """The histogram (path_id, v, n) of strings with white space stripped, if that is wanted."""
    if not options.strip_whitespace:
        return hist
    return hist.groupBy("path_id", C.stripped(F.col("v")).alias("v")).agg(F.sum("n").alias("n"))


def evidence(hist: DataFrame, options: Options) -> DataFrame:
    """One row per path: totals, blanks, lengths, whether all are URLs, and each candidate's bad and good values."""
    v = F.col("v")
    # whether each candidate converts, as bits, computed once a value; most values are ruled out of all the dates by their lead
    short = F.length(v) <= options.max_numeric_len
    bits = lambda dates: reduce(Column.__add__, (F.when(_possible(c, v) & c.valid(v), 1 << k).otherwise(0) for k, c in enumerate(ALL) if (c.kind == "datetime") == dates))
    plain, dates = F.when(short, bits(False)).otherwise(0), F.when((F.length(v) <= _DATETIME_LEN) & v.rlike(C.DATETIME_LEAD), bits(True)).otherwise(0)
    tried = hist.select("path_id", "n", F.length(v).alias("len"), (v != "").alias("filled"), C.is_url(v).alias("url"), _split(plain + dates).alias("bits"))
    # few combinations occur
    seen = tried.groupBy("path_id", "filled", "url", "bits").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.min("len").alias("lo"), F.max("len").alias("hi"))
    filled = F.col("filled")
    aggs = [
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("blank"),
        F.min(F.when(filled, F.col("lo"))).alias("min_len"), F.max(F.when(filled, F.col("hi"))).alias("max_len"),
        F.coalesce(F.bool_and(F.when(filled, F.col("url"))), F.lit(False)).alias("url"),
    ]
    for k in range(len(ALL)):
        ok = F.col("bits").bitwiseAND(1 << k) != 0
        aggs += [F.coalesce(F.sum(F.when(filled & ~ok, F.col("n"))), F.lit(0)).alias(f"bad{k}"), F.coalesce(F.sum(F.when(filled & ok, F.col("k"))), F.lit(0)).alias(f"good{k}")]
    return seen.groupBy("path_id").agg(*aggs)


def _split(c: Column) -> Column:
    """A number as it is, in a projection apart from whole-stage code: in that, all of a long expression is in one method
    which the JVM never compiles; outside, Spark cuts it into short ones. (A higher-order function keeps it out.)"""
    return c + F.size(F.filter(F.array(F.lit(None).cast("int"), F.col("n").cast("int")), lambda _: F.lit(False)))


def _possible(c: Candidate, v: Column) -> Column:
    """What is cheap to see and follows from a candidate's shape."""
    if c.kind == "bool":  # five characters, and a line's end
        return F.length(F.btrim(v, F.lit(" \t\n\x0b\f\r"))) <= 6
    if c.kind != "datetime":
        return F.lit(True)
    if c.pattern.startswith("%a"):
        return v.contains(", ")
    return (v.contains("T") == F.lit("T" in c.pattern)) & (v.contains(".") == F.lit("%f" in c.pattern))


def chosen(row, options: Options, bad_threshold: Fraction | None = None) -> tuple[str, Candidate | None, bool]:
    """(str, url, fixed or the representation of a candidate; the candidate; whether blanks stay)."""
    total, blank = row["total"], row["blank"]
    if Fraction(blank, total) > Fraction(options.empty_threshold) or blank == total:
        return "str", None, True
    budget = ceil(total * Fraction(options.bad_threshold if bad_threshold is None else bad_threshold))
    first = lambda cs, at: next((c for k, c in enumerate(cs, at) if row[f"good{k}"] and row[f"bad{k}"] <= budget), None)
    if row["max_len"] <= options.max_numeric_len and (c := first(CASCADE, 0)):
        return "repr", c, False
    if row["min_len"] == row["max_len"]:
        if c := first(FIXED, len(CASCADE)):
            return "repr", c, False
        return "fixed", None, False
    return ("url" if row["url"] else "str"), None, False


def converted(hist: DataFrame, decisions: DataFrame, used: list[int]) -> DataFrame:
    """The value (path_id, n, i, d, t, s) that the decision of the path (path_id, conv, blanks) gives to each of
    (path_id, v, n), as one of i, d, t, s; blanks are dropped where they do not stay, bad values are rows of nulls."""
    h = hist.join(F.broadcast(decisions), "path_id").where("blanks or v != ''")  # a row per path
    v = F.col("v")
    pick = lambda kind, none: F.coalesce(*(F.when(F.col("conv") == k, ALL[k](v)) for k in used if ALL[k].kind == kind), F.lit(none))
    null = lambda t: F.lit(None).cast(t)
    return h.select(
        "path_id", _split(F.col("n")).alias("n") if used else "n",
        F.coalesce(pick("int", None).cast("decimal(38,0)"), pick("bool", None).cast("int").cast("decimal(38,0)"), null("decimal(38,0)")).alias("i"),
        pick("float", None).cast("double").alias("d"), pick("datetime", None).cast("timestamp").alias("t"), F.when(F.col("conv") == -1, v).alias("s"),
    )


def regrouped(rows: DataFrame) -> DataFrame:
    """The histogram (path_id, v, n) of rows (path_id, n, i, d, t, s), of which bad ones are dropped afterwards: a filter
    before would be moved below the conversions and do them twice."""
    good = F.col("i").isNotNull() | F.col("d").isNotNull() | F.col("t").isNotNull() | F.col("s").isNotNull()
    return rows.groupBy("path_id", F.struct("i", "d", "t", "s").alias("v")).agg(F.sum("n").alias("n"), F.max(good).alias("_good")).where("_good").drop("_good")


def patterns(hist: DataFrame, paths: DataFrame) -> dict[str, tuple]:
    """The mined patterns of fixed-width paths; a position's set is collected up to the alphabet that matters."""
    own = hist.join(F.broadcast(paths), "path_id", "left_semi").where("v != ''")
    # what exceeds 512 characters is beyond every class but "any", whatever the rest
    rows = charclass.positions(own, "path_id").select("path_id", "pos", F.size("chars").alias("k"), F.slice("chars", 1, 512).alias("chars")).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.path_id, r.pos)):
        by.setdefault(r.path_id, []).append(frozenset(r.chars))
    return {k: charclass.mined(v) for k, v in by.items()}
