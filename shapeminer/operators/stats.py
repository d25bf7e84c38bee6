"""Multisets as histograms (path_id, v, n), and order statistics over them.

A histogram is a monoid: `merged` adds two, and statistics are recomputed from the sum. Values are grouped before
anything else is done with them, so later work is on distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: Column, *path: str) -> DataFrame:
    """Occurrences of each value, by path columns."""
    return df.groupBy(*path, value.alias("v")).agg(F.count("*").alias("n"))


def statistics(hist: DataFrame, *path: str, value: str = "v", spread: int = 0) -> DataFrame:
    """card, distinct_values, min, q1, q2, q3, max, is_unique of each path.

    A quartile is the first value before which there are at least k quarters (rounded down) of all; else the
    largest. Plainly, one window runs over the distinct values of a path. With spread, it runs over those that
    `narrowed` leaves; the histogram is then read four times and should be persisted or cheap.
    """
    hist = hist.where(F.col(value).isNotNull())
    if spread:
        return narrowed_statistics(narrowed(hist, *path, value=value, spread=spread), *path, value=value)
    whole = Window.partitionBy(*path)
    return narrowed_statistics(hist.withColumns({"_card": F.sum("n").over(whole), "_all": F.count("*").over(whole), "_most": F.max("n").over(whole), "_range": F.lit(0), "_before": F.lit(0), "_quarters": F.lit(True)}), *path, value=value)


def narrowed_statistics(rows: DataFrame, *path: str, value: str = "v") -> DataFrame:
    """As statistics, of what `narrowed` gives."""
    ordered = Window.partitionBy(*path, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    h = rows.where("_quarters").withColumn("_before", F.coalesce(F.sum("n").over(ordered), F.lit(0)) + F.col("_before"))
    q = lambda k: F.coalesce(F.min(F.when(F.expr(f"_before >= ({k} * _card) div 4"), F.col(value))), F.max(value)).alias(f"q{k}")
    return h.groupBy(*path).agg(
        F.max("_card").alias("card"), F.max("_all").alias("distinct_values"), F.min(value).alias("min"), q(1), q(2), q(3), F.max(value).alias("max"), (F.max("_most") == 1).alias("is_unique")
    )


#: Distinct values up to which one window per path will do.
SPREAD_FROM = 100_000
#: Range borders that a path can have, one less than a power of two.
_MOST_CUTS = 1023


def narrowed(hist: DataFrame, *path: str, value: str = "v", spread: int = 256, k: int = 3) -> DataFrame:
    """The values that decide a path's statistics and its k most and least common ones, which are exact all the same.

    A path with more than SPREAD_FROM distinct values is cut into about `spread` ranges; borders are a fixed hash
    sample of its own values. Counting values by range and number of occurrences tells which ranges hold the
    quartiles and the ends (_quarters), and which hold common and rare values (_samples); the rest is left out
    without being sorted or moved. Columns added: the path's _card, distinct values _all and largest count _most;
    the value's _range, and the count _before that range.
    """
    sizes = hist.groupBy(*path).agg(F.count("*").alias("_all"), F.sum("n").alias("_card"), F.max("n").alias("_most"))
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / spread)).cast("bigint")
    big = hist.join(F.broadcast(sizes), [*path]).where(f"_all > {SPREAD_FROM}")  # a row per path
    cuts = big.where(F.pmod(F.xxhash64(value), step) == 0).groupBy(*path).agg(F.slice(F.array_sort(F.collect_list(value)), 1, _MOST_CUTS).alias("_cuts"))
    # the number of borders below the value, by binary search: one expression, which filters may repeat as it is
    bits = F.array(*(F.lit((_MOST_CUTS + 1) >> k) for k in range(1, (_MOST_CUTS + 1).bit_length())))
    place = F.aggregate(bits, F.lit(0), lambda at, bit: at + F.when(F.get("_cuts", at + bit - 1) < F.col(value), bit).otherwise(0))
    ranged = hist.join(F.broadcast(sizes.join(cuts, [*path], "left")), [*path]).withColumn("_range", F.coalesce(F.when(F.col("_cuts").isNotNull(), place), F.lit(0))).drop("_cuts")
    cells = ranged.groupBy(*path, "_range", "n").agg(F.count("*").alias("_c"), F.max("_card").alias("_card"))
    before = lambda *by: F.coalesce(F.sum("_c").over(Window.partitionBy(*path).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumns({"_above": before(F.desc("n"), F.asc("_range")), "_below": before(F.asc("n"), F.desc("_range"))})
    ranges = cells.groupBy(*path, "_range").agg(
        F.sum(F.col("n") * F.col("_c")).alias("_in"), F.max("_card").alias("_card"), F.min(F.when(F.col("_above") < k, F.col("n"))).alias("_common"), F.max(F.when(F.col("_below") < k, F.col("n"))).alias("_rare")
    )
    along, own = Window.partitionBy(*path).orderBy("_range"), Window.partitionBy(*path)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_in").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the range in which the count reaches a quarter, and the next one, whose first value may be the quartile
    ranges = ranges.withColumn("_hit", F.expr(" or ".join(f"(_before <= ({j} * _card) div 4 and ({j} * _card) div 4 < _before + _in)" for j in (1, 2, 3))))
    ends = (F.col("_range") == F.min("_range").over(own)) | (F.col("_range") == F.max("_range").over(own))
    ranges = ranges.withColumn("_quarters", F.col("_hit") | F.coalesce(F.lag("_hit").over(along), F.lit(False)) | ends).where("_quarters or _common is not null or _rare is not null")
    rows = ranged.join(F.broadcast(ranges.select(*path, "_range", "_before", "_quarters", "_common", "_rare")), [*path, "_range"])  # a few ranges per path
    rows = rows.withColumn("_samples", F.coalesce(F.col("n") >= F.col("_common"), F.lit(False)) | F.coalesce(F.col("n") <= F.col("_rare"), F.lit(False)))
    return rows.where("_quarters or _samples").drop("_common", "_rare")


def lengths(hist: DataFrame, *path: str, value: str = "v") -> DataFrame:
    """The histogram of the values' lengths."""
    return hist.groupBy(*path, F.length(value).alias("v")).agg(F.sum("n").alias("n"))


def merged(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Sum of two multisets."""
    return a.unionByName(b).groupBy(*keys).agg(F.sum("n").alias("n"))


def subtracted(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Difference of two multisets; only what stays above zero."""
    signed = a.unionByName(b.withColumn("n", -F.col("n")))
    return signed.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def equal(a: DataFrame, b: DataFrame, *keys: str) -> bool:
    """Whether two multisets hold the same values equally often."""
    diff = a.unionByName(b.withColumn("n", -F.col("n"))).groupBy(*keys).agg(F.sum("n").alias("n")).where("n != 0")
    return diff.isEmpty()


def elements(hist: DataFrame) -> DataFrame:
    """The multiset's rows: each value as often as it occurs."""
    return hist.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("_i", "n")


def common_and_rare(hist: DataFrame, *path: str, value: str = "v", k: int = 3, spread: int = 256) -> DataFrame:
    """The k most and k least common values of each path, with their rank; ties by value. Of the values that `narrowed` leaves."""
    return narrowed_common_and_rare(narrowed(hist, *path, value=value, spread=spread, k=k), *path, value=value, k=k).select(*hist.columns, "rank")


def narrowed_common_and_rare(rows: DataFrame, *path: str, value: str = "v", k: int = 3) -> DataFrame:
    """As common_and_rare, of what `narrowed` gives for the same k."""
    whole = Window.partitionBy(*path)
    some = rows.where("_samples").withColumns({"_a": F.row_number().over(whole.orderBy(F.desc("n"), F.asc(value))), "_z": F.row_number().over(whole.orderBy(F.asc("n"), F.desc(value)))}).where(f"_a <= {k} or _z <= {k}")
    return some.select(*path, value, "n", F.when(F.col("_a") <= k, F.col("_a")).otherwise(F.col("_all") - F.col("_z") + 1).cast("int").alias("rank"))
