"""Profiles of streams: histograms are sums, so each micro-batch adds to a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nodes, stats


def cells(docs: DataFrame) -> DataFrame:
    """(path_id, v, n) of the top-level fields of a batch of variant documents (column doc), values as text."""
    level = nodes.typed(docs.select(F.lit("$[]").alias("path_id"), F.col("doc").alias("v")))
    kids = nodes.children(level).where("key is not null")
    text = F.try_variant_get("child", "$", "string")
    return kids.groupBy(F.concat("path_id", F.lit("."), "key").alias("path_id"), text.alias("v")).agg(F.count("*").alias("n"))


class IncrementalProfile:
    """foreachBatch sink: merges each batch's histogram into Parquet generations under `folder`.

    A batch that is delivered again overwrites its own generation, so results are exactly once.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        cells(batch).write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def histogram(self, spark) -> DataFrame:
        return spark.read.parquet(self.folder).groupBy("path_id", "v").agg(F.sum("n").alias("n"))

    def statistics(self, spark) -> DataFrame:
        return stats.statistics(self.histogram(spark), "path_id")


def windowed_counts(events: DataFrame, ts: str, key: str, *, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts of key by tumbling event-time window, late rows dropped by watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))
