"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Documents with this remainder of crc32(doc_id as text) modulo 3 are never learned from.
HELD_OUT = 1


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 3) == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, id_col="doc_id", text_col="text", example_chars: int = 30_000) -> list[tuple[str, int]]:
    """At most `per_class` (text, label) of each class, from rows that are not held out, in a fixed order.

    Which rows: those with the smallest hash of the id, a property of the id alone, among the labelled rows whose
    texts have at most `example_chars` characters (which bounds the driver's memory). Texts are taken whole. Rows
    without label, id or text are no examples.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(f"id is not null and y in (0, 1)")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("t")).where(f"t is not null and length(t) <= {example_chars}")
    ids = ids.where(~held_out("id")).dropDuplicates(["id"]).join(texts.select("id"), "id", "left_semi")
    chosen = [r for y in (0, 1) for r in ids.where(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    if not chosen:
        return []
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(r.id, r.y) for r in chosen], "id long, y int"))  # at most 2 * per_class rows
    rows = texts.join(few, "id").dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: (r.id, r.t))
    return [(r.t, r.y) for r in rows]
