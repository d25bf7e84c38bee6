"""Nested values as rows (path_id, v VARIANT), one level after the other.

Each level is one narrow pass: children are exploded and get the path that the level's decision gives them, so a
value is visited once, whatever the number of paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """One document, a mapping, held as rows (key, child VARIANT): it may exceed what a VARIANT can hold, and its
    children do not carry the names of all its keys."""

    entries: DataFrame

    def children(self, path: str) -> DataFrame:
        return self.entries.select(F.lit(path).alias("path_id"), F.lit("object").alias("kind"), F.lit(None).cast("int").alias("pos"), "key", "child")

    def histogram(self, path: str) -> DataFrame:
        """As histogram of the one document."""
        null = lambda t: F.lit(None).cast(t)
        size = self.entries.agg(F.count("*").alias("size"))
        return size.select(F.lit(path).alias("path_id"), F.lit("object").alias("kind"), "size", *(null(t).alias(c) for c, t in _VALUES), F.lit(1).cast("bigint").alias("n"))


#: The columns of a scalar's value, of which one is set.
_VALUES = (("i", "decimal(38,0)"), ("d", "double"), ("b", "decimal(38,0)"), ("t", "timestamp"), ("s", "string"))


def documents(df: DataFrame) -> DataFrame:
    """Every row of any DataFrame as one variant object at path $[]."""
    return df.select(F.lit("$[]").alias("path_id"), F.to_variant_object(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("v"))


def kind(v: Column, s: Column) -> Column:
    """object, array, null, bool, int, float, str, datetime; s is the value's schema, as text."""
    return (
        F.when(v.isNull() | (s == "VOID"), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "str").when(s == "BOOLEAN", "bool").when(s == "BIGINT", "int")
        .when(s.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "int").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float").when(s.startswith("TIMESTAMP") | (s == "DATE"), "datetime").otherwise("other")
    )


def typed(nodes: DataFrame) -> DataFrame:
    """Nodes with their kind and, for arrays, their size."""
    size = F.size(F.try_variant_get("v", "$", "array<variant>"))
    # the schema is a column, so that it is computed once
    shaped = nodes.withColumn("_schema", F.schema_of_variant("v"))
    return shaped.withColumn("kind", kind(F.col("v"), F.col("_schema"))).drop("_schema").withColumn("size", F.when(F.col("kind") == "array", size).cast("long"))


def children(nodes: DataFrame) -> DataFrame:
    """(path_id, pos, key, child) of the containers' elements; key is null in arrays."""
    return exploded(nodes.where("kind in ('object', 'array')"))


def exploded(inner: DataFrame) -> DataFrame:
    """As children, of nodes (path_id, kind, v) that are all containers."""
    return inner.select("path_id", "kind", "v").lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer())).select("path_id", "kind", "pos", "key", F.col("value").alias("child"))


def scalars(nodes: DataFrame) -> DataFrame:
    """The histogram (path_id, kind, i, d, b, t, s, n) of scalar nodes."""
    return nodes.where(SCALAR).groupBy("path_id", "kind", *_cells()).agg(F.count("*").alias("n"))


#: Of a histogram's rows, those of values.
SCALAR = "kind not in ('object', 'array', 'null', 'other')"


def _cells() -> list[Column]:
    got = lambda t: F.try_variant_get("v", "$", t)
    when = lambda k, t: F.when(F.col("kind") == k, got(t))
    return [when("int", "decimal(38,0)").alias("i"), when("float", "double").alias("d"), when("bool", "boolean").cast("int").cast("decimal(38,0)").alias("b"), when("datetime", "timestamp").alias("t"), when("str", "string").alias("s")]


def histogram(nodes: DataFrame, strip=None) -> DataFrame:
    """(path_id, kind, size, i, d, b, t, s, n) of all nodes: scalars by value, containers by size, in one grouping.

    strip is what to do with strings before they are grouped.
    """
    held = F.size(F.try_variant_get("v", "$", "map<string,variant>")).cast("long")
    cells = typed(nodes).select("path_id", "kind", F.when(F.col("kind") == "object", held).otherwise(F.col("size")).alias("size"), *_cells())
    if strip:
        cells = cells.withColumn("s", strip(F.col("s")))
    return cells.groupBy("path_id", "kind", "size", *(c for c, _ in _VALUES)).agg(F.count("*").alias("n"))
