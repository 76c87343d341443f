"""Counts, distinct counts, extremes and moments of many columns from one scan.

A row becomes two short rows per column: one with a 128-bit digest of the value, for the distinct
count, and one with the value itself, for everything that combines. Both are combined before the
one shuffle, in which a value travels as its digest and a column's extremes as one row per task.
Several ``count(distinct)`` in one aggregation would instead send every value whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def _entries(df: DataFrame, name: str) -> list[Column]:
    value = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, NumericType):
        number = value.cast("double")
    else:
        text = value if isinstance(kind, StringType) else value.cast("string")
    # two seeds, since a hash of a hash would repeat its collisions
    digest = F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value).alias("b"))
    column = F.lit(name).alias("column")
    nothing = F.lit(None)
    seen = F.struct(
        column,
        F.when(value.isNotNull(), digest).alias("digest"),
        nothing.cast("double").alias("number"),
        nothing.cast("string").alias("text"),
        F.lit(False).alias("whole"),
    )
    whole = F.struct(
        column,
        F.lit(None).cast("struct<a:bigint,b:bigint>").alias("digest"),
        number.alias("number"),
        text.alias("text"),
        F.lit(True).alias("whole"),
    )
    return [seen, whole]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, nulls, distinct, mean, std, low, high, first, last.

    ``distinct`` leaves nulls out; two values count as one where 128 bits of hash agree. ``mean``,
    ``std``, ``low`` and ``high`` are for numeric columns, ``first`` and ``last`` for the others, by
    the bytes of their text (dates and times as text keep their order). A table without rows has
    zeros and nulls. Values that are maps are not supported.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in columns])
    entries = [e for c in columns for e in _entries(df, c)]
    long = kept.select(F.inline(F.array(*entries)))
    found = long.groupBy("column", "whole", "digest").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.coalesce("text", F.col("number").cast("string"))).alias("known"),
        F.avg("number").alias("mean"),
        F.stddev_samp("number").alias("std"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.min("text").alias("first"),
        F.max("text").alias("last"),
    )
    whole = {c: F.max(F.when(F.col("whole"), F.col(c))).alias(c)
             for c in ("mean", "std", "low", "high", "first", "last")}
    per_column = found.groupBy("column").agg(
        F.max(F.when(F.col("whole"), F.col("rows"))).alias("rows"),
        F.max(F.when(F.col("whole"), F.col("rows") - F.col("known"))).alias("nulls"),
        F.count(F.when(F.col("digest").isNotNull(), True)).alias("distinct"),
        *whole.values(),
    )
    # a column of a table without rows is listed too
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("rows", "nulls", "distinct")}
    return names.join(per_column, "column", "left").withColumns(zero)
