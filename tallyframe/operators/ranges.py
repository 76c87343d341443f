"""Order-preserving buckets, so that sorting work is split by value rather than by group.

A hot group, or a table without any grouping key, would put a whole sort into one task. Buckets
between approximate quantiles of the *whole* table hold about the same number of rows each, so
one group's share of one bucket is bounded too, however hot the group is. The cut points are
only approximate, which moves work between tasks but never changes a result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
MOST_BUCKETS = 8192


def with_buckets(
    df: DataFrame, columns: dict[str, str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add a bucket number for each column: ``{value column: name of its bucket column}``.

    One bounded row comes to the driver: the row count and at most ``MOST_BUCKETS`` cut points
    per column. Buckets are numbered in value order; null has no bucket. The cut points come
    from about a thousand rows per bucket, which keeps their sketches small; every row of the
    table gets its bucket.
    """
    n = df.count()
    parts = min(-(-n // rows_per_bucket), MOST_BUCKETS)
    if parts <= 1:
        zero = {b: F.when(F.col(c).isNotNull(), F.lit(0.0)) for c, b in columns.items()}
        return df.withColumns(zero)
    shares = [i / parts for i in range(1, parts)]
    fine = max(10_000, 4 * parts)
    some = df.sample(min(1.0, 1000 * parts / n), seed=1)
    row = some.agg(*[F.percentile_approx(c, shares, fine).alias(b) for c, b in columns.items()])
    cuts = row.first().asDict()
    splits = [
        [float("-inf"), *sorted({float(x) for x in cuts[b] or [0.0]}), float("inf")]
        for b in columns.values()
    ]
    return Bucketizer(
        inputCols=list(columns),
        outputCols=list(columns.values()),
        splitsArray=splits,
        handleInvalid="keep",
    ).transform(df)


def dense_rank_all(
    df: DataFrame,
    value: str,
    name: str,
    descending: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Dense rank of a column over the whole table, ties equal, nulls unranked.

    Distinct values are ranked within their bucket; a bucket then adds the number of distinct
    values in the buckets ahead of it. Only the per-bucket counts, at most ``MOST_BUCKETS``
    rows, meet in one task.
    """
    ahead = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    bucket = f"{name}_bucket"
    values = with_buckets(
        df.select(F.col(value).cast("double").alias(value)).na.drop(),
        {value: bucket},
        rows_per_bucket,
    ).distinct()
    before = W.orderBy(ahead(bucket)).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        values.groupBy(bucket)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = F.row_number().over(W.partitionBy(bucket).orderBy(ahead(value)))
    ranks = (
        values.withColumn("inside", inside)
        .join(offsets, bucket)
        .select(F.col(value).alias("__v"), (F.col("inside") + F.col("offset")).alias(name))
    )
    return df.join(ranks, df[value].cast("double") == F.col("__v"), "left").drop("__v")


def top_dense(df: DataFrame, groups: list[str], value: str, n: int, name: str) -> DataFrame:
    """Rows of each group whose value is among its ``n`` largest distinct values, ties kept.

    The ranking runs over distinct values only, with a per-task limit ahead of the shuffle; rows
    that share a value never gather in the ranking task.
    """
    order = W.partitionBy(*groups).orderBy(F.col(value).desc())
    top = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(name, F.dense_rank().over(order))
        .filter(F.col(name) <= n)
        .drop("__n")
    )
    return df.join(top, [*groups, value])
