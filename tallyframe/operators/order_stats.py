"""Exact quantiles and mean absolute deviation, for any group size.

``percentile`` and ``median`` keep every distinct value of a group in one task's memory. Here a
first pass counts rows per group and value range, which combines before the shuffle to a few
numbers per task. Only the ranges that hold a wanted rank, or the mean, are then looked at value
by value in a second pass, so almost no row is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.operators.ranges import ROWS_PER_BUCKET, with_buckets


def same_keys(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """All the named columns agree, null with null."""
    pairs = [left[n].eqNullSafe(right[n]) for n in names]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def _long_rows(
    df: DataFrame, sets: list[list[str]], columns: list[str], rows_per_bucket: int
) -> DataFrame:
    """Rows (set_bits, keys, column, bucket, value), one per key set and column.

    ``column`` is the number of the column in the list. ``set_bits`` tells the key sets apart, as
    ``grouping_id`` does: a bit is set for each key outside the set, which is null then. Rows
    with a null in a key of the set are left out.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(f"__{c}") for c in columns])
    cut = with_buckets(doubles, {f"__{c}": f"__bucket_{c}" for c in columns}, rows_per_bucket)
    cells = [
        F.struct(
            F.lit(i).alias("column"),
            F.col(f"__bucket_{c}").cast("int").alias("bucket"),
            F.col(f"__{c}").alias("value"),
        )
        for i, c in enumerate(columns)
    ]
    rows = cut.select(*keys, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    if len(sets) == 1:
        present = rows.na.drop(subset=keys) if keys else rows
        return present.withColumn("set_bits", F.lit(0).cast("bigint"))
    groups = []
    for s in sets:
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        inside = [
            (F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k)
            for k in keys
        ]
        group = F.struct(F.lit(bits).cast("bigint").alias("set_bits"), *inside)
        here = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in s], F.lit(True))
        groups.append(F.when(here, group))
    return rows.select(
        F.inline(F.array_compact(F.array(*groups))), "column", "bucket", "value"
    )


def keys_present(keys: list[str]) -> Column:
    """In a grouping-set result: no null among the keys that this row was grouped by."""
    tests = [
        F.expr(f"(shiftright(set_bits, {len(keys) - 1 - i}) & 1) = 1") | F.col(k).isNotNull()
        for i, k in enumerate(keys)
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def order_stats(
    df: DataFrame,
    sets: list[list[str]],
    columns: list[str],
    shares: dict[str, float],
    deviation: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per key set, group and column, with interpolated quantiles.

    ``shares`` names the quantiles, such as ``{"median": 0.5}``; ``deviation`` adds ``mad``, the
    mean absolute deviation from the group's mean.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    group = ["set_bits", *keys, "column"]
    rows = _long_rows(df, sets, columns, rows_per_bucket)

    # One row per group and bucket; a group has at most MOST_BUCKETS of them.
    all_of = W.partitionBy(*group)
    before = all_of.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        rows.groupBy(*group, "bucket")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("value").alias("sum"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .withColumns(
            {
                "start": F.coalesce(F.sum("rows").over(before), F.lit(0)),
                "total": F.sum("rows").over(all_of),
                "mean": F.sum("sum").over(all_of) / F.sum("rows").over(all_of),
            }
        )
    )
    ranks = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in shares.items()}
    end = F.col("start") + F.col("rows")
    wanted = [(F.floor(r) < end) & (F.ceil(r) >= F.col("start")) for r in ranks.values()]
    if deviation:
        whole = F.col("high") <= F.col("mean")
        split = (F.col("low") <= F.col("mean")) & ~whole
        below = W.partitionBy(*group)
        buckets = buckets.withColumns(
            {
                "n_below": F.sum(F.when(whole, F.col("rows")).otherwise(0)).over(below),
                "sum_below": F.sum(F.when(whole, F.col("sum")).otherwise(0.0)).over(below),
                "split": split,
            }
        )
        wanted.append(F.col("split"))
    looked_at = buckets.filter(reduce(lambda a, b: a | b, wanted)).drop(
        "rows", "sum", "low", "high"
    )

    marks = looked_at.withColumnsRenamed({c: f"m_{c}" for c in (*group, "bucket")})
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in (*group, "bucket")],
    )
    # Only values and their counts are shuffled; the marks join again afterwards.
    values = (
        rows.join(marks, same, "left_semi")
        .groupBy(*group, "bucket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inside = W.partitionBy(*group, "bucket").orderBy("value")
    up_to = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    detail = values.withColumn("up_to", up_to).join(marks, same)
    detail = detail.withColumn("stop", F.col("start") + F.col("up_to"))
    first = F.col("stop") - F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < F.col("stop")), F.col("value")))

    picks = [F.max(c).alias(c) for c in ("total", "mean")]
    for name, rank in ranks.items():
        picks += [at(F.floor(rank)).alias(f"lo_{name}"), at(F.ceil(rank)).alias(f"hi_{name}")]
    if deviation:
        small = F.col("split") & (F.col("value") <= F.col("mean"))
        picks += [
            F.max("n_below").alias("n_below"),
            F.max("sum_below").alias("sum_below"),
            F.sum(F.when(small, F.col("n")).otherwise(0)).alias("n_split"),
            F.sum(F.when(small, F.col("n") * F.col("value")).otherwise(0.0)).alias("sum_split"),
        ]
    picked = detail.groupBy(*group).agg(*picks)
    out = [*group]
    for name, rank in ranks.items():
        low, high = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    if deviation:
        n_small = F.col("n_below") + F.col("n_split")
        sum_small = F.col("sum_below") + F.col("sum_split")
        mad = 2 * (F.col("mean") * n_small - sum_small) / F.col("total")
        out.append(F.greatest(mad, F.lit(0.0)).alias("mad"))
    names = F.array(*[F.lit(c) for c in columns])
    return picked.select(*out).withColumn("column", names[F.col("column")])
