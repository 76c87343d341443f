"""Grouped statistics, shares, pivots, summaries, correlations and member lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import percent
from tallyframe.operators.order_stats import keys_present, order_stats, same_keys
from tallyframe.operators.profile import profile
from tallyframe.operators.ranges import ROWS_PER_BUCKET

_ONE_PASS = {
    "count": F.count,
    "nunique": F.countDistinct,
    "sum": F.sum,
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "prod": F.product,
}
_ORDER = ("median", "mad")
KEYS_PER_TASK = 1_000_000  # different (group, value) that a task counts before the shuffle


def stat(name: str, column: str) -> Column:
    """A statistic that one combining pass gives, named ``<column>_<statistic>``."""
    return _ONE_PASS[name](F.col(column)).alias(f"{column}_{name}")


def _one_pass(stats: dict[str, list[str]]) -> list[Column]:
    return [stat(s, c) for c, names in stats.items() for s in names if s not in _ORDER]


def _with_order_stats(
    base: DataFrame,
    df: DataFrame,
    sets: list[list[str]],
    stats: dict[str, list[str]],
    rows_per_bucket: int,
) -> DataFrame:
    """Join medians and deviations, one row per group, to the one-pass statistics."""
    wanted = {c: [s for s in names if s in _ORDER] for c, names in stats.items()}
    wanted = {c: names for c, names in wanted.items() if names}
    if not wanted:
        return base
    long = order_stats(
        df,
        sets,
        list(wanted),
        {"median": 0.5},
        deviation=any("mad" in names for names in wanted.values()),
        rows_per_bucket=rows_per_bucket,
    )
    keys = list(dict.fromkeys(k for s in sets for k in s))
    wide = long.groupBy("set_bits", *keys).agg(
        *[
            F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{c}_{s}")
            for c, names in wanted.items()
            for s in names
        ]
    )
    on = same_keys(base, wide, ["set_bits", *keys])
    return base.join(wide, on, "left").select(
        base["*"], *[wide[f"{c}_{s}"] for c, names in wanted.items() for s in names]
    )


def multi_stat(
    df: DataFrame,
    keys: list[str],
    stats: dict[str, list[str]],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Many statistics of many columns per group; rows with a null key are left out.

    Statistics: count nunique sum mean median std min max mad prod. Everything but median and
    mad comes from one pass with map-side combining.
    """
    rows = df.na.drop(subset=keys) if keys else df
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *_one_pass(stats))
    base = base.withColumn("set_bits", F.lit(0).cast("bigint")).drop("__rows")
    out = _with_order_stats(base, rows, [keys], stats, rows_per_bucket)
    return out.drop("set_bits")


def multi_stat_sets(
    df: DataFrame,
    sets: list[list[str]],
    stats: dict[str, list[str]],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``multi_stat`` over several key sets at once, from one scan.

    ``key_set`` names the set a row belongs to; keys outside of it are null.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    base = _spread_for_distinct(df, len(sets), keys, stats).groupingSets(sets, *keys).agg(
        F.grouping_id().alias("set_bits"), F.count(F.lit(1)).alias("__rows"), *_one_pass(stats)
    )
    base = base.filter(keys_present(keys)).drop("__rows")
    out = _with_order_stats(base, df, sets, stats, rows_per_bucket)
    bits = {
        sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): "+".join(s)
        for s in sets
    }
    name = reduce(
        lambda acc, item: F.when(F.col("set_bits") == item[0], item[1]).otherwise(acc),
        bits.items(),
        F.lit(None).cast("string"),
    )
    return out.withColumn("key_set", name).drop("set_bits")


def _spread_for_distinct(
    df: DataFrame, n_sets: int, keys: list[str], stats: dict[str, list[str]]
) -> DataFrame:
    """The columns of the one-pass statistics, dealt to as many tasks as distinct counts need.

    Ahead of the shuffle a task keeps every different value of every group and key set of its rows,
    which a file of compressed rows makes many. Sums and extremes alone need no such care.
    """
    n_distinct = sum("nunique" in names for names in stats.values())
    if not n_distinct:
        return df
    parts = -(-df.count() * n_sets * n_distinct // KEYS_PER_TASK)
    rows = df.select(*dict.fromkeys([*keys, *stats]))
    return rows.repartition(parts) if parts > 1 else rows


def table_stats(
    df: DataFrame,
    numbers: list[str],
    others: list[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Whole-table statistics, one row per column; texts have no mean, deviation or median.

    All but median and mean deviation come from one scan (``profile``).
    """
    rows = profile(df, [*numbers, *others])
    number = F.col("column").isin(*numbers)
    long = rows.select(
        "column",
        F.col("distinct").alias("nunique"),
        (F.col("rows") - F.col("nulls")).alias("count"),
        "std",
        "mean",
        F.when(number, F.col("low").cast("string")).otherwise(F.col("first")).alias("min"),
        F.when(number, F.col("high").cast("string")).otherwise(F.col("last")).alias("max"),
    )
    ordered = order_stats(df, [[]], numbers, {"median": 0.5}, True, rows_per_bucket)
    return long.join(ordered.drop("set_bits"), "column", "left")


def describe_exact(
    df: DataFrame, columns: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Count, mean, std, min, exact interpolated quartiles and max; one row per column."""
    row = df.agg(
        *[stat(s, c) for c in columns for s in ("count", "mean", "std", "min", "max")]
    )
    long = row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"{c}_count").alias("count"),
                        F.col(f"{c}_mean").alias("mean"),
                        F.col(f"{c}_std").alias("std"),
                        F.col(f"{c}_min").cast("double").alias("min"),
                        F.col(f"{c}_max").cast("double").alias("max"),
                    )
                    for c in columns
                ]
            )
        )
    )
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    ordered = order_stats(df, [[]], columns, quartiles, False, rows_per_bucket)
    return long.join(ordered.drop("set_bits"), "column", "left")


def share_of(df: DataFrame, key: str, unit: str = "distinct") -> DataFrame:
    """Rows per value of ``key`` and their percentage of all distinct rows, or of all rows.

    With distinct rows below the line the shares add up to more than 100 when rows repeat.
    """
    base = df.distinct() if unit == "distinct" else df
    total = base.agg(F.count(F.lit(1)).alias("total"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percentage", percent(F.col("n"), total.scalar()))


def share_within(counts: DataFrame, outer: list[str], n: str = "n") -> DataFrame:
    """Percentage of each count within its outer group, from counts that are already grouped."""
    totals = counts.groupBy(*outer).agg(F.sum(n).alias("total"))
    return counts.join(totals, outer).withColumn("percentage", percent(F.col(n), F.col("total")))


def sum_of_counts(parts: list[DataFrame], key: str, n: str = "n") -> DataFrame:
    """Add up partial counts that come from several branches."""
    union = reduce(DataFrame.union, [p.select(key, n) for p in parts])
    return union.groupBy(key).agg(F.sum(n).alias(n))


def pivot_agg(
    df: DataFrame,
    keys: list[str],
    column: str,
    values: list,
    agg: Column,
    digits: int | None = None,
    fill=None,
) -> DataFrame:
    """One output column per given value; naming the values saves a job that looks for them."""
    shown = F.round(agg, digits) if digits is not None else agg
    out = df.groupBy(*keys).pivot(column, values).agg(shown)
    return out.fillna(fill, subset=[str(v) for v in values]) if fill is not None else out


def pivot_single(df: DataFrame, key: str, column: str, values: list, cell: str) -> DataFrame:
    """Long to wide where each cell has one source row; a second row for a cell is an error."""
    one = F.when(F.count(cell) <= 1, F.max(cell)).otherwise(
        F.raise_error(F.lit("more than one row for a cell")).cast(dict(df.dtypes)[cell])
    )
    return df.groupBy(key).pivot(column, values).agg(one)


def wide_matrix(
    df: DataFrame, key: str, column: str, value: str, block: int = 256, prefix: str = ""
) -> DataFrame:
    """One row per key and one column per value of ``column``, in their order, however many.

    The values of ``column`` become numbers, and ``block`` numbers in turn a block: cells are put
    together per key and block, and blocks per key, so no task and no expression holds more than a
    block until a row is complete; the result only picks the row's entries by number. The list of
    column values comes to the driver, as it names the columns. A key without a cell there has
    null; two rows for one cell are an error; rows with a null ``column`` have no cell.
    """
    known = df.filter(F.col(column).isNotNull())
    values = known.select(column).distinct().orderBy(column)
    names = [r[0] for r in values.select(F.col(column).cast("string")).collect()]
    spark = df.sparkSession
    places = spark.createDataFrame(list(enumerate(names)), "__at int, __name string")
    cells = known.select(
        F.col(key).alias("__key"), F.col(column).cast("string").alias("__name"), F.col(value).alias("__value")
    ).join(places, "__name")
    entry = F.struct(F.col("__at") % block, "__value")
    parts = cells.groupBy("__key", F.floor(F.col("__at") / block).alias("__block")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("__cells")
    )
    every = F.sequence(F.lit(0), F.lit(block - 1))
    parts = parts.select(
        "__key", "__block", F.transform(every, lambda i: F.try_element_at("__cells", i)).alias("__cells")
    )
    blocks = parts.groupBy("__key").agg(
        F.map_from_entries(F.collect_list(F.struct("__block", "__cells"))).alias("__blocks")
    )
    keys = df.select(F.col(key).alias("__key")).distinct()
    rows = keys.join(blocks, keys["__key"].eqNullSafe(blocks["__key"]), "left").select(
        keys["__key"], "__blocks"
    )

    def cell(at: int) -> Column:
        of_block = F.try_element_at("__blocks", F.lit(at // block).cast("bigint"))
        return F.get(of_block, F.lit(at % block)).alias(f"{prefix}{names[at]}")

    return rows.select(F.col("__key").alias(key), *[cell(i) for i in range(len(names))])


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: number of distinct values, a missing one counting as a value, and empties.

    One scan (``profile``); an empty text is the smallest text of its column.
    """
    rows = profile(df, columns)
    return rows.select(
        "column",
        (F.col("distinct") + (F.col("nulls") > 0).cast("bigint")).alias("distinct_values"),
        F.coalesce((F.col("first") == "").cast("bigint"), F.lit(0)).alias("has_empty"),
    )


def corr_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns (a, b, r), one pass, null pairs left out."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            entries.append(
                F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r"))
            )
    return row.select(F.inline(F.array(*entries)))


def match_rate(a: Column, b: Column) -> Column:
    """Fraction of rows where two columns agree; a comparison with null is a mismatch."""
    return F.avg(F.coalesce(a == b, F.lit(False)).cast("double"))


def members_list(df: DataFrame, key: str, member: str, part_size: int = 100_000) -> DataFrame:
    """The members of each group as sorted lists.

    A group of up to ``part_size`` members is one list. A larger one is spread by hash over as
    many parts as it needs, so no list outgrows a task and no member is lost.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    large = counts.filter(F.col("__n") > part_size).select(
        key, F.ceil(F.col("__n") / part_size).alias("__parts")
    )
    part = F.pmod(F.xxhash64(member), F.coalesce("__parts", F.lit(1)))
    return (
        df.join(large, key, "left")
        .groupBy(key, part.alias("part"))
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
    )


def long_stats(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A wide table of statistics as rows (key, statistic, value)."""
    wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([key], columns, "statistic", "value")
