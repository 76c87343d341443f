"""Joins: lookups, day ranges, membership, a group's value on its rows.

No side is broadcast by hint: Spark broadcasts a side when its size, measured or estimated, is
below the session's threshold, and splits hot keys of a sort-merge join at run time. The large
side always stands left, which is the side that a left join can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join on ``{fact column: lookup column}``; the lookup's key columns are dropped."""
    on = [facts[a] == lookup[b] for a, b in keys.items()]
    joined = facts.join(lookup, on, "left")
    for name in keys.values():
        joined = joined.drop(lookup[name])
    return joined


def left_join_fill(facts: DataFrame, other: DataFrame, key: str, value=0) -> DataFrame:
    """Left join on a shared key; what the other side lacks becomes ``value``."""
    added = [c for c in other.columns if c != key]
    return facts.join(other, key, "left").fillna(value, subset=added)


def merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a shared key; other shared column names get ``_x`` and ``_y``."""
    both = (set(left.columns) & set(right.columns)) - {key}
    a = left.select(*[F.col(c).alias(f"{c}_x" if c in both else c) for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{c}_y" if c in both else c) for c in right.columns])
    return a.join(b, key)


def keep_members(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys, key, "left_semi")


def with_group_max(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Each row with the largest value of its group.

    The maximum comes from a combining aggregation and goes back by a join, which can be split
    where a group is hot; a window would hold the whole group in one task.
    """
    top = df.groupBy(*keys).agg(F.max(column).alias(name))
    return df.join(top, keys, "left")


def _slot(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / width)


def day_range_join(
    left: DataFrame,
    right: DataFrame,
    keys: dict[str, str],
    left_day: str,
    right_day: str,
    low: int,
    high: int,
    how: str = "left",
) -> DataFrame:
    """Pairs with equal keys where the right day is ``low`` to ``high`` days after the left day.

    Days are cut into slots as wide as the range. A left row lies in one slot and a right row
    reaches at most two, so the slot joins the key in the hash: a hot key is split by time, and
    only pairs of neighbouring days are compared. As the left row stands in one slot only, a
    left join keeps an unmatched row exactly once.
    """
    width = high - low + 1
    a = left.withColumn("__slot", _slot(F.col(left_day), width))
    first = _slot(F.date_sub(F.col(right_day), high), width)
    last = _slot(F.date_sub(F.col(right_day), low), width)
    b = right.withColumn("__slot_r", F.explode(F.sequence(first, last)))
    on = [a[x] == b[y] for x, y in keys.items()]
    on.append(a["__slot"] == b["__slot_r"])
    on.append(F.datediff(b[right_day], a[left_day]).between(low, high))
    return a.join(b, on, how).drop("__slot", "__slot_r")


def count_within_days(
    left: DataFrame,
    right: DataFrame,
    keys: dict[str, str],
    left_day: str,
    right_day: str,
    name: str,
    low: int,
    high: int,
    keep_unmatched: bool,
) -> DataFrame:
    """Left rows with a key, per name of the right side, over all pairs within the day range.

    Both sides shrink to one row per key and day before they meet, so a hot key brings days, not
    rows, to the join. ``keep_unmatched`` counts left rows without a pair under a null name.
    """
    a = left.groupBy(*keys, left_day).agg(F.count(next(iter(keys))).alias("__n"))
    b = right.groupBy(*keys.values(), name, right_day).agg(F.count(F.lit(1)).alias("__m"))
    how = "left" if keep_unmatched else "inner"
    pairs = day_range_join(a, b, keys, left_day, right_day, low, high, how)
    weight = F.col("__n") * F.coalesce("__m", F.lit(1))
    return pairs.groupBy(name).agg(F.sum(weight).alias("n"))
