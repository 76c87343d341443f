"""Column expressions for flags, missing values, text parts and numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FLOATS = ("double", "float")
_NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")


def flag(cases: list[tuple[Column, str]], default: str) -> Column:
    """The value of the first case that holds; a case that compares with null does not hold."""
    (first, value), *rest = cases
    out = F.when(first, F.lit(value))
    for condition, value in rest:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def or_default(column: Column, value) -> Column:
    return F.coalesce(column, F.lit(value))


def or_other_if_empty(column: Column, other: Column) -> Column:
    """``other`` where the text is empty; null stays null."""
    return F.when(column == "", other).otherwise(column)


def null_if_in(column: Column, tokens: list[str]) -> Column:
    """Null for the texts that stand for a missing value."""
    return F.when(column.isin(tokens), None).otherwise(column)


def percent(part: Column, total: Column) -> Column:
    return F.try_divide(part * 100.0, total)


def part_at(column: Column, pattern: str, index: int) -> Column:
    """The piece of a text at a position; null when there are fewer pieces."""
    return F.get(F.split(column, pattern), F.lit(index))


def number_in(column: Column) -> Column:
    """Text as a number; null when it is none."""
    return column.try_cast("double")


def without(column: Column, pattern: str) -> Column:
    return F.regexp_replace(column, pattern, "")


def joined_key(*columns: Column) -> Column:
    """Parts of a key with dashes between; null when one part is null."""
    parts: list[Column] = []
    for column in columns:
        parts += [F.lit("-"), column]
    return F.concat(*parts[1:])


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind in _NUMBERS]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating point column, so that aggregates skip it."""
    return df.withColumns(
        {n: F.when(~F.isnan(n), F.col(n)) for n, kind in df.dtypes if kind in _FLOATS}
    )


def fill_from_sibling(df: DataFrame, prefix: str) -> DataFrame:
    """Where ``<prefix>x`` is null take ``x``, for every column with that prefix."""
    named = [n for n in df.columns if n.startswith(prefix)]
    return df.withColumns(
        {n: F.coalesce(F.col(n), F.col(n.removeprefix(prefix))) for n in named}
    )


def map_numbers(df: DataFrame, fn: Callable[[Column], Column], keep: list[str]) -> DataFrame:
    """One function over every numeric column except the kept ones."""
    numbers = [n for n in numeric_columns(df) if n not in keep]
    return df.withColumns({n: fn(F.col(n)) for n in numbers})
