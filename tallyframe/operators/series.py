"""Preparation and quality checks of cumulative time series per entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions.columns import joined_key, or_other_if_empty
from tallyframe.operators.aggregates import match_rate
from tallyframe.session import cut_lineage


def with_location(df: DataFrame, parent: str, child: str, name: str = "location") -> DataFrame:
    """An entity key ``parent-child``; an empty child takes the parent's name."""
    filled = df.withColumn(child, or_other_if_empty(F.col(child), F.col(parent)))
    return filled.withColumn(name, joined_key(F.col(parent), F.col(child)))


def ambiguous_keys(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Keys that stand for more than one parent."""
    return (
        df.groupBy(key)
        .agg(F.countDistinct(parent).alias("parents"))
        .filter(F.col("parents") > 1)
    )


def partly_missing(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Parents with more than one child, one of which is empty."""
    return (
        df.groupBy(parent)
        .agg(
            F.countDistinct(child).alias("children"),
            F.max((F.col(child) == "").cast("int")).alias("empty"),
        )
        .filter((F.col("children") > 1) & (F.col("empty") == 1))
        .select(parent, "children")
    )


def last_day(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.max(date).alias("last"))


def on_last_day(df: DataFrame, date: str) -> DataFrame:
    """Rows of the latest day of the whole table."""
    return df.filter(F.col(date) == last_day(df, date).scalar())


def cumulative_check(df: DataFrame, entity: str, date: str, measures: list[str]) -> DataFrame:
    """Per entity seen on the table's last day: value of that day, maximum, and agreement."""
    last = F.col(date) == last_day(df, date).scalar()
    out = df.groupBy(entity).agg(
        F.max(last).alias("__seen"),
        *[F.max(F.when(last, F.col(m))).alias(f"{m}_last") for m in measures],
        *[F.max(m).alias(f"{m}_max") for m in measures],
    )
    agree = {
        f"{m}_agrees": F.coalesce(F.col(f"{m}_last") == F.col(f"{m}_max"), F.lit(False))
        for m in measures
    }
    return out.filter("__seen").drop("__seen").withColumns(agree)


def match_rates(check: DataFrame, measures: list[str]) -> DataFrame:
    """Fraction of entities whose last value is the maximum, one column per measure."""
    return check.agg(
        *[match_rate(F.col(f"{m}_last"), F.col(f"{m}_max")).alias(f"{m}_rate") for m in measures]
    )


def _number(df: DataFrame, date: str) -> Column:
    """A date, time stamp or number as a whole number; rows without one come before all others."""
    kind = dict(df.dtypes)[date]
    if kind == "date":
        value = F.unix_date(date)
    elif kind.startswith("timestamp"):
        value = F.unix_micros(F.col(date).cast("timestamp"))
    else:
        value = F.col(date)
    return F.coalesce(value.cast("bigint"), F.lit(-(1 << 62)))


def _scan(df: DataFrame, keys: list[str], date: str, measures: list[str]) -> DataFrame:
    """Running maxima, and the maxima and the date before the row's own date, within ``keys``.

    Rows of one date are peers: they share the maximum that includes all of them, and the
    predecessor that none of them is.
    """
    order = W.partitionBy(*keys).orderBy("__at")
    so_far = order.rangeBetween(W.unboundedPreceding, W.currentRow)
    before = order.rangeBetween(W.unboundedPreceding, -1)
    return df.withColumn("__at", _number(df, date)).withColumns(
        {
            **{f"__run_{m}": F.max(m).over(so_far) for m in measures},
            **{f"prev_{m}": F.max(m).over(before) for m in measures},
            "prev_date": F.max(date).over(before),
        }
    )


def _carried(ticks: DataFrame, entity: list[str], date: str, measures: list[str]) -> DataFrame:
    """``_scan`` per entity in two levels: within ``__chunk``, and over the chunks' totals.

    Chunks follow each other in time, and no date lies in two of them. Each chunk of an entity is
    a unit of work of its own; only one row per chunk is carried forward.
    """
    across = W.partitionBy(*entity).orderBy("__chunk")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    totals = (
        ticks.groupBy(*entity, "__chunk")
        .agg(F.max(date).alias("__end"), *[F.max(m).alias(f"__max_{m}") for m in measures])
        .select(
            *[F.col(c).alias(f"__of_{c}") for c in entity],
            F.col("__chunk").alias("__of_chunk"),
            F.max("__end").over(earlier).alias("__prev_end"),
            *[F.max(f"__max_{m}").over(earlier).alias(f"__carry_{m}") for m in measures],
        )
    )
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in entity]
    run = _scan(ticks, [*entity, "__chunk"], date, measures).join(
        totals, reduce(lambda a, b: a & b, same, F.col("__chunk").eqNullSafe(F.col("__of_chunk")))
    )
    carried = {f"__run_{m}": F.greatest(f"__run_{m}", f"__carry_{m}") for m in measures}
    carried |= {f"prev_{m}": F.greatest(f"prev_{m}", f"__carry_{m}") for m in measures}
    carried["prev_date"] = F.coalesce("prev_date", "__prev_end")
    dropped = [f"__of_{c}" for c in entity] + [f"__carry_{m}" for m in measures]
    return run.withColumns(carried).drop(*dropped, "__of_chunk", "__prev_end")


def _ticks(
    df: DataFrame, entity: list[str], date: str, measures: list[str], rows_per_chunk: int
) -> DataFrame:
    """One row per entity and date, cut into chunks by ranges of (entity, date).

    The number of ranges follows from the counted rows, and Spark cuts them from samples of all
    rows, so an entity takes as many chunks as its rows fill. Written once, so that a lost
    executor cannot move a cut.
    """
    ticks = cut_lineage(
        df.groupBy(*entity, date).agg(*[F.max(m).alias(m) for m in measures]), "ticks"
    )
    parts = max(-(-ticks.count() // rows_per_chunk), 1)
    placed = ticks.withColumn("__at", _number(ticks, date)).repartitionByRange(
        parts, *entity, "__at"
    )
    return cut_lineage(placed.drop("__at").withColumn("__chunk", F.spark_partition_id()), "ranges")


def prepare_series(
    df: DataFrame,
    entity: list[str],
    date: str,
    measures: list[str],
    chunk: Column | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Forced cumulative series with logs, previous values, changes and the gap in days.

    For a measure ``m``: ``m`` becomes its running maximum, then ``log_m``, ``prev_m``,
    ``prev_log_m``, ``delta_m`` and ``delta_log_m``; also ``prev_date`` and ``gap_days``. Rows of an
    entity with the same date are peers: all have the maximum up to and including that date, and
    the same predecessor, the last earlier date. The first date of an entity is its own
    predecessor. A row without a date comes before all dates. Null measures are passed over.

    With one row per entity and day, an entity has no more rows than the calendar has days and
    the work is one shuffle. For finer time stamps pass ``rows_per_chunk``: rows shrink to one per
    entity and date, are cut into ranges of about that many, scanned within their range and
    across the ranges' totals, and joined back; a busy entity, or a busy date, is spread over
    many tasks. Where the caller knows a good cut, ``chunk`` (an expression that grows with the
    date, such as its day) does without that pass and the join.
    """
    if rows_per_chunk is not None:
        scanned = _carried(_ticks(df, entity, date, measures, rows_per_chunk), entity, date, measures)
        keys = [*entity, date]
        new = [f"__run_{m}" for m in measures] + [f"prev_{m}" for m in measures] + ["prev_date"]
        found = scanned.select(*[F.col(c).alias(f"__of_{c}") for c in keys], *new)
        same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys]
        run = df.join(found, reduce(lambda a, b: a & b, same)).drop(*[f"__of_{c}" for c in keys])
    elif chunk is not None:
        run = _carried(df.withColumn("__chunk", chunk), entity, date, measures)
    else:
        run = _scan(df, entity, date, measures)
    run = run.withColumns({m: F.col(f"__run_{m}") for m in measures})
    run = run.drop("__at", "__chunk", *[f"__run_{m}" for m in measures])
    return _changes(run, date, measures)


def _changes(df: DataFrame, date: str, measures: list[str]) -> DataFrame:
    filled = {f"prev_{m}": F.coalesce(f"prev_{m}", m) for m in measures}
    logs = {f"log_{m}": F.log1p(m) for m in measures}
    prev_logs = {f"prev_log_{m}": F.log1p(f"prev_{m}") for m in measures}
    names = [*measures, *[f"log_{m}" for m in measures]]
    return (
        df.withColumns({**filled, "prev_date": F.coalesce("prev_date", date)})
        .withColumns({**logs, **prev_logs})
        .withColumns(
            {
                **{f"delta_{n}": F.col(n) - F.col(f"prev_{n}") for n in names},
                "gap_days": F.datediff(date, "prev_date"),
            }
        )
    )


def gap_counts(prepared: DataFrame, entity: list[str], low: int, high: int) -> DataFrame:
    """Entities and day gaps whose number of rows lies within a range, for finding lost days."""
    return (
        prepared.groupBy(*entity, "gap_days")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows").between(low, high))
    )


def quality_report(
    df: DataFrame, parent: str, child: str, entity: str, date: str, measures: list[str]
) -> DataFrame:
    """All checks as rows (check, subject, value)."""

    def rows(part: DataFrame, check: str, subject: Column, value: Column) -> DataFrame:
        return part.select(
            F.lit(check).alias("check"),
            subject.cast("string").alias("subject"),
            value.cast("double").alias("value"),
        )

    rates = match_rates(cumulative_check(df, entity, date, measures), measures)
    parts = [
        rows(ambiguous_keys(df, entity, parent), "ambiguous_key", F.col(entity), F.col("parents")),
        rows(partly_missing(df, parent, child), "partly_missing", F.col(parent),
             F.col("children")),
        rows(
            rates.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(F.lit(m).alias("measure"), F.col(f"{m}_rate").alias("rate"))
                            for m in measures
                        ]
                    )
                )
            ),
            "match_rate",
            F.col("measure"),
            F.col("rate"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
