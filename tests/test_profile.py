"""One-scan profiles and prefix scans with ties on small tables."""

import datetime as dt
import random

import pytest

from tallyframe.operators.aggregates import column_profile, table_stats
from tallyframe.operators.profile import profile
from tallyframe.operators.series import prepare_series


def test_profile(spark):
    rows = [(1, "b", 0.0, True), (2, "", -0.0, None), (None, "é", float("nan"), False), (2, None, None, True)]
    df = spark.createDataFrame(rows, "`a.b` int, t string, d double, f boolean").repartition(3)
    found = {r.column: r for r in profile(df, ["a.b", "t", "d", "f"]).collect()}
    assert [(found[c].rows, found[c].nulls, found[c].distinct) for c in ("a.b", "t", "d", "f")] == [
        (4, 1, 2), (4, 1, 3), (4, 1, 2), (4, 1, 2)
    ]
    assert (found["t"].first, found["t"].last, found["t"].low) == ("", "é", None)
    assert (found["a.b"].low, found["a.b"].high, found["a.b"].first) == (1.0, 2.0, None)
    assert found["a.b"].mean == pytest.approx(5 / 3) and found["f"].first == "false"
    shown = {r.column: (r.distinct_values, r.has_empty) for r in column_profile(df, ["t", "f"]).collect()}
    assert shown == {"t": (4, 1), "f": (3, 0)}


def test_profile_of_no_rows_and_dates(spark):
    none = spark.createDataFrame([], "a int, t string")
    assert [(r.rows, r.distinct, r.last) for r in profile(none, ["a", "t"]).collect()] == [(0, 0, None)] * 2
    days = spark.createDataFrame([(dt.date(2020, 2, 1),), (dt.date(1999, 12, 31),)], "day date")
    (row,) = profile(days, ["day"]).collect()
    assert (row.first, row.last, row.distinct) == ("1999-12-31", "2020-02-01", 2)


def test_table_stats_reads_extremes_of_texts_in_one_scan(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (None, None)], "n double, t string")
    found = {r.column: r for r in table_stats(df, ["n"], ["t"]).collect()}
    assert (found["t"].min, found["t"].max, found["t"].nunique, found["t"].mean) == ("x", "y", 2, None)
    assert (found["n"].median, found["n"].mad, found["n"]["count"]) == (2.0, 1.0, 2)
    plan = profile(df, ["n", "t"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # the table and the names of its columns


def series_rows():
    r = random.Random(6)
    rows = []
    for k in range(400):
        entity = "busy" if k % 3 == 0 else r.choice(["a", "b", None])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(40)) if k % 50 else None
        rows.append((k, entity, at, float(r.randrange(1000)) if k % 17 else None))
    rows += [(1000 + k, "busy", dt.datetime(2024, 1, 2), float(k)) for k in range(200)]
    return rows


def plain_series(rows):
    found = {}
    for entity in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == entity]
        for k, _, at, value in own:
            key = at or dt.datetime.min
            upto = [r[3] for r in own if (r[2] or dt.datetime.min) <= key and r[3] is not None]
            before = [r for r in own if (r[2] or dt.datetime.min) < key]
            earlier = [r[3] for r in before if r[3] is not None]
            dates = [r[2] for r in before if r[2] is not None]
            now = max(upto, default=None)
            prev_at = max(dates, default=None) or at
            gap = (at.date() - prev_at.date()).days if at else None
            found[k] = (now, max(earlier, default=now), prev_at, gap)
    return found


@pytest.mark.parametrize("how", ["window", "day", "ranges"])
def test_series_with_ties_and_a_busy_entity(spark, how):
    from pyspark.sql import functions as F

    rows = series_rows()
    df = spark.createDataFrame(rows, "k long, entity string, at timestamp, value double")
    more = {"day": {"chunk": F.to_date("at")}, "ranges": {"rows_per_chunk": 9}}.get(how, {})
    out = prepare_series(df.repartition(4), ["entity"], "at", ["value"], **more)
    found = {r.k: (r.value, r.prev_value, r.prev_date, r.gap_days) for r in out.collect()}
    assert found == plain_series(rows)


def test_series_of_no_rows(spark):
    df = spark.createDataFrame([], "entity string, at date, value double")
    assert prepare_series(df, ["entity"], "at", ["value"], rows_per_chunk=10).collect() == []
