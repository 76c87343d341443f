"""Series preparation, growth and forecasts."""

import datetime as dt
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import forecast as FC
from tallyframe.operators.series import (
    ambiguous_keys,
    cumulative_check,
    gap_counts,
    match_rates,
    partly_missing,
    prepare_series,
    quality_report,
    with_location,
)

START = date(2020, 1, 22)


@pytest.fixture(scope="module")
def series(spark):
    rows = []
    for place, values in {
        "p": [0, 1, 3, 2, 7, 7],  # falls once
        "q": [5],
        "r": [1, 2, None, 4],
    }.items():
        for i, v in enumerate(values):
            if (place, i) != ("p", 1):  # a missing day
                rows.append((place, START + timedelta(i), v, float(i % 2)))
    return spark.createDataFrame(
        [(p, d, None if v is None else float(v), x) for p, d, v, x in rows],
        "place string, day date, cases double, losses double",
    ).persist()


def _rows(df):
    return sorted(df.collect(), key=lambda r: (r.place, r.day))


def test_prepared_series(series):
    out = [r for r in _rows(prepare_series(series, ["place"], "day", ["cases", "losses"]))
           if r.place == "p"]
    assert [r.cases for r in out] == [0, 3, 3, 7, 7]
    assert [r.prev_cases for r in out] == [0, 0, 3, 3, 7]
    assert [r.delta_cases for r in out] == [0, 3, 0, 4, 0]
    assert [r.gap_days for r in out] == [0, 2, 1, 1, 1]
    assert out[1].delta_log_cases == pytest.approx(math.log(4))
    assert sum(r.delta_cases for r in out) == out[-1].cases - out[0].cases


@pytest.mark.parametrize("size", [1, 2, 3])
def test_chunks_give_the_same(series, size):
    plain = prepare_series(series, ["place"], "day", ["cases", "losses"])
    step = F.floor(F.datediff("day", F.lit(START)) / size)
    chunked = prepare_series(series, ["place"], "day", ["cases", "losses"], chunk=step)
    assert _rows(chunked.select(plain.columns)) == _rows(plain)


def test_gaps(series):
    out = gap_counts(prepare_series(series, ["place"], "day", ["cases"]), ["place"], 2, 68)
    found = sorted((r.place, r.gap_days, r.rows) for r in out.collect())
    assert found == [("p", 1, 3), ("r", 1, 3)]


def test_last_day_against_maximum(spark):
    rows = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, 4.0), ("b", 1, 1.0), ("b", 2, 2.0), ("c", 1, 9.0)],
        "e string, d int, v double",
    )
    check = cumulative_check(rows, "e", "d", ["v"])
    assert {r.e: r.v_agrees for r in check.collect()} == {"a": False, "b": True}
    assert match_rates(check, ["v"]).first().v_rate == 0.5


def test_locations_and_report(spark):
    rows = spark.createDataFrame(
        [("X", "", 1, 1.0), ("X", "n", 1, 1.0), ("Y", "", 1, 2.0), ("Z", "n", 2, 1.0)],
        "parent string, child string, d int, v double",
    )
    assert [r.parent for r in partly_missing(rows, "parent", "child").collect()] == ["X"]
    assert [r.child for r in ambiguous_keys(rows, "child", "parent").orderBy("child").collect()] \
        == ["", "n"]
    places = with_location(rows, "parent", "child")
    assert sorted(r.location for r in places.collect()) == ["X-X", "X-n", "Y-Y", "Z-n"]
    report = quality_report(rows.withColumn("e", F.col("child")), "parent", "child", "e", "d",
                            ["v"])
    assert {r.check for r in report.collect()} == {"ambiguous_key", "partly_missing", "match_rate"}


def test_growth_chain(spark):
    rows = spark.createDataFrame(
        [
            (0, "a", 1, 2.0), (0, "a", 1, 3.0), (0, "b", 1, 4.0),
            (0, "a", 2, 1.0), (0, "b", 2, 3.0), (1, "c", 1, 5.0), (None, "d", 1, 9.0),
        ],
        "cluster int, parent string, day int, g double",
    )
    by_cluster = FC.cluster_growth(rows, "cluster", "parent", "day", ["g"])
    found = {r.cluster: r.g for r in by_cluster.collect()}
    assert found[0] == pytest.approx(math.sqrt(2)) and found[1] is None
    own = FC.own_growth(rows, "cluster", "parent", ["g"])
    best = {r.parent: r.g for r in FC.chosen_growth(own, by_cluster, "cluster", ["g"]).collect()}
    assert best == {"a": pytest.approx(2.0), "b": 3.5, "c": 5.0}


@pytest.mark.parametrize("decay", [0.97, 1.0])
def test_forecast_is_the_daily_loop(spark, decay):
    history = spark.createDataFrame(
        [("a", START, 1.0), ("a", START + timedelta(1), 2.0), ("b", START, 3.0)],
        "e string, day date, v double",
    )
    growth = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "e string, g double")
    end = history.agg(F.max("day").alias("end"))
    until = F.date_add(end.scalar(), 40)
    out = FC.forecast(history, ["e"], "day", growth, {"v": "g"}, decay, end, until)
    ahead = {(r.day - START).days: r.v for r in out.filter("e = 'a'").collect()}
    value = 2.0
    for i in range(40):
        value += 0.5 * decay**i
        assert ahead[2 + i] == pytest.approx(value)
    assert len(ahead) == 42
    assert out.filter("e = 'b'").count() == 1  # not known on the last day of training
    counts = FC.from_logs(out, ["e"]).filter(F.col("day") == START + timedelta(1)).first()
    assert counts.v == pytest.approx(math.expm1(2.0))


@pytest.mark.parametrize("decay", [0.8, 0.97, 1.0])
def test_threshold_is_the_daily_loop(spark, decay):
    rng = np.random.default_rng(11)
    cases = []
    for i in range(300):
        value, change = float(rng.uniform(0, 8)), float(rng.uniform(-0.05, 0.4))
        cases.append((i, START, value, change if i % 29 else 0.0))
    for threshold in (10.0, 1000.0):
        want = {}
        for i, _, value, change in cases:
            want[i] = None
            for n in range(400):
                value += change * decay**n
                if np.round(np.exp(value) - 1, 0) >= threshold:
                    want[i] = START + timedelta(n + 1)
                    break
        rows = spark.createDataFrame(cases, "i int, day date, v double, g double")
        out = FC.threshold_date(rows, "day", "v", "g", decay, threshold, "at", 400)
        assert {r.i: r["at"] for r in out.collect()} == want
    none = FC.threshold_date(rows, "day", "v", "g", decay, None, "at")
    assert none.filter("at is not null").isEmpty()


def test_every_entity_is_forecast_from_its_own_last_day(spark):
    rows = [("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 4), 2.0), ("b", dt.date(2024, 1, 2), 5.0)]
    history = spark.createDataFrame(rows, "e string, day date, v double")
    growth = spark.createDataFrame([("a", 0.5)], "e string, g double")
    until = F.lit("2024-01-05").cast("date")
    out = FC.forecast(history, ["e"], "day", growth, {"v": "g"}, 1, None, until)
    found = sorted((r.e, r.day.day, r.v) for r in out.collect())
    assert found == [("a", 1, 1.0), ("a", 4, 2.0), ("a", 5, 2.5), ("b", 2, 5.0), ("b", 3, 5.0),
                     ("b", 4, 5.0), ("b", 5, 5.0)]
    filled = FC.carried_days(out, ["e"], "day").filter("e = 'a'")
    assert sorted((r.day.day, r.v) for r in filled.collect()) == [
        (1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, 2.5)
    ]


def test_thresholds_are_looked_for_to_the_end_of_the_calendar(spark):
    rows = [(0, 0.0, 1e-3), (1, 0.0, 1e-9)]
    last = spark.createDataFrame(rows, "e int, v double, g double").withColumn(
        "day", F.lit("2024-01-01").cast("date")
    )
    found = FC.threshold_date(last, "day", "v", "g", 1, 100.0, "at").orderBy("e").collect()
    steps = next(n for n in range(1, 10_000) if round(np.expm1(n * 1e-3)) >= 100)
    assert found[0].at == dt.date(2024, 1, 1) + dt.timedelta(days=steps) and found[1].at is None
