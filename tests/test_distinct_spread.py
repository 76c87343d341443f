"""Distinct counts of key sets: a task counts a bounded number of different values."""

from tallyframe.operators import aggregates as module
from tallyframe.operators.aggregates import _spread_for_distinct, multi_stat_sets


def test_rows_are_dealt_to_as_many_tasks_as_distinct_counts_need(spark, monkeypatch):
    rows = [(k % 3 or None, k % 2, k % 40, float(k % 7)) for k in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, v int, x double").coalesce(1)
    sets, stats = [["a"], ["b"], ["a", "b"]], {"v": ["nunique", "count"], "x": ["sum", "max", "median"]}

    def result():
        return sorted(map(str, multi_stat_sets(df, sets, stats).collect()))

    want = result()
    monkeypatch.setattr(module, "KEYS_PER_TASK", 100)
    assert _spread_for_distinct(df, 3, ["a", "b"], stats).rdd.getNumPartitions() == 12
    assert _spread_for_distinct(df, 3, ["a", "b"], {"x": ["sum"]}).rdd.getNumPartitions() == 1
    assert result() == want
