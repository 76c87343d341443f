"""Order statistics, ranks and grouped statistics against pandas, with buckets forced."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.operators import aggregates as A
from tallyframe.operators.order_stats import order_stats
from tallyframe.operators.ranges import dense_rank_all, top_dense


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 900
    out = pd.DataFrame(
        {
            "drug": rng.choice(["a", "a", "a", "b", "c", "d"], n),
            "use": rng.choice(["x", "y", "z"], n),
            "score": np.round(rng.exponential(10, n), 1),
            "times": rng.integers(0, 4, n),
        }
    )
    out.loc[out.index[::17], "use"] = None
    out.loc[out.index[::13], "score"] = np.nan
    out.loc[len(out)] = ["lonely", "x", 3.5, 1]
    return out


@pytest.fixture(scope="module")
def table(spark, frame):
    rows = [
        tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)
        for r in frame.astype(object).itertuples(index=False)
    ]
    return spark.createDataFrame(
        rows, "drug string, use string, score double, times long"
    ).persist()


def _expected(frame, keys):
    known = frame.dropna(subset=keys)
    out = known.groupby(keys).agg(
        score_median=("score", "median"),
        score_std=("score", "std"),
        times_median=("times", "median"),
        times_sum=("times", "sum"),
        score_mad=("score", lambda s: (s - s.mean()).abs().mean()),
    )
    return out.reset_index()


STATS = {"score": ["median", "std", "mad"], "times": ["median", "sum"]}


@pytest.mark.parametrize("rows_per_bucket", [25, 1_000_000])
def test_multi_stat_is_pandas(table, frame, rows_per_bucket):
    for keys in (["drug"], ["drug", "use"]):
        got = A.multi_stat(table, keys, STATS, rows_per_bucket).toPandas()
        want = _expected(frame, keys)
        got = got[want.columns].sort_values(keys).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert A.multi_stat(table, ["drug"], {"score": ["std"]}).filter(
        "drug = 'lonely' and score_std is null"
    ).count() == 1


@pytest.mark.parametrize("rows_per_bucket", [25, 1_000_000])
def test_grouping_sets_are_single_sets(table, frame, rows_per_bucket):
    sets = [["drug"], ["use"], ["drug", "use"]]
    got = A.multi_stat_sets(table, sets, STATS, rows_per_bucket).toPandas()
    for keys in sets:
        part = got[got.key_set == "+".join(keys)]
        want = _expected(frame, keys)
        part = part[want.columns].sort_values(keys).reset_index(drop=True)
        pd.testing.assert_frame_equal(part, want, check_dtype=False)


def test_whole_table(table, frame):
    got = A.describe_exact(table, ["score", "times"], 20).toPandas().set_index("column")
    got = got.loc[["score", "times"]]
    want = frame[["score", "times"]].describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert np.allclose(got[ours], want.loc[theirs])
    stats = A.table_stats(table, ["score"], ["drug"], 20).toPandas().set_index("column")
    assert stats.loc["drug", "nunique"] == frame.drug.nunique()
    assert stats.loc["drug", ["std", "median", "mad"]].isna().all()
    score = frame.score.dropna()
    assert stats.loc["score", "mad"] == pytest.approx((score - score.mean()).abs().mean())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40),
    st.integers(1, 10),
)
def test_quantiles_of_any_values(spark, values, rows_per_bucket):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = order_stats(
        rows, [[]], ["v"], {"q": 0.3, "top": 1.0}, True, rows_per_bucket
    ).first()
    assert out.q == pytest.approx(np.quantile(values, 0.3), rel=1e-9, abs=1e-9)
    assert out.top == max(values)
    mad = np.abs(np.array(values) - np.mean(values)).mean()
    assert out.mad == pytest.approx(mad, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("rows_per_bucket", [20, 1_000_000])
@pytest.mark.parametrize("descending", [True, False])
def test_dense_rank_over_all(table, frame, rows_per_bucket, descending):
    got = dense_rank_all(table, "score", "rank", descending, rows_per_bucket).toPandas()
    want = got.score.rank(method="dense", ascending=not descending)
    assert len(got) == len(frame)
    assert np.array_equal(got["rank"].to_numpy(float), want.to_numpy(), equal_nan=True)


def test_top_keeps_ties(spark):
    rows = spark.createDataFrame(
        [("h", 9), ("h", 9), ("h", 8), ("h", 7), ("a", 1), ("a", None)], "g string, n long"
    )
    out = sorted((r.g, r.n, r["rank"]) for r in top_dense(rows, ["g"], "n", 2, "rank").collect())
    assert out == [("a", 1, 1), ("h", 8, 2), ("h", 9, 1), ("h", 9, 1)]


def test_correlation_matrix(table, frame):
    both = table.select("score", "times")
    got = A.corr_long(both, ["score", "times"]).collect()
    r = {(x.a, x.b): x.r for x in got}
    assert len(got) == 4
    assert r["score", "times"] == r["times", "score"]
    assert r["score", "score"] == pytest.approx(1)
    assert r["score", "times"] == pytest.approx(frame[["score", "times"]].corr().iloc[0, 1])


def test_shares_within_groups(table):
    counts = table.groupBy("drug", "use").agg(F.count(F.lit(1)).alias("n"))
    out = A.share_within(counts, ["drug"]).groupBy("drug").agg(F.sum("percentage").alias("p"))
    assert all(r.p == pytest.approx(100) for r in out.collect())


def test_match_rate_with_nulls(spark):
    rows = spark.createDataFrame([(1, 1), (1, None), (None, None), (2, 2)], "a long, b long")
    assert rows.agg(A.match_rate(F.col("a"), F.col("b"))).first()[0] == 0.5


def test_wide_matrix(spark):
    from tallyframe.operators.aggregates import wide_matrix

    rows = [("a", d, float(d)) for d in range(0, 50, 2)] + [("b", 3, 1.5), (None, 49, 2.5), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    days = sorted({r[1] for r in rows if r[1] is not None}, key=int)
    wide = wide_matrix(df.repartition(3), "k", "d", "v", block=4, prefix="d")
    assert wide.columns == ["k", *[f"d{d}" for d in days]]
    found = {r.k: [r[f"d{d}"] for d in days] for r in wide.collect()}
    cells = {(r[0], r[1]): r[2] for r in rows}
    assert found == {k: [cells.get((k, d)) for d in days] for k in ("a", "b", None, "c")}
    assert wide_matrix(df.limit(0), "k", "d", "v").columns == ["k"]
