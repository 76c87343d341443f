"""Column, date, join, aggregate and source operators on small hand-made tables."""

import struct
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from tallyframe.functions import columns as C
from tallyframe.functions import dates as D
from tallyframe.operators import aggregates as A
from tallyframe.operators import joins as J
from tallyframe.operators.boxes import cluster_boxes, crop_rects
from tallyframe.operators.outcomes import opponents
from tallyframe.session import shared_path
from tallyframe.sources.images import crop_pixels, read_images, to_grey, write_images
from tallyframe.sources.tables import last_rows, local_rows, read_csv, staged, write_csv

MATCHES = [
    ("A", "B", "A", "12 runs", "City (north)", "Jan 5, 2001"),
    ("B", "A", "tied", "5 wickets", "City (south)", "Feb 6, 2001"),
    ("A", "C", "no result", None, "Town (east)", "Mar 7, 2002"),
    ("C", "A", None, "forfeited", "Town (east)", "Mar 8, 2002"),
    ("A", "B", "A", "12 runs", "City (north)", "Jan 5, 2001"),
    ("B", "C", "B", "1 runs", "Town (east)", "Apr 9, 2003"),
]


@pytest.fixture(scope="module")
def matches(spark):
    names = "a string, b string, winner string, margin string, ground string, day string"
    rows = local_rows(spark, MATCHES, names)
    flag = C.flag(
        [
            (F.col("winner") == "A", "win"),
            ((F.col("winner") == "no result") | (F.col("winner") == "tied"), "tie"),
        ],
        "lose",
    )
    return rows.withColumn("outcome", flag).persist()


def test_null_winner_loses_and_shares_use_distinct_rows(matches):
    played = matches.filter("a = 'A' or b = 'A'")
    out = {r.outcome: (r.n, r.percentage) for r in A.share_of(played, "outcome").collect()}
    assert out == {"win": (2, 50.0), "tie": (2, 50.0), "lose": (1, 25.0)}
    all_rows = A.share_of(played, "outcome", "rows").agg(F.sum("percentage")).first()[0]
    assert all_rows == pytest.approx(100)


def test_opponents_from_either_side(matches):
    met = opponents(matches, "a", "b", "A", "team").groupBy("team").count().collect()
    assert {r.team: r["count"] for r in met} == {"B": 3, "C": 2}


def test_text_parts(matches):
    out = matches.select(
        C.part_at(F.col("ground"), r" \(", 0).alias("ground"),
        C.number_in(C.part_at(F.col("margin"), " ", 0)).alias("amount"),
        C.part_at(F.col("margin"), " ", 1).alias("unit"),
        F.trim(C.part_at(F.col("day"), ",", 1)).alias("year"),
    ).collect()
    assert out[0] == ("City", 12.0, "runs", "2001")
    assert out[2] == ("Town", None, None, "2002")
    assert out[3] == ("Town", None, None, "2002")


def test_pivot_fills_absent_outcomes(matches):
    counts = matches.groupBy("a").pivot("outcome", ["lose", "tie", "win"])
    wide = A.pivot_agg(
        matches.withColumn("n", F.lit(1.0)), ["a"], "outcome", ["lose", "tie", "win"],
        F.avg("n"), 2, 0,
    )
    assert {r.a: (r.lose, r.tie, r.win) for r in wide.collect()}["B"] == (1.0, 1.0, 0.0)
    assert counts.count().count() == 3


def test_pivot_single_refuses_two_rows(spark):
    rows = local_rows(spark, [("x", "d1", 1.0), ("x", "d1", 2.0)], "k string, d string, v double")
    with pytest.raises(Exception, match="more than one row"):
        A.pivot_single(rows, "k", "d", ["d1"], "v").collect()


def test_fill_and_impute(spark):
    rows = local_rows(
        spark, [(1.0, None, "", "X"), (2.0, 5.0, "p", "Y")],
        "v double, prev_v double, child string, parent string",
    )
    assert [r.prev_v for r in C.fill_from_sibling(rows, "prev_").collect()] == [1.0, 5.0]
    kept = rows.select(C.or_other_if_empty(F.col("child"), F.col("parent")).alias("c"))
    assert [r.c for r in kept.collect()] == ["X", "p"]
    nan = local_rows(spark, [(float("nan"),), (1.0,)], "v double")
    assert C.nan_to_null(nan).agg(F.avg("v")).first()[0] == 1.0
    assert C.map_numbers(nan.limit(0), F.expm1, []).columns == ["v"]
    tokens = local_rows(spark, [("NA",), ("b",)], "t string")
    found = tokens.select(C.null_if_in(F.col("t"), ["NA"]).alias("t")).collect()
    assert [r.t for r in found] == [None, "b"]


def test_day_difference_is_signed(spark):
    pair = local_rows(
        spark, [("2018-07-01 17:11:35", "2018-07-03 17:11:35")], "a string, b string"
    )
    row = pair.select(
        F.datediff(D.day_of(F.col("a")), D.day_of(F.col("b"))).alias("d"),
        D.days_within(D.day_of(F.col("a")), D.day_of(F.col("b")), 1, 10).alias("w"),
        D.epoch_seconds(F.col("a")).alias("s"),
        D.stamp_text(D.epoch_seconds(F.col("a"))).alias("t"),
    ).first()
    assert (row.d, row.w, row.t) == (-2, False, "2018-07-01 17:11:35")
    assert row.s == 1530465095


@pytest.fixture(scope="module")
def shipments(spark):
    days = [date(2020, 1, 1), date(2020, 1, 1), date(2020, 1, 20), None]
    orders = local_rows(
        spark, list(zip([1, 2, 1, 1], days, ["o1", "o2", "o3", "o4"])),
        "k long, day date, name string",
    )
    ships = local_rows(
        spark,
        [
            (1, date(2020, 1, 1), "same"),
            (1, date(2020, 1, 2), "one"),
            (1, date(2020, 1, 11), "ten"),
            (1, date(2020, 1, 12), "eleven"),
            (1, date(2019, 12, 31), "before"),
            (3, date(2020, 1, 2), "other"),
        ],
        "s long, shipped date, ship string",
    )
    return orders, ships


def test_day_range_keeps_unmatched_once(shipments):
    orders, ships = shipments
    out = J.day_range_join(orders, ships, {"k": "s"}, "day", "shipped", 1, 10)
    found = sorted((r.name, r.ship or "") for r in out.collect())
    assert found == [("o1", "one"), ("o1", "ten"), ("o2", ""), ("o3", ""), ("o4", "")]


def test_counts_with_and_without_unmatched(shipments):
    orders, ships = shipments
    args = (orders, ships, {"k": "s"}, "day", "shipped", "ship", 1, 10)
    kept = {r.ship: r.n for r in J.count_within_days(*args, keep_unmatched=True).collect()}
    assert kept == {"one": 1, "ten": 1, None: 3}
    dropped = {r.ship: r.n for r in J.count_within_days(*args, keep_unmatched=False).collect()}
    assert dropped == {"one": 1, "ten": 1}


def test_group_max_with_ties(spark):
    rows = local_rows(spark, [(1, "b"), (1, "b"), (1, "a"), (2, "c")], "id long, d string")
    out = sorted(tuple(r) for r in J.with_group_max(rows, ["id"], "d", "top").collect())
    assert out == [(1, "a", "b"), (1, "b", "b"), (1, "b", "b"), (2, "c", "c")]


def test_merge_suffixes(spark):
    a = local_rows(spark, [(1, 2, 9)], "k long, v long, only_a long")
    b = local_rows(spark, [(1, 3, 8)], "k long, v long, only_b long")
    assert J.merge(a, b, "k").first().asDict() == {
        "k": 1, "v_x": 2, "only_a": 9, "v_y": 3, "only_b": 8
    }


def test_profile_counts_missing_as_a_value(spark):
    rows = local_rows(spark, [("",), ("a",), (None,), ("a",)], "t string")
    row = A.column_profile(rows, ["t"]).first()
    assert (row.distinct_values, row.has_empty) == (3, 1)


def test_members_are_split_but_never_lost(spark):
    rows = spark.range(0, 1000).select((F.col("id") % 2).alias("g"), "id")
    parts = A.members_list(rows, "g", "id", part_size=100).collect()
    assert len(parts) > 2
    for g in (0, 1):
        together = sorted(m for p in parts if p.g == g for m in p.members)
        assert together == list(range(g, 1000, 2))
    one = A.members_list(rows, "g", "id").collect()
    assert [p.part for p in one] == [0, 0]


def test_csv_keeps_or_drops_empty_texts(spark):
    rows = local_rows(
        spark, [(1, 'say "hi"\nyou', "NA", 1.5), (2, "", " x ", None)],
        "id long, a string, b string, v double",
    )
    path = shared_path(spark, "csv")
    write_csv(rows, path)
    schema = StructType().add("id", LongType()).add("a", StringType()).add("b", StringType())
    schema = schema.add("v", DoubleType())
    kept = sorted(tuple(r) for r in read_csv(spark, path, schema, keep_empty=True).collect())
    assert kept == [(1, 'say "hi"\nyou', "NA", 1.5), (2, "", " x ", None)]
    lenient = sorted(tuple(r) for r in read_csv(spark, path, schema).collect())
    assert lenient == [(1, 'say "hi"\nyou', None, 1.5), (2, None, " x ", None)]
    write_csv(rows.limit(1), path)
    assert read_csv(spark, path, schema).count() == 1


def test_staged_and_last_rows(spark):
    rows = staged(spark.range(0, 20), "numbers")
    assert rows.count() == 20 and "parquet" in rows.inputFiles()[0]
    assert [r.id for r in last_rows(rows, 3, "id").collect()] == [19, 18, 17]


def _bmp(width, height, pixel):
    row = b"".join(bytes(pixel(x, y)) for y in [0] for x in range(width))
    pad = b"\0" * (-len(row) % 4)
    body = b"".join(
        b"".join(bytes(pixel(x, y)) for x in range(width)) + pad for y in reversed(range(height))
    )
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0)
    return head + info + body


def test_images_are_read_cropped_and_turned_grey(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.bmp").write_bytes(_bmp(6, 5, lambda x, y, i=i: (10 * x, 20 * y, 30 * i)))
    (folder / "broken.bmp").write_bytes(b"not an image")
    images = read_images(spark, str(folder), first=30)
    assert images.count() == 3
    assert read_images(spark, str(folder), first=2).count() == 2
    grey = {r.image_id[-5]: r for r in to_grey(images).collect()}
    expected = [int(0.114 * 10 * x + 0.587 * 20 * y + 0.299 * 30 + 0.5)
                for y in range(5) for x in range(6)]
    assert list(grey["1"].data) == expected and grey["1"].n_channels == 1

    ids = images.select("image_id")
    rect = [F.lit(v).alias(n) for n, v in
            (("cluster", 0), ("left", -1), ("top", 2), ("width", 3), ("height", 9))]
    off = [F.lit(v).alias(n) for n, v in
           (("cluster", 1), ("left", 50), ("top", 2), ("width", 3), ("height", 9))]
    crops = crop_pixels(images, ids.select("*", *rect).union(ids.select("*", *off))).collect()
    assert len(crops) == 3
    assert {(c.width, c.height) for c in crops} == {(2, 3)}
    second = next(c for c in crops if c.image_id[-5] == "2")
    assert list(second.data)[:6] == [0, 40, 60, 10, 40, 60]
    path = shared_path(spark, "pixels")
    write_images(to_grey(images), path)
    assert spark.read.parquet(path).count() == 3


def test_boxes_and_rectangles(spark):
    points = local_rows(
        spark, [(1, 10.0, 5.0), (1, 30.0, 45.0), (2, -3.9, 0.0)], "c long, x double, y double"
    )
    boxes = cluster_boxes(points, ["c"], "x", "y")
    first = boxes.filter("c = 1").first()
    assert first.corners == [[10.0, 5.0], [30.0, 5.0], [30.0, 45.0], [10.0, 45.0]]
    rects = {r.c: (r.left, r.top, r.width, r.height) for r in crop_rects(boxes).collect()}
    assert rects == {1: (9, 3, 22, 44), 2: (-3, 0, 0, 0)}
