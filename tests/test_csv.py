"""Inferred CSV types on hand-made files."""

import datetime as dt

import pytest

from tallyframe.sources.tables import infer_schema, read_csv


def write(tmp_path, *texts):
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def types(spark, path, **more):
    return {f.name: f.dataType.simpleString() for f in infer_schema(spark, path, **more).fields}


@pytest.mark.parametrize(
    "values,expected",
    [
        (["1", "-2", "+03"], "bigint"),
        (["1", "NA", ""], "bigint"),
        (["1", "2.5", "NaN"], "double"),
        (["1", "1e3", ".5", "3."], "double"),
        (["1", "99999999999999999999"], "double"),
        (["2020-02-29", "null", "1999-01-01"], "date"),
        (["2020-02-30", "1999-01-01"], "string"),
        (["2020-02-28", "1"], "string"),
        (["1", "1d"], "string"),
        (["1", "x"], "string"),
        (["NA", "", "None"], "string"),
        ([" 7", "8 "], "bigint"),
    ],
)
def test_types(spark, tmp_path, values, expected):
    path = write(tmp_path, "k,v\n" + "".join(f'{k},"{v}"\n' for k, v in enumerate(values)))
    assert types(spark, path) == {"k": "bigint", "v": expected}


def test_all_rows_of_all_files_count(spark, tmp_path):
    path = write(tmp_path, "a,b\n" + "1,2020-01-01\n" * 3000, "a,b\n5,2020-01-02\nlate,2020-01-03\n")
    assert types(spark, path) == {"a": "string", "b": "date"}
    assert types(spark, path, dates=False) == {"a": "string", "b": "string"}


def test_read_without_schema(spark, tmp_path):
    path = write(tmp_path, 'n,t,d,odd.name\n1,"a\nb",2020-01-01,NA\n NA,,null,2.5\n')
    rows = read_csv(spark, path).collect()
    assert [(r.t, r.d, r["odd.name"]) for r in rows] == [
        ("a\nb", dt.date(2020, 1, 1), None), (None, None, 2.5)
    ]


def test_header_alone(spark, tmp_path):
    path = write(tmp_path, "a,b\n")
    back = read_csv(spark, path)
    assert back.columns == ["a", "b"] and back.collect() == []
