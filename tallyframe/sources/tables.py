"""Table sources and sinks: Parquet tables, CSV with or without empty texts, local rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tallyframe.session import cut_lineage

# fixed values: texts that a lenient CSV reader takes for a missing value
MISSING_TOKENS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "<NA>", "#N/A"]

_CSV = {"header": True, "quote": '"', "escape": '"'}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _typed(text: Column, field: StructField) -> Column:
    kept = text if isinstance(field.dataType, StringType) else F.trim(text)
    return kept.cast(field.dataType).alias(field.name)


def infer_schema(
    spark: SparkSession, path: str, line_breaks: bool = True, dates: bool = True
) -> StructType:
    """Column types of a CSV with a header line, from all its rows in one scan.

    A column is of the least type that holds all its values: integer within double, and both,
    dates (``yyyy-mm-dd``) and anything else within text. Missing values fit every type, so a
    column of nothing else is text too. Whole numbers beyond 64 bits make a column double. Each
    row is folded into one flag per column and type; one row of flags comes to the driver.
    """
    raw = spark.read.csv(path, **_CSV, multiLine=line_breaks, inferSchema=False)
    flags = []
    for i, name in enumerate(raw.columns):
        value = F.col(f"`{name}`")
        text = F.when(~value.isin(MISSING_TOKENS), F.trim(value))
        tests = {
            "whole": text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull(),
            "number": text.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"),
            "day": text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(),
        }
        known = {t: F.bool_and(F.when(text.isNotNull(), test)) for t, test in tests.items()}
        flags.append(F.struct(*[fits.alias(t) for t, fits in known.items()]).alias(f"c{i}"))
    found = raw.agg(*flags).first() if flags else []
    schema = StructType()
    for name, fits in zip(raw.columns, found):
        if fits.whole:
            kind = LongType()
        elif fits.number:
            kind = DoubleType()
        else:
            kind = DateType() if fits.day and dates else StringType()
        schema = schema.add(name, kind)
    return schema


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    keep_empty: bool = False,
    line_breaks: bool = True,
) -> DataFrame:
    """CSV with a header line and a declared schema, or one inferred from all rows.

    With ``keep_empty`` a text field keeps what the file holds: an empty field is the empty
    text and "NA" is a text. Otherwise empty fields and the missing-value texts become null.
    Fields may hold line breaks, for which a file must be read by one task; say so with
    ``line_breaks=False`` when there are none, and large files are split.
    """
    if schema is None:
        schema = infer_schema(spark, path, line_breaks)
    options = {**_CSV, "multiLine": line_breaks}
    texts = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
    if keep_empty:
        raw = spark.read.schema(schema).csv(path, nullValue="\u0000", emptyValue="", **options)
        return raw.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in texts})
    # Numbers are read as text first: a token such as "NA" would fail their parser.
    as_text = StructType()
    for field in schema.fields:
        as_text = as_text.add(field.name, StringType())
    raw = spark.read.schema(as_text).csv(path, **options)
    return raw.select(
        *[
            _typed(F.when(~F.col(f"`{f.name}`").isin(MISSING_TOKENS), F.col(f"`{f.name}`")), f)
            for f in schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """CSV with a header line, texts kept to the last blank; replaces what the path held.

    Files are bounded, so that reading them back is spread over many tasks.
    """
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).csv(
        path,
        header=True,
        quote='"',
        escape='"',
        quoteAll=True,
        emptyValue="",
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the program itself as a table."""
    return spark.createDataFrame(rows, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Hand-off between tasks: write the table to the shared folder once and read it back."""
    return cut_lineage(df, name)


def last_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows in the given order, as a top-n from the other end."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
