"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Fixed value: words are runs of anything but the ASCII space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that a result is about to define.

    The rule of all operators here for clashing names: a result column replaces an input column
    of the same name, whatever its case.
    """
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """The words of a text; ``bytes.split`` cuts at exactly the six blanks of ``WORD``."""
    return text.split() if text else []


def pieces(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a task holds at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def schema_of(df: DataFrame, keep: list[str], more: str) -> StructType:
    """Types of kept columns as they are, followed by further columns."""
    kept = [StructField(n, df.schema[n].dataType) for n in keep]
    return StructType(kept + StructType.fromDDL(more).fields)


def crc32_mod(column: str, divisor: int):
    """Remainder of the CRC-32 of a column written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor
