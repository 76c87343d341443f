"""Contests between two sides: who met whom, and with which outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(side_a: str, side_b: str, name: str) -> Column:
    return (F.col(side_a) == name) | (F.col(side_b) == name)


def opponents(df: DataFrame, side_a: str, side_b: str, name: str, out: str) -> DataFrame:
    """One row per contest and opponent of ``name``, whichever side it stood on.

    Both sides are read in one pass; a contest of ``name`` with itself counts from either side.
    """
    others = F.array_compact(
        F.array(
            F.when(F.col(side_a) == name, F.col(side_b)),
            F.when(F.col(side_b) == name, F.col(side_a)),
        )
    )
    return df.filter(takes_part(side_a, side_b, name)).withColumn(out, F.explode(others))
