"""Joins that bring no table to the driver that grows with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 20_000


def counted(df: DataFrame) -> int:
    """The rows of df, or FEW + 1 if there are more."""
    return df.limit(FEW + 1).count()


def side(df: DataFrame, few: bool) -> DataFrame:
    """df as the right side of a join: copied to all executors if it has few rows, else sorted and merged, as
    Spark itself goes by the size of compressed columns and would copy millions of rows by way of the driver."""
    return F.broadcast(df) if few else df.hint("merge")
