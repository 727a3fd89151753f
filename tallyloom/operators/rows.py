"""One-row frames next to many-row frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a frame of at most one row (nulls without a row).

    The row is one scalar subquery, run once however many of its fields are used; there is
    no join.
    """
    packed = row.select(F.struct("*")).scalar()
    return df.withColumn("_row", packed).select(*df.columns, "_row.*")
