"""Broadcasts behind a counted bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a small side, such as one for each label, that are brought to the driver and broadcast.
MOST_ROWS = 10_000


def broadcast_if_few(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The rows themselves, broadcast, if there are at most ``most``; else the table, for a shuffled join.

    Computed once where it is small: what is joined is then a local table.
    """
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df
