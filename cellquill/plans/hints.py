"""Broadcasts behind a check of size, and tasks by the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICTIONARY_ROWS = 2_000_000


def small(df: DataFrame, rows: int = DICTIONARY_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def dictionary(df: DataFrame, rows: int = DICTIONARY_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is no larger than ``rows`` rows; else left to a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


TASK_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys``, ``TASK_ROWS`` of its ``rows`` a task or so, however many cores there are.

    Without a number the optimiser joins partitions until there is about one a core, whose memory then grows with the input.
    """
    if rows <= TASK_ROWS:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
