"""Rows dealt out to tasks by what is made of them.

Adaptive execution sizes tasks by the bytes that it reads.  Short compressed rows of
which lines with many columns, or documents, are made would so come to a few tasks
whose memory and time grow with the input.  Here a task's share is fixed and the number
of tasks grows; that number is explicit, so adaptive execution does not merge them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About how much text, and how many rows that each become a file, a task gets. One object is never cut.
TEXT_BYTES, ROWS = 1_000_000, 4_000


def _dealt(rows: DataFrame, shares: int, key: str | Column) -> DataFrame:
    return rows.repartition(max(shares, rows.sparkSession.sparkContext.defaultParallelism), key)


def by_text(objects: DataFrame, each: int | None = None) -> DataFrame:
    """Objects (object_key, text), those of one key in one task; what follows needs no further exchange by object_key."""
    total = objects.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _dealt(objects, -(-total // (each or TEXT_BYTES)), "object_key")


def by_count(rows: DataFrame, key: str | Column, each: int | None = None) -> DataFrame:
    return _dealt(rows, -(-rows.count() // (each or ROWS)), key)
