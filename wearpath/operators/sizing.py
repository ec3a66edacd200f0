"""Broadcast only what was measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a narrow table that may be kept on the driver and broadcast.
SMALL_ROWS = 100_000


def kept_if_small(table: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, int | None]:
    """Evaluate at most ``limit + 1`` rows of a narrow table.

    Returns the rows as a local table with their number when they fit the limit, else the
    table itself with ``None``; the caller then joins it without a broadcast.
    """
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        return table, None
    return table.sparkSession.createDataFrame(rows, table.schema), len(rows)


def broadcast_if_small(table: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    kept, count = kept_if_small(table, limit)
    return kept if count is None else F.broadcast(kept)
