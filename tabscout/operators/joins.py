"""Joining with a table that is usually small, without trusting that it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def join_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Broadcast ``right`` only after reading proves it has at most 10,000 rows.

    The rows read are then used as they are, so ``right`` is not computed again by every
    later pass. A larger table is joined the ordinary way, where adaptive execution splits
    skewed keys.
    """
    rows = right.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return left.join(right, keys, how)
    known = left.sparkSession.createDataFrame(rows, right.schema)
    return left.join(F.broadcast(known), keys, how)
