"""Helpers over tables that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
HASHED_BYTES = 64 << 20


def hashed(side: DataFrame, row_bytes: int, limit: int = HASHED_BYTES, rows: int | None = None) -> DataFrame:
    """A join's side with distinct keys, hashed a partition where a partition's share of its counted rows is at most `limit` bytes.

    Beyond that there is no hint: such joins are sorted, and spill.
    """
    n = side.count() if rows is None else rows
    shares = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side.hint("shuffle_hash") if n * row_bytes * 4 <= limit * shares else side  # a hashed row takes about four times its bytes


def fit(side: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The smaller side of a join, hinted by its counted size: broadcast up to `limit` bytes, beyond it as hashed() says."""
    n = side.count()
    return F.broadcast(side) if n * row_bytes <= limit else hashed(side, row_bytes, rows=n)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of the table has it, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
