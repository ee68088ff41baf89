"""How many partitions rows are dealt to: as many as there are rows for, so that what a task holds doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows to a partition.
ROWS = 500_000


def partitions(table: DataFrame, rows: int | None = None) -> int:
    """Partitions for the rows of a table, at least the session's own number. table: one that is read from files, whose rows are counted without reading their columns."""
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-table.count() // (rows or ROWS)))


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df dealt by keys to n partitions; as it is where n isn't given."""
    return df.repartition(n, *keys) if n else df
