"""Tables as streams: their rows in order of arrival, in files that a stream reads one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.folders import new_folder


def arrivals(rows: DataFrame, arrived: Column, parts: int, folder: str, last: DataFrame | None = None) -> None:
    """Writes rows into a folder in `parts` batches, in order of arrival; rows without one come first, and `last` (of the same columns) at the end.

    The bounds are approximate quantiles of the arrival: they only say how evenly the batches are filled."""
    at = F.coalesce(F.unix_micros(arrived.cast("timestamp")), F.lit(0))
    rows = rows.withColumn("_at", at)
    (bounds,) = rows.agg(F.percentile_approx("_at", [k / parts for k in range(1, parts)], 1000)).first()
    bounds = sorted(set(bounds or []))
    for k in range(len(bounds) + 1):
        part = rows if k == 0 else rows.where(F.col("_at") > bounds[k - 1])
        part = part if k == len(bounds) else part.where(F.col("_at") <= bounds[k])
        part.drop("_at").write.mode("append").parquet(folder)
    if last is not None:
        last.select(*rows.drop("_at").columns).write.mode("append").parquet(folder)


def lateness(rows: DataFrame, ts: Column, arrived: Column) -> str:
    """The longest time from an event to its arrival, as an interval: a watermark that drops nothing of a replay."""
    (most,) = rows.agg(F.max(F.unix_micros(arrived.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")))).first()
    return f"{max(0, most or 0) // 1_000_000 + 1} seconds"


def replayed(spark: SparkSession, folder: str, schema, work: Callable[[DataFrame], DataFrame], files: int | None = None, partitions: int | None = None) -> DataFrame:
    """The rows that a streaming query `work` appends for a folder of files, in the order in which they were written, as a table. The query keeps its
    checkpoint and its rows in the shared folder, and starts again from there if it fails.

    files: files to a batch; by default as many as Spark has written for one. partitions: how many the query's state is dealt to, which stays so for its checkpoint; by default the session's number."""
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", files) if files else source
    out = new_folder(spark, "stream")
    frame = work(source.parquet(folder))
    number = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions or number))
        query = frame.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", number)  # the query has its own session from its start on
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{out}/rows")
