"""The event log as a stream: windows, sessions, and last-written state.

The log itself needs no watermarks or windows; these are what Structured Streaming adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of a folder of Parquet files, with ts as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "1 day") -> DataFrame:
    """Counts and sums by window and type; works on a stream and on a table."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 day") -> DataFrame:
    """Sessions of each user: events less than a gap apart."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def latest_status(events: DataFrame) -> DataFrame:
    """Each key's last status by ts, kept as state between batches: key, status, ts. For output in update mode."""
    return events.groupBy("key").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _committed(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table that were written whole, in order."""
    fs, folder = _files(spark, f"{path}/_committed")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder)) if fs.exists(folder) else []


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that upsert_into() keeps, as it was last committed; None before the first time."""
    versions = _committed(spark, path)
    return spark.read.parquet(f"{path}/{versions[-1]}") if versions else None


def upsert_into(path: str, keys: list[str], order: Column, keep: int = 2):
    """A foreachBatch function that keeps the last row of each key in a table. A batch is merged with the version that was last committed, whatever the batch's
    own number, and written beside it; a marker commits it. So a query that starts anew with a fresh checkpoint goes on where the table is, a batch
    that fails leaves the table as it was, and one that runs twice changes nothing. The last `keep` versions stay."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        versions = _committed(spark, path)
        rows = spark.read.parquet(f"{path}/{versions[-1]}").unionByName(batch, allowMissingColumns=True) if versions else batch
        rest = [c for c in rows.columns if c not in keys]
        version = versions[-1] + 1 if versions else 0
        rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").write.mode("overwrite").parquet(f"{path}/{version}")
        fs, marker = _files(spark, f"{path}/_committed/{version}")
        fs.create(marker, True).close()
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            for gone in (f"{path}/_committed/{old}", f"{path}/{old}"):
                fs.delete(_files(spark, gone)[1], True)

    return write
