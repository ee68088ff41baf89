"""Sessions, reports and other documents of mixed shapes as VARIANT: one table, by key and kind, whose entries may expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (key, kind, document, written_at, ttl: seconds or null; seq, the order of those of one time, where they have it) with the document as VARIANT and expires_at; and those whose document is
    no JSON, or whose key is null, as they came. A null document is no JSON; the JSON null is a document."""
    rows = entries.withColumn("value", F.try_parse_json("document"))
    good = F.col("value").isNotNull() & F.col("key").isNotNull()
    until = F.when(F.col("ttl").isNotNull(), F.timestamp_micros(F.unix_micros("written_at") + F.col("ttl").cast("long") * 1_000_000))
    rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0))
    kept = rows.where(good).withColumn("expires_at", until).select("key", "kind", "value", "written_at", "seq", "expires_at")
    return kept, rows.where(~good).select(entries.columns)


def current(table: DataFrame, now: Column) -> DataFrame:
    """The last written entry of each key and kind, without those that have expired by now: one that has expired doesn't bring back what it replaced."""
    last = table.groupBy("key", "kind").agg(F.max_by(F.struct("value", "written_at", "expires_at"), F.struct("written_at", "seq", F.to_json("value"))).alias("r")).select("key", "kind", "r.*")
    return last.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def shapes(table: DataFrame) -> DataFrame:
    """(kind, n, shape): the shape that all documents of a kind have together."""
    return table.groupBy("kind").agg(F.count("*").alias("n"), F.schema_of_variant_agg("value").alias("shape"))


def field(path: str, kind: str) -> Column:
    """A field of the document, null where it isn't there or of another type."""
    return F.try_variant_get("value", path, kind)
