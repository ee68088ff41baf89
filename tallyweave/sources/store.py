"""Tables that stand for stores: chunks with vectors, document records, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.extraction import with_ids

#: Folders that chunks are dealt to by document.
BUCKETS = 64


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_index, text, version, ...) with their ids, the latest version of each."""
    rows = with_ids(chunks)
    rest = [c for c in rows.columns if c not in ("chunk_id", "version")]
    return rows.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "version").alias("r"), F.max("version").alias("version")).select("chunk_id", "r.*", "version")


def _bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(BUCKETS)).cast("int")


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Adds the latest chunks to the store, in folders by document: a reader of a few documents opens theirs alone. Nothing that is stored
    is written over, so that a store that fails midway loses nothing; readers take the latest of each chunk."""
    rows = latest_chunks(chunks).withColumns({"bucket": _bucket(F.col("doc_id")), "stored": F.current_timestamp(), "deleted": F.lit(False)})
    rows.repartition("bucket").write.mode("append").option("mergeSchema", True).partitionBy("bucket").parquet(path)


def delete_chunks(ids: DataFrame, path: str) -> None:
    """Deletes the chunks of these documents (doc_id) from the store: a row for each says from when on they are gone. Chunks stored later are there."""
    rows = ids.select("doc_id").where("doc_id is not null").distinct().withColumns({"bucket": _bucket(F.col("doc_id")), "stored": F.current_timestamp(), "deleted": F.lit(True)})
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """All stored chunks, the latest version of each and of equal versions the one stored last, or those of some documents; then only
    their folders are read."""
    out = spark.read.option("mergeSchema", True).parquet(path)
    if doc_ids is not None:
        ids = spark.createDataFrame([(str(x),) for x in doc_ids], "id string").select(_bucket(F.col("id")).alias("b"))
        out = out.where(F.col("bucket").isin([r.b for r in ids.distinct().collect()])).where(F.col("doc_id").cast("string").isin([str(x) for x in doc_ids]))
    gone = out.where("deleted").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("stored").alias("_gone"))
    rows = out.where("not deleted").drop("bucket", "deleted")
    rows = rows.join(gone, rows["doc_id"] == gone["_doc"], "left").where("_gone is null or stored > _gone").drop("_doc", "_gone")
    rest = [c for c in rows.columns if c not in ("chunk_id", "stored")]
    return rows.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), F.struct("version", "stored")).alias("r")).select("chunk_id", "r.*")


def compact_chunks(spark: SparkSession, path: str, to: str) -> None:
    """Writes what read_chunks() gives into another folder, without older versions and deleted documents."""
    rows = read_chunks(spark, path).withColumns({"bucket": _bucket(F.col("doc_id")), "stored": F.current_timestamp(), "deleted": F.lit(False)})
    rows.repartition("bucket").write.partitionBy("bucket").parquet(to)


def check_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """The vectors, with an error at the first of another size when they are read."""
    fits = F.size("embedding") == dimension
    return vectors.where(F.coalesce(F.assert_true(F.coalesce(fits, F.lit(False)), F.lit(f"an embedding has not {dimension} numbers")).isNull(), F.lit(True)))


def of_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Every chunk of these documents."""
    return chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def without_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left once the chunks of these documents are deleted."""
    return chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def latest_documents(records: DataFrame, order: Column) -> DataFrame:
    """The last written record of each document."""
    rest = [c for c in records.columns if c != "doc_id"]
    return records.groupBy("doc_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("doc_id", "r.*")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("audit_id").agg(F.count("*").alias("events"))


def cleared(events: DataFrame, audits: DataFrame) -> DataFrame:
    """The log without the events of audits that start anew."""
    return events.join(audits.select("audit_id").distinct(), "audit_id", "left_anti")


def ingested(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (filename, error) that were read, and those that were not with their errors; an error if there is none of the first."""
    good, bad = files.where("error is null"), files.where("error is not null").select("filename", "error")
    if not good.head(1) and bad.head(1):
        raise ValueError("; ".join(f"{r.filename}: {r.error}" for r in bad.orderBy("filename").limit(10).collect()))
    return good, bad
