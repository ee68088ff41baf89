"""Corpus cleaning: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontamination, jaccard, packing, quality, suffixes
from tallyweave.llm.shared import drop_written, fresh, passing, prepare, written

#: Removed documents whose ids are broadcast; beyond that the join is shuffled.
SENT_IDS = 500_000
#: Near duplicates: words in a shingle, and least similarity in percent.
SHINGLE, SIMILAR = 5, 80


def _without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in removed(doc_id); a null doc_id stays."""
    name = fresh(docs, "_removed")
    with passing(docs.sparkSession) as keep:
        removed = keep(written(removed.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct()))
    few = removed.count() <= SENT_IDS
    return docs.join(F.broadcast(removed) if few else removed, docs["doc_id"] == removed[name], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows of one doc_id go together: all if one is rejected; a row
    without doc_id stays. Null, empty and wordless texts are rejected. A text is judged whole however long; no documents
    give none. Columns may have any other names, and equal distances count as within the limit."""
    prepare(spark)
    return _without(docs, quality.assess(docs).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id. Rows of one
    doc_id that are near duplicates of each other stay together; a row without doc_id stays. Null, empty and wordless
    texts are near duplicates of nothing, and stay. A text's shingles are compared whole however long it is; no documents
    give none. Columns may have any other names."""
    prepare(spark)
    groups = jaccard.jaccard_components(docs, SHINGLE, SIMILAR)
    return _without(docs, groups.where("doc_id != component_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages of 50 words or more that have occurred before, by doc_id and place, are cut from text, and
    n_chars follows. Null and empty texts, and rows without doc_id, stay as they are; rows of one doc_id share their places,
    so that a row repeated is no repeat of its words. A text is read whole however long; no documents give none. Columns
    may have any other names."""
    prepare(spark)
    out = suffixes.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: those with no hit word, or less than one in twenty. Rows of one doc_id go
    together; a row without doc_id stays, and so do null and empty texts. A text is scanned whole however long; no documents,
    or no benchmark items, take nothing away. Columns may have any other names."""
    prepare(spark)
    scanned = decontamination.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, scanned.where(decontamination.contaminated()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences. Null and empty texts have the separator alone; each row has its
    pieces, repeated or without doc_id; a long text has as many as it takes. Equal pieces may change places. No documents
    give no rows. Only doc_id and text are read, whatever the other columns are called."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]

#: Tokenisation and divergence can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from documents. A stage's own tables go once its result is written, and that when the
    next one's is."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with passing(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir)))
        if held is not None:
            drop_written(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
