"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.encoding import default_path, encoder
from tallyweave.llm.shared import written

#: Lengths in one block of the two-level suffix sums.
BLOCK = 1024


def length_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length. Null and empty texts have
    length 0; each row of docs counts, repeated or not. Only text is read."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[int] = Counter()
        ids = encoder(path).ids
        for batch in batches:
            sums.update(len(ids(t.as_py())) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length L of the histogram, as a context limit:

    n_docs of that length; docs_from, tokens_from: documents of L tokens or more, and
    their tokens; docs_total, tokens_total: of all documents; truncated_total:
    tokens left when every document is cut to L; share_within: documents of at most L.
    The sums go over blocks of lengths first, so that no task sees the whole histogram.
    An empty histogram gives no rows.
    """
    counts = written(counts).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(everything).alias("docs_total"),
        F.sum("t").over(everything).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = counts.withColumns({"d_in": F.sum("n_docs").over(inside), "t_in": F.sum(tokens).over(inside)}).join(blocks, "block")
    out = out.withColumns({"docs_from": F.col("d_in") + F.col("d_above"), "tokens_from": F.col("t_in") + F.col("t_above")})
    over = F.col("docs_from") - F.col("n_docs")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        (1 - over / F.col("docs_total")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, truncated_total) for any limits, also between the histogram's lengths."""
    asked = sums.sparkSession.createDataFrame([(x,) for x in sorted(set(limits))], "context long")
    pairs = sums.join(F.broadcast(asked), F.col("n_tokens") > F.col("context"), "inner")
    over = pairs.groupBy("context").agg(F.sum("n_docs").alias("docs_over"), F.sum(F.col("n_docs") * (F.col("n_tokens") - F.col("context"))).alias("lost"))
    total = sums.agg(F.max("tokens_total").alias("tokens_total"))
    return asked.join(over, "context", "left").crossJoin(F.broadcast(total)).select("context", F.coalesce("docs_over", F.lit(0)).alias("docs_over"), (F.col("tokens_total") - F.coalesce("lost", F.lit(0))).alias("truncated_total"))


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents do not exceed."""
    return sums.where(F.col("share_within") >= share - 1e-12).agg(F.min("n_tokens")).first()[0]
