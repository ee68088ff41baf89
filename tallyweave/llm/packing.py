"""Packing by best-fit decreasing over a segment tree of remaining capacities.

Documents are cut into full windows and a rest. Lengths are whole numbers up to the
window size, so best-fit decreasing depends on the histogram of lengths alone:
pieces of one length are placed together, in runs of windows that look alike. A
segment tree indexed by remaining capacity finds the tightest open run. The plan
has a few thousand entries however many pieces there are; each piece finds its place by
its rank among the pieces of its length, counted in buckets and without collecting.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.encoding import default_path, encoder
from tallyweave.llm.shared import written

SIZE = 1024
SEPARATOR = 0
#: Pieces of one length ranked together, about, and buckets of one length whose counts are summed together.
BUCKET_PIECES, BLOCK_BUCKETS = 250, 4096


class SegmentTree:
    """Numbers of open windows by remaining capacity 0..size."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open window that is at least this."""
        at = least + self.leaves
        if self.sums[at]:
            return least
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


class Place(NamedTuple):
    """Pieces of this length with ranks first <= r < last: the piece is in sequence
    sequence + (r - first) // each, at offset + (r - first) % each * length."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], size: int = SIZE) -> list[Place]:
    """Places for all pieces of a histogram length -> pieces, longest first, each in the
    tightest open window that holds it. Of windows alike, the one opened first is taken."""
    tree, runs = SegmentTree(size), defaultdict(list)
    places: list[Place] = []
    opened = 0

    def put_back(capacity: int, sequence: int, n: int) -> None:
        if n and capacity:
            runs[capacity].append((sequence, n))
            tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, sequence, n = size, opened, -(-(count - rank) // (size // length))
                opened += n
            else:
                runs[capacity].sort(reverse=True)
                sequence, n = runs[capacity].pop()
                tree.add(capacity, -n)
            each = capacity // length
            taken = min(count - rank, n * each)
            full, rest = divmod(taken, each)
            places.append(Place(length, rank, rank + taken, sequence, each, size - capacity))
            put_back(capacity - each * length, sequence, full)
            put_back(capacity - rest * length, sequence + full, int(rest > 0))
            used = full + (rest > 0)
            put_back(capacity, sequence + used, n - used)
            rank += taken
    return places


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Full windows and the rest of every document: doc_id, start, length, ids_crc32, doc_tokens, and deal, an odd number
    that deals them to buckets (another one each time it is computed).

    A document's ids are its text's, then the separator; null and empty texts have the
    separator alone. Repeated rows give repeated pieces. A text is encoded whole however long. Only doc_id and text are read."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        dealer = np.random.default_rng()
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                ids = np.array([*ids_of(text.as_py()), SEPARATOR], "<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    row.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            deal = dealer.integers(0, 1 << 62, len(row))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, deal))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, deal long")


def _ranked(cut: DataFrame, histogram: dict[int, int], size: int, bucket_pieces: int) -> DataFrame:
    """The pieces with their rank among those of their length. A length has as many buckets as its pieces ask for; a
    bucket's first rank is the sum of those before it, by blocks of buckets, so that no task sees all of them."""
    n_buckets = F.array(*(F.lit(max(1, -(-histogram.get(n, 0) // bucket_pieces))) for n in range(size + 1)))
    cut = cut.withColumn("bucket", F.col("deal") % n_buckets[F.col("length").cast("int")])
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / BLOCK_BUCKETS))
    earlier = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy("length", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", earlier("block").alias("before"))
    counts = counts.withColumn("inside", earlier("block", "bucket")).join(blocks, ["length", "block"]).select("length", "bucket", (F.col("inside") + F.col("before")).alias("ranked"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return cut.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("ranked"))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """pieces() with their sequence_id and offset: sequences of at most size tokens, gapless from 0.
    Which of several pieces of one length takes which place is open. No documents give no rows. Other columns than doc_id and
    text are not read."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, size))
    histogram = dict(cut.groupBy("length").agg(F.count("*")).collect())
    ranked = _ranked(cut, histogram, size, bucket_pieces)
    plan = spark.createDataFrame(best_fit_decreasing(histogram, size), "length long, first long, last long, sequence long, each long, at long")
    plan = plan.withColumnRenamed("length", "planned")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("planned")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    within = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(within / F.col("each"))).alias("sequence_id"), (F.col("at") + within % F.col("each") * F.col("length")).alias("offset")
    )
