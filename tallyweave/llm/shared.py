"""Tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.folders import new_folder, shared_folder  # noqa: F401  the folder is named in one place
from tallyweave.shipping import ship


#: Rows in an Arrow batch at most; with long documents the default would hold tens of MB on both sides.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Takes the package to the workers, and limits the session's Arrow batches to BATCH_ROWS rows."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many _ after it as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Tables of this process that have not been deleted, in the order of writing.
_tables: list[str] = []
#: Those of the innermost passing() that this thread is in.
_block: ContextVar[list[str] | None] = ContextVar("tables of a block", default=None)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, without lineage, safe from lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    _tables.append(path)
    if (block := _block.get()) is not None:
        block.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by written()."""
    if df.written_to in _tables:
        _delete(df.sparkSession, df.written_to)
        _tables.remove(df.written_to)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread writes inside are deleted at the end, but for those given to the function that this yields: the ones that a
    returned frame still reads. After an exception all of them go. Tables of other threads are left alone; kept ones count as written by the block around."""
    own, kept, outer = [], set(), _block.get()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_to)
        return df

    token = _block.set(own)
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _block.reset(token)
        for path in [p for p in own if p in _tables]:
            if path not in kept:
                _delete(spark, path)
                _tables.remove(path)
            elif outer is not None:
                outer.append(path)


def drop_tables(spark: SparkSession) -> None:
    """Deletes all tables written so far: for a caller who has taken what the operators returned."""
    while _tables:
        _delete(spark, _tables.pop())


#: Edges of one local contraction, and of a graph that one task takes whole.
FOREST_EDGES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For runs of edges, edges from each node to the least that it reaches within the run."""
    parent: dict[int, int] = {}
    held = 0

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        held += len(batch)
        if held > FOREST_EDGES:
            yield stars()
            held = 0
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b), both long.

    Returns (node, component): every node of an edge with a != b, and the smallest
    node that it can reach. A graph of at most FOREST_EDGES edges is contracted in one
    task, whose memory they bound (about 50 MB); the rows are the same either way. Of a larger one, runs of edges are contracted first; then large-star and
    small-star steps alternate. Each is an aggregation with map-side combine and a join of
    two written tables, which AQE may split, so a node with very many edges is no bottleneck.
    Nulls are ignored.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(_forest, "a long, b long")
    edges = written(edges.distinct())
    if edges.count() <= FOREST_EDGES:
        return _nodes(written(edges.coalesce(1).mapInArrow(_forest, "a long, b long")))

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()

    before = state(edges)
    for _ in itertools.count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        star = written(both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        nearest = written(star.groupBy("a").agg(F.min("b").alias("m")))
        small = star.join(nearest, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = written(nearest.select("a", F.col("m").alias("b")).union(small).where("a != b").distinct())
        for table in (edges, least, star, nearest):
            drop_written(table)
        edges, now = after, state(after)
        if now == before:
            return _nodes(edges)
        before = now


def _nodes(stars: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b) from each node to the least of its component."""
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
