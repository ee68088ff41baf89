"""A full-text index of chunks: a table of tokens with the chunks that have them, and searches that open a few of its files.

The index has one row for each token and shard, with the sorted positions of chunks in that shard. It is dealt to folders by token, so that a search
reads the folders of its tokens alone, and by shard, so that a token that is in very many chunks is never one row. Tokens are intersected with the rarest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.retrieval import tokens

#: Folders that tokens are dealt to, and chunks of a shard.
BUCKETS, SHARD = 64, 100_000


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def build(chunks: DataFrame, path: str, key: str = "doc_id", shard: int = SHARD) -> None:
    """Writes the index of chunks (key: long, text): rows (bucket, token, shard, n, keys). Chunks without key are left out, those without tokens have no rows; a
    key that comes twice has the tokens of both texts."""
    rows = chunks.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.explode(tokens(F.col("text"))).alias("token"))
    held = rows.groupBy("token", F.floor(F.col("k") / shard).alias("shard")).agg(F.array_sort(F.collect_set("k")).alias("keys"))
    out = held.select(_bucket(F.col("token")).alias("bucket"), "token", "shard", F.size("keys").alias("n"), "keys")
    out.repartition("bucket").sortWithinPartitions("bucket", "token", "shard").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """The index's rows of some tokens: of their folders alone, and there of the row groups that may hold them."""
    folders = spark.createDataFrame([(t,) for t in asked], "t string").select(_bucket(F.col("t")).alias("b")).distinct().collect()
    return spark.read.parquet(path).where(F.col("bucket").isin([r.b for r in folders])).where(F.col("token").isin(asked))


def search(spark: SparkSession, path: str, query: str, most: int | None = None) -> DataFrame:
    """(key): the chunks that have every token of a query, by key, `most` of them at most; none for a query without tokens.

    Within each shard the shortest list goes first and each longer one is intersected with what is left; a shard that lacks a token isn't joined at all."""
    asked = spark.range(1).select(tokens(F.lit(query))).first()[0]
    found = read(spark, path, asked) if asked else spark.createDataFrame([], "token string, shard long, n int, keys array<long>")
    lists = found.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("n", "keys"))).alias("lists")).where(F.size("lists") == len(asked))
    both = F.aggregate(F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0))), F.get("lists", F.lit(0))["keys"], lambda left, x: F.array_intersect(left, x["keys"]))
    keys = lists.select(F.explode(both).alias("key"))
    return keys.orderBy("key").limit(most) if most is not None else keys


def search_many(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key) for queries (query_id, query): each with the chunks that have all of its tokens, by joins with the whole index (token, shard, n, keys).

    The rarest token of a query in a shard says which chunks may be hits, and each of these is looked up in the query's other lists."""
    asked = queries.select("query_id", tokens(F.col("query")).alias("t")).where(F.size("t") > 0).dropDuplicates(["query_id"])
    each = asked.select("query_id", F.size("t").alias("all"), F.explode("t").alias("token")).join(index, "token")
    lists = each.groupBy("query_id", "shard", "all").agg(F.array_sort(F.collect_list(F.struct("n", "keys"))).alias("lists")).where(F.size("lists") == F.col("all"))
    both = F.aggregate(F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0))), F.get("lists", F.lit(0))["keys"], lambda left, x: F.array_intersect(left, x["keys"]))
    return lists.select("query_id", F.explode(both).alias("key"))
