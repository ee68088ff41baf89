"""Search over chunks: by vector, by keyword, and both together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.folders import stored
from tallyweave.functions.text import id_tokens, query_entities, route
from tallyweave.operators.graph import k_hop


def tokens(text: Column) -> Column:
    """Words of 2 to 64 letters, marks and digits of any script in lower case, each once."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: F.length(t).between(2, 64)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double; null if either has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    as_double = lambda x: F.transform(x, lambda v: v.cast("double"))
    a, b = as_double(a), as_double(b)
    norm = F.sqrt(total(F.transform(a, lambda v: v * v))) * F.sqrt(total(F.transform(b, lambda v: v * v)))
    return F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), norm)


#: Numbers in a tile of vectors or queries.
TILE_NUMBERS = 262_144


def _tiles(rows: DataFrame, ident: str, vector: str, numbers: int) -> DataFrame:
    """(dim, tile, tiles, ids, flat): the vectors that have a length, by size, some hundreds or thousands to a row in the order of their ids, numbers one after the other."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    kept = rows.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null").where(F.coalesce(good, F.lit(False))).withColumn("dim", F.size("v"))
    counts = kept.groupBy("dim").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.floor(F.lit(numbers) / F.col("dim")))).cast("int").alias("tiles"))
    dealt = kept.join(F.broadcast(counts), "dim").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    held = dealt.groupBy("dim", "tile", "tiles").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("held"))
    return held.select("dim", "tile", "tiles", F.transform("held", lambda h: h["id"]).alias("ids"), F.flatten(F.transform("held", lambda h: h["v"])).alias("flat"))


def _nearest(k: int, query_kind: pa.DataType, vec_kind: pa.DataType):
    """Of rows of a tile of queries and a tile of vectors, the k nearest of each query: one product, one partition of the whole matrix."""

    def unit(flat: pa.Array, dim: int) -> np.ndarray:
        m = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
        m = m / np.abs(m).max(axis=1, keepdims=True)
        return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, asked, queries, ids, vectors = (batch.column(n) for n in ("dim", "query_ids", "queries", "ids", "flat"))
            for r in range(len(batch)):
                dim = dims[r].as_py()
                scores = unit(queries[r].values, dim) @ unit(vectors[r].values, dim).T
                n = min(k, scores.shape[1])
                least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
                q, v = np.nonzero(scores >= least[:, None])
                found = scores[q, v]
                order = np.lexsort((v, -found, q))  # ids of a tile are sorted: of equals the smaller one comes first
                q, v, found = q[order], v[order], found[order]
                first = np.searchsorted(q, q)
                kept = np.arange(len(q)) - first < n
                columns = [asked[r].values.take(pa.array(q[kept])).cast(query_kind), ids[r].values.take(pa.array(v[kept])).cast(vec_kind), pa.array(found[kept])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return run


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, numbers: int = TILE_NUMBERS) -> DataFrame:
    """For each of a stated set of queries (query_id, query) the k nearest (vec_id, embedding) by cosine, of equals the smaller vec_id.

    Queries and vectors are dealt to tiles of a bounded size; each tile of queries meets each tile of vectors in a row of its own, anywhere, which keeps its k best of each
    query, and only these are ranked. Nothing goes through the driver. Rows without id, and vectors that are null, have no length or hold nulls or NaN are near to
    nothing, and neither are those of two sizes."""
    query_kind, vec_kind = (pa.schema(to_arrow_schema(d.schema)).field(n).type for d, n in ((queries, "query_id"), (vectors, "vec_id")))
    asked = _tiles(queries, "query_id", "query", numbers).select("dim", F.col("tile").alias("q"), F.col("tiles").alias("qs"), F.col("ids").alias("query_ids"), F.col("flat").alias("queries"))
    own = _tiles(vectors, "vec_id", "embedding", numbers)
    # a side goes to as many rows as the other one has tiles of its size
    n_q, n_v = asked.select("dim", "qs").distinct(), own.select("dim", "tiles").distinct()
    left = asked.join(n_v, "dim").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles", "qs")
    right = own.drop("tiles").join(n_q, "dim").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).drop("qs")
    kinds = [d.schema[n].dataType.simpleString() for d, n in ((queries, "query_id"), (vectors, "vec_id"))]
    found = left.join(right, ["dim", "q", "tile"]).select("dim", "query_ids", "queries", "ids", "flat").mapInArrow(_nearest(k, query_kind, vec_kind), f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def filtered(rows: DataFrame, doc_ids: DataFrame | None = None, language: str | None = None) -> DataFrame:
    """Rows of any of these documents (doc_id), and of this language."""
    out = rows if doc_ids is None else rows.join(doc_ids.select("doc_id"), "doc_id", "left_semi")
    return out if language is None else out.where(F.col("language") == language)


def keyword_matches(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """The first k chunks (doc_id, text) by id that have every token of the query."""
    asked = tokens(F.lit(query))
    return chunks.where(F.size(F.array_except(asked, tokens(F.col("text")))) == 0).where(F.size(asked) > 0).orderBy("doc_id").limit(k)


def adaptive_k(pages: Column, base: int, most: int) -> Column:
    return F.when(pages <= 5, base).when(pages <= 15, F.least(F.lit(base + 15), F.lit(most))).otherwise(most)


def distinct_hits(hits: DataFrame, k: int) -> DataFrame:
    """The first k different hits of an audit, in order of query and rank: equal if document, page and the first 120
    characters of text are."""
    key = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("page").cast("string"), F.substring("text", 1, 120)))
    first = hits.withColumn("hit", key).groupBy("audit_id", "hit").agg(F.min(F.struct("query_order", "rank", "doc_id")).alias("first"))
    order = Window.partitionBy("audit_id").orderBy("first")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("audit_id", "hit", "first.doc_id", "position")


def merge_hits(keyword: DataFrame, vector: DataFrame, graph: DataFrame) -> DataFrame:
    """Keyword hits, then vector, then graph; the first of those with the same 100 first characters.
    Each has doc_id, text, score."""
    parts = [d.select("doc_id", "text", F.col("score").cast("double").alias("score"), F.lit(i).alias("priority"), F.lit(n).alias("source")) for i, (n, d) in enumerate((("keyword", keyword), ("vector", vector), ("graph", graph)))]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = Window.partitionBy(F.substring("text", 1, 100)).orderBy("priority", F.desc("score"), "doc_id")
    return everything.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("source", "doc_id", F.round("score", 4).alias("score"), "priority", "text")


def named_hits(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(question_id, doc_id, text) of the first k chunks, by id, that have all words of an identifier that the question (question_id, named) names.

    An identifier's rarest word finds its candidates, so that a word of many chunks brings rows only where all words of an identifier are as common; the others are
    looked for in the row."""
    asked = questions.select("question_id", F.posexplode("named").alias("token_no", "token")).withColumn("need", tokens(F.col("token")))
    words = asked.select("question_id", "token_no", "need", F.explode("need").alias("word"))
    held = chunks.select("doc_id", F.explode(tokens(F.col("text"))).alias("word")).join(words.select("word").distinct(), "word", "left_semi").distinct()
    counted = words.join(held.groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    rarest = counted.groupBy("question_id", "token_no").agg(F.min("need").alias("need"), F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    found = rarest.join(held, "word").select("question_id", "token_no", "need", "doc_id").join(chunks.select("doc_id", "text"), "doc_id")
    found = found.where(F.size(F.array_except("need", tokens(F.col("text")))) == 0)
    order = Window.partitionBy("question_id", "token_no").orderBy("doc_id", "text")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("question_id", "doc_id", "text")


def linked_hits(questions: DataFrame, chunks: DataFrame, edges: DataFrame, entities: DataFrame, depth: int = 2) -> DataFrame:
    """(question_id, doc_id, text): chunks of the documents of entities (entity_id, doc_id, value) that edges (src, dst) link, over depth steps, with those that the
    question (question_id, about) names. Case and outer blanks of names don't count."""
    name = lambda c: F.lower(F.trim(c))
    asked = questions.select("question_id", F.explode("about").alias("name")).select("question_id", name(F.col("name")).alias("name"))
    seeds = stored(asked.join(entities.select(name(F.col("value")).alias("name"), F.col("entity_id").alias("seed")), "name").select("question_id", "seed").distinct(), "seeds")
    reached = k_hop(edges, seeds.select(F.col("seed").alias("node")), depth)
    docs = seeds.join(reached, "seed").select("question_id", F.col("node").alias("entity_id")).distinct().join(entities.select("entity_id", "doc_id"), "entity_id")
    return docs.select("question_id", "doc_id").distinct().join(chunks.select("doc_id", "text"), "doc_id").select("question_id", "doc_id", "text")


def search_many(questions: DataFrame, chunks: DataFrame, k: int = 10, vectors: DataFrame | None = None, edges: DataFrame | None = None, entities: DataFrame | None = None, about: Callable[[Column], Column] = query_entities) -> DataFrame:
    """All questions (question_id, question, and query where vectors are given) in one plan: (question_id, route, source, doc_id, score, text, kept).

    Each has max(3, k // 2) chunks (doc_id, text) for each identifier that it names; the k nearest (vec_id, a doc_id, and embedding); and, where it asks for relations and
    the graph is given, the chunks of linked documents. kept: the first, in that order, of those with the same 100 first characters. route is the question's own; see
    search_summaries(). A question without text, or without hits, has no rows; neither have chunks without text. Questions of one id are one question."""
    words = F.col("question")
    asked = questions.where("question_id is not null").dropDuplicates(["question_id"]).withColumns({"route": route(words), "named": id_tokens(words), "about": about(words)})
    asked = stored(asked, "questions")  # five steps read it
    chunks = chunks.where("doc_id is not null and text is not null")
    found = {"keyword": named_hits(asked, chunks, max(3, k // 2)).withColumn("score", F.lit(1.0))}
    if vectors is not None:
        own = vectors.join(chunks.select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
        near = vector_top_k(asked.where("trim(question) != ''").select(F.col("question_id").alias("query_id"), "query"), own, k)
        found["vector"] = near.select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("doc_id"), F.round("score", 4).alias("score")).join(chunks.select("doc_id", "text"), "doc_id")
    if edges is not None and entities is not None:
        found["graph"] = linked_hits(asked.where("route = 'graph'"), chunks, edges, entities).withColumn("score", F.lit(0.0))
    parts = [rows.select("question_id", F.lit(i).alias("priority"), F.lit(source).alias("source"), "doc_id", "score", "text") for i, (source, rows) in enumerate(found.items())]
    order = Window.partitionBy("question_id", F.substring("text", 1, 100)).orderBy("priority", F.desc("score"), "doc_id")
    every = reduce(DataFrame.unionByName, parts).withColumn("kept", F.row_number().over(order) == 1)
    return asked.select("question_id", "route").join(every, "question_id").select("question_id", "route", "source", "doc_id", "score", "text", "kept")


def search_summaries(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Each question's hits by source, before equal ones go, and those that are kept; the route that was taken, which is the graph's only if it has found something;
    and the identifiers that it names. Of search_many()'s rows."""
    own = questions.where("question_id is not null").dropDuplicates(["question_id"]).select("question_id", route(F.col("question")).alias("asked"), id_tokens(F.col("question")).alias("id_tokens"))
    n = {s: F.count_if(F.col("source") == s).alias(f"{s}_count") for s in ("keyword", "vector", "graph")}
    out = own.join(found.groupBy("question_id").agg(*n.values(), F.count_if("kept").alias("total")), "question_id", "left").fillna(0)
    taken = F.when((F.col("asked") == "graph") & (F.col("graph_count") > 0), "graph").otherwise("vector")
    return out.select("question_id", taken.alias("route"), *(f"{s}_count" for s in n), "total", "id_tokens")


def search_summary(merged: DataFrame, route: Column) -> DataFrame:
    """Hits of each source, all of them, and the route that was taken: the graph's only if it has found something."""
    n = {s: F.count_if(F.col("source") == s) for s in ("keyword", "vector", "graph")}
    taken = F.when((route == "graph") & (n["graph"] > 0), "graph").otherwise("vector")
    return merged.agg(*(c.alias(f"{s}_count") for s, c in n.items()), F.count("*").alias("total"), taken.alias("route"))


def upsert(chunks: DataFrame) -> DataFrame:
    """The latest version of each chunk, by (doc_id, chunk_index)."""
    return chunks.groupBy("doc_id", "chunk_index").agg(F.max_by("text", "version").alias("text"), F.max("version").alias("version"))


def counts(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of each asked document, 0 without any."""
    return ids.join(chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "left").fillna(0, ["chunks"])
