"""Entities, edges and what is linked through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.dealing import dealt
from tallyweave.functions.text import authority_rank, contains_any, identifier_core

# Words that mark an amendment, and the shape of references to instruments.
AMENDMENT_WORDS = ["amendment", "amend", "amended", "addendum", "variation order", "variation", "supplement", "supplementary", "successor", "side letter", "change order", "revised agreement", "novation", "ملحق", "تعديل", "معدل", "اتفاقية معدلة"]
SIGNED_REFERENCE = r"\b([A-Za-z]{2,6}[-\s/]?[0-9]{2,4}(?:[-\s/]?[0-9]{1,6})+)\b"


def merge_entities(mentions: DataFrame, optional: list[str] | None = None, lists: list[str] | None = None) -> DataFrame:
    """One entity for each id: identity from the first mention by seq, optional attributes from the first that has
    them, lists in order without repeats, flags joined by or, mentions counted."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("x"))))), lambda x: x["x"])
    return mentions.groupBy("entity_id").agg(
        F.min_by("value", "seq").alias("value"),
        *(first(c) for c in optional or ["amount_currency"]),
        *(F.array_join(F.array_distinct(in_order(c)), ",").alias(f"{c}s") for c in lists or ["doc_id"]),
        F.bool_or(F.coalesce("numeral_mismatch", F.lit(False))).alias("numeral_mismatch"),
        F.count("*").alias("mention_count"),
    )


def merge_edges(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """One edge for each two ends and type, with the document of its first mention by seq. Ends and documents may be numbers as well as texts, which take
    less room while edges are merged. partitions: how many the edges are dealt to."""
    return dealt(edges, partitions, "src", "dst").groupBy("src", "dst", "rel_type").agg(F.min_by("doc_id", "seq").alias("doc_id"), F.count("*").alias("mention_count"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges in both directions, each once; dealt by src, so that what is joined to it finds them where they are."""
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src != dst").repartition("src").distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, node, hops) within depth undirected steps, fewest hops each; the seed itself has 0."""
    edges = symmetric(edges)
    reached = seeds.select(F.col("node").alias("seed"), F.col("node"), F.lit(0).alias("hops")).distinct()
    frontier = reached
    for hop in range(1, depth + 1):
        stepped = frontier.join(edges, frontier.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = stepped.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def one_hop(edges: DataFrame, seeds: DataFrame, most: int = 50) -> DataFrame:
    """(seed, node, rel_type) of the edges (src, dst, rel_type) at these nodes, whichever end they are, the first most of each by node and type:
    what is left to say where k_hop() finds nothing."""
    both = edges.select(F.col("src").alias("seed"), F.col("dst").alias("node"), "rel_type").union(edges.select("dst", "src", "rel_type")).where("seed != node").distinct()
    rows = both.join(seeds.select(F.col("node").alias("seed")).distinct(), "seed", "left_semi")
    order = Window.partitionBy("seed").orderBy("node", "rel_type")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def anchors_of(amounts: DataFrame) -> DataFrame:
    """Each amount (entity_id, doc_id) with the anchors that it is linked to, in order; amounts without any have none."""
    return amounts.groupBy("audit_id", "doc_id", "entity_id").agg(F.array_sort(F.collect_set("anchor_id")).alias("anchors"))


def edge_counts(documents: DataFrame, edges: DataFrame, found_in: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, edge_count, cross_doc_edges): edges (src, dst) of a document's entities, and those whose other end another document has.

    Edges are counted by entity before documents are looked at, so that a mention stays one row: how many an entity has, and to how many entities that some document holds. Those
    of the latter that the document alone holds (lone) are taken off again. Documents may be numbers as well as texts. partitions: how many mentions are dealt to."""
    both = symmetric(edges)
    held = found_in.select(F.col("entity_id").alias("src"), "doc_id")
    where = held.groupBy(F.col("src").alias("dst")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    near = both.join(where, "dst", "left").select("src", "a", "z")
    per = dealt(near.groupBy("src").agg(F.count("*").alias("n"), F.count("a").alias("live")), partitions, "src")
    lone = near.where("a = z").groupBy("src", F.col("a").alias("doc_id")).agg(F.count("*").alias("lone"))
    rows = held.join(per, "src").unionByName(lone, allowMissingColumns=True)
    pairs = dealt(rows, partitions, "doc_id").groupBy("doc_id", "src").agg(*(F.max(c).alias(c) for c in ("n", "live", "lone"))).where("n is not null")
    ends = pairs.groupBy("doc_id").agg(F.sum("n").alias("edge_count"), F.sum(F.col("live") - F.coalesce("lone", F.lit(0))).alias("cross_doc_edges"))
    return documents.select("doc_id").join(ends, "doc_id", "left").fillna(0, ["edge_count", "cross_doc_edges"])


def without_orphans(found_in: DataFrame, deleted_docs: DataFrame) -> DataFrame:
    """(entity_id, docs) of entities that some document still holds once these are deleted."""
    return found_in.join(deleted_docs, "doc_id", "left_anti").groupBy("entity_id").agg(F.count("*").alias("docs"))


def linkage(documents: DataFrame, found_in: DataFrame) -> DataFrame:
    """Entities and entities shared with another document, for each document; isolated without any shared."""
    shared = found_in.groupBy("entity_id").agg(F.count_distinct("doc_id").alias("n")).where("n > 1").select("entity_id", F.lit(True).alias("shared"))
    per = found_in.join(shared, "entity_id", "left").groupBy("doc_id").agg(F.count_distinct("entity_id").alias("entity_count"), F.count_distinct(F.when(F.col("shared"), F.col("entity_id"))).alias("shared_count"))
    out = documents.select("doc_id").join(per, "doc_id", "left").fillna(0, ["entity_count", "shared_count"])
    return out.select("doc_id", "entity_count", "shared_count", (F.col("shared_count") == 0).alias("isolated"))


def coverage(documents: DataFrame, chunks: DataFrame, found_in: DataFrame) -> DataFrame:
    """The first of NO CHUNKS, NO ENTITIES, ISOLATED that holds for a document, else OK."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    out = linkage(documents, found_in).join(n, "doc_id", "left").fillna(0, ["chunk_count"])
    flag = F.when(F.col("chunk_count") == 0, "NO CHUNKS").when(F.col("entity_count") == 0, "NO ENTITIES").when(F.col("isolated"), "ISOLATED").otherwise("OK")
    return out.select("doc_id", "chunk_count", "entity_count", flag.alias("flag"))


def resolve_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose two ends are entities, by value or normalised value in lower case; the last entity of a
    spelling wins. Loops and unknown ends are dropped, repeated edges kept once."""
    keys = entities.select("entity_id", "seq", F.explode(F.array(F.lower(F.trim("value")), F.lower(F.trim("normalized_value")))).alias("key")).where("key is not null")
    keys = keys.groupBy("key").agg(F.max_by("entity_id", F.struct("seq", "entity_id")).alias("entity_id"))
    a = keys.select(F.col("key").alias("a"), F.col("entity_id").alias("src"))
    b = keys.select(F.col("key").alias("b"), F.col("entity_id").alias("dst"))
    out = relations.withColumn("a", F.lower(F.trim("source"))).withColumn("b", F.lower(F.trim("target"))).join(a, "a").join(b, "b")
    return out.where("src != dst").select("src", "dst", F.lower(F.trim("rel_type")).alias("rel_type")).distinct()


def signatory_mismatches(people: DataFrame) -> DataFrame:
    """Amendments signed below the level of who signed the base they refer to: one row for two names, the
    first by base and amendment. people: audit_id, name, authority, doc_id, signed (array of instruments)."""
    rows = people.select("audit_id", "name", "authority", "doc_id", authority_rank(F.col("authority")).alias("rank"), F.explode("signed").alias("instrument"))
    references = F.array_distinct(F.transform(F.regexp_extract_all("instrument", F.lit(SIGNED_REFERENCE), 1), identifier_core))
    rows = rows.withColumn("refs", references)
    amends = rows.where(contains_any(F.lower("instrument"), AMENDMENT_WORDS))
    keep = lambda df, k: df.select("audit_id", F.explode("refs").alias("ref"), *(F.col(c).alias(f"{c}{k}") for c in ("name", "authority", "doc_id", "rank", "instrument")))
    by_ref = keep(rows, 1).join(keep(amends, 2), ["audit_id", "ref"]).drop("ref")
    bare = rows.where((F.size("refs") == 0) & (F.length(F.trim("instrument")) >= 6))
    quoted = bare.select("audit_id", *(F.col(c).alias(f"{c}1") for c in ("name", "authority", "doc_id", "rank", "instrument"))).join(amends.select("audit_id", *(F.col(c).alias(f"{c}2") for c in ("name", "authority", "doc_id", "rank", "instrument"))), "audit_id").where("contains(lower(instrument2), lower(trim(instrument1)))")
    both = by_ref.unionByName(quoted).where("lower(name1) != lower(name2) and rank2 < rank1 and lower(trim(instrument1)) != lower(trim(instrument2))")
    pair = F.array_sort(F.array(F.lower("name1"), F.lower("name2")))
    order = Window.partitionBy("audit_id", pair).orderBy("name1", "name2", "instrument1", "instrument2", "doc_id1", "doc_id2")
    first = both.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    gap = F.col("rank1") - F.col("rank2")
    return first.select("audit_id", "name1", "authority1", "instrument1", "name2", "authority2", "instrument2", gap.alias("authority_gap"), F.when(gap >= 2, 0.7).otherwise(0.6).alias("confidence"))
