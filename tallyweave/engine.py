"""The facade: audits, search, triage and archive as plans over the canonical relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.hooks import Hooks
from tallyweave.operators import adjudication, control, findings, graph, grounding, pairs, retrieval, snapshot, state
from tallyweave.shipping import ship


@dataclass
class Engine:
    spark: SparkSession
    hooks: Hooks = field(default_factory=Hooks)

    def __post_init__(self) -> None:
        ship(self.spark)

    def snapshot(self, amounts: DataFrame, anchors: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
        return snapshot.snapshot(amounts, anchors, refs)

    def cross_check(self, phases: dict[str, DataFrame]) -> DataFrame:
        """The findings of the phases in their order, as report() takes them."""
        return control.in_phases(phases)

    def contradictions(self, amounts: DataFrame) -> DataFrame:
        """Anchored and anchorless pairs, assessed and deduplicated, of audits with two documents or more."""
        roles = pairs.role_pairs(self.spark)
        found = pairs.anchored(amounts, roles).unionByName(pairs.anchorless(amounts, roles).withColumn("anchor_id", F.lit(None).cast("string")))
        many = amounts.groupBy("audit_id").agg(F.count_distinct("doc_id").alias("n")).where("n > 1").select("audit_id")
        return self.hooks.assess(pairs.dedupe(pairs.most_material(found.join(many, "audit_id", "left_semi"))))

    def references(self, amounts: DataFrame) -> DataFrame:
        return pairs.reference_mismatches(amounts, self.spark)

    def report(self, found: DataFrame, triage: DataFrame | None = None) -> DataFrame:
        """Findings that pass the gate, are not suppressed and tell different stories, with the risk of each audit."""
        kept = found.where(findings.verdict(F.col("severity"), F.col("confidence"), F.col("evidence"), F.col("source")) == "")
        kept = kept.where(~findings.cites_unknown_id(F.concat_ws(" ", "title", "description"), F.col("evidence")))
        if triage is not None:
            kept = findings.without_suppressed(kept.withColumn("signature", findings.signature(F.col("title"), F.col("description"))), triage)
        return self.hooks.summarise(findings.risk(findings.dedupe(kept)))

    def checklist(self, documents: DataFrame) -> DataFrame:
        return state.checklist(documents, self.spark)

    def adjudicate(self, checks: DataFrame, documents: DataFrame, hits: DataFrame, most: int | None = adjudication.ASKED, partitions: int | None = None) -> DataFrame:
        """The findings of an audit's checks (audit_id, check_no, check_type) out of what was found for each (audit_id, check_no, doc_id, position, page, text). most: how many
        snippets of a check are handed on, unless told as many as a model is asked about at once; None hands on all, which rules can do with. partitions: how many the hits are dealt to."""
        asked = control.dispatch(checks, documents).where("action = 'adjudicate'")
        return self.hooks.adjudicate(asked, adjudication.snippets_of(hits, documents, most, partitions))

    def replan(self, prior: DataFrame, fresh: DataFrame, found: DataFrame, documents: DataFrame, least_checks: int = 4, passes: int = 1) -> DataFrame:
        """One more pass of planning for audits with two documents, no finding and few checks, after fewer than two passes."""
        if passes >= control.MAX_PASSES:
            return prior
        few = prior.groupBy("audit_id").agg(F.count("*").alias("n")).where(F.col("n") < least_checks).select("audit_id")
        many = documents.groupBy("audit_id").agg(F.count("*").alias("n")).where("n > 1").select("audit_id")
        again = few.join(many, "audit_id", "left_semi").join(found.select("audit_id").distinct(), "audit_id", "left_anti")
        return state.union_new(prior, fresh.join(again, "audit_id", "left_semi"))

    def search(self, chunks: DataFrame, query: str, k: int = 20, doc_ids: DataFrame | None = None, language: str | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, edges: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
        """Keyword hits for each identifier in the query, or for all its words; the k nearest by vector where vectors (doc_id as vec_id,
        embedding) and the query's are given; and, where the query asks for relations and the graph is given, the documents of
        entities (entity_id, doc_id, value) next to those that it names. Merged in that order, in chunks of these documents and this language."""
        chunks = retrieval.filtered(chunks, doc_ids, language)
        tokens, by_graph, about = self.spark.sql("SELECT 1").select(text.id_tokens(F.lit(query)), text.route(F.lit(query)) == "graph", self.hooks.about(F.lit(query))).first() if query else ([], False, [])
        each = [retrieval.keyword_matches(chunks, t, max(3, k // 2)).select("doc_id", "text", F.lit(1.0).alias("score")) for t in tokens or [query]]
        found = each[0]
        for more in each[1:]:
            found = found.unionByName(more)
        none = found.limit(0)
        near = none
        if vectors is not None and query_vector is not None:
            asked = self.spark.createDataFrame([(0, query_vector)], "query_id long, query array<double>")
            own = vectors.join(chunks.select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
            near = retrieval.vector_top_k(asked, own, k).select(F.col("vec_id").alias("doc_id"), "score").join(chunks.select("doc_id", "text"), "doc_id").select("doc_id", "text", "score")
        linked = none
        if by_graph and about and edges is not None and entities is not None:
            seeds = entities.where(F.lower(F.trim("value")).isin([a.strip().lower() for a in about])).select(F.col("entity_id").alias("node"))
            reached = graph.k_hop(edges, seeds).select(F.col("node").alias("entity_id")).distinct()
            docs = entities.join(reached, "entity_id", "left_semi").select("doc_id").distinct()
            linked = chunks.join(docs, "doc_id", "left_semi").select("doc_id", "text", F.lit(0.0).alias("score"))
        merged = retrieval.merge_hits(found, near, linked)
        return merged.orderBy("priority", F.desc("score"), "doc_id").limit(k).drop("priority")

    def search_many(self, questions: DataFrame, chunks: DataFrame, k: int = 10, vectors: DataFrame | None = None, edges: DataFrame | None = None, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The hits that are kept of any number of questions, and what each question has found; see retrieval.search_many()."""
        found = retrieval.search_many(questions, chunks, k, vectors, edges, entities, self.hooks.about)
        return found.where("kept").drop("kept"), retrieval.search_summaries(questions, found)

    def payload(self, documents: DataFrame, amounts: DataFrame, found: DataFrame, anchors: DataFrame | None = None, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The snapshot with its gaps filled from findings, and conflict rows: of findings first, then of the graph."""
        snap = grounding.fill_gaps(snapshot.snapshot(amounts, anchors, refs), grounding.label_amounts(found))
        of_findings = grounding.finding_conflicts(found, documents, amounts).select("audit_id", F.col("conflict_type").alias("entity_label"), "doc_a_id", "doc_a_value", "doc_b_id", "doc_b_value", F.lit("critical").alias("severity"), F.col("finding_id").cast("string").alias("position"))
        of_graph = pairs.conflict_rows(pairs.anchored(amounts, pairs.role_pairs(self.spark)))
        of_graph = of_graph.withColumn("position", F.concat_ws("|", "entity_label", "doc_a_id", "doc_b_id"))
        return snap, grounding.merged_conflicts(of_findings, of_graph)

    def sources(self, merged: DataFrame, most: int = 12, chars: int = 700) -> DataFrame:
        """What an answer is grounded on: the first hits with text, cut."""
        return merged.where("trim(text) != ''").select("doc_id", "source", F.substring(F.trim("text"), 1, chars).alias("text")).limit(most)
