"""Event logs, sessions, triage and planning, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Checks by the document types they need, in order.
CHECKS = [
    (["contract", "invoice"], "Verify invoice amounts match contracted payment terms", "amount_match", "high"),
    (["contract", "invoice"], "Confirm party names (client, vendor) are consistent across invoice and contract", "party_match", "high"),
    (["contract", "invoice"], "Check invoice date falls within contract validity period", "date_consistency", "high"),
    (["contract", "invoice"], "Verify VAT/tax amounts are correctly calculated per contract terms", "amount_match", "medium"),
    (["contract", "invoice"], "Verify contract payment schedule milestones (including monthly retainers and final deliverables) are fully invoiced; flag missing months or milestones", "cross_doc_consistency", "high"),
    (["contract", "invoice"], "Reconcile invoice subtotal against explicitly listed line items/components and flag unexplained subtotal gaps", "amount_match", "high"),
    (["bank_statement"], "Cross-reference invoice/payment amounts with bank statement transactions", "cross_doc_consistency", "high"),
    (["bank_statement"], "Verify payment dates in bank statement match invoice due dates", "date_consistency", "medium"),
    (["bank_statement", "contract"], "Reconcile total bank payments against contract total value; flag material overpayment or underpayment beyond tolerance", "amount_match", "high"),
    (["bank_statement", "contract"], "Reconcile contract milestone payment schedule against actual bank payments (strict per-installment and cumulative running totals)", "cross_doc_consistency", "high"),
    (["bank_statement", "invoice"], "Reconcile sum of bank payments against invoice total; flag paid-status inconsistency beyond tolerance", "amount_match", "high"),
    (["bank_statement", "contract", "invoice"], "Verify invoice covers all contract periods that have bank payment activity; flag any months or milestones with bank payments but no corresponding invoice line", "cross_doc_consistency", "high"),
    (["balance_sheet"], "Verify total assets equal total liabilities plus equity", "amount_match", "high"),
    (["balance_sheet"], "Check for unusual or unexplained large entries", "other", "medium"),
    (["audit_report"], "Verify figures cited in audit report match source documents", "cross_doc_consistency", "high"),
    (["audit_report"], "Check that all required audit report clauses are present", "clause_completeness", "medium"),
    ([], "Detect any cross-document amount contradictions using knowledge graph", "cross_doc_consistency", "high"),
    ([], "Check for duplicate invoice or contract IDs", "other", "medium"),
    ([], "Verify all dates are logically consistent (no future-dated payments, etc.)", "date_consistency", "medium"),
]
SELF_REFERENCE = ("Cross-document self-reference validation: compare every value a document claims about another document (e.g. an invoice stating the contract value) against that referenced document's actual stated value", "self_reference", "high")


def checks(spark: SparkSession) -> DataFrame:
    rows = [(0, [], *SELF_REFERENCE, 2)] + [(i + 1, need, d, t, p, 1) for i, (need, d, t, p) in enumerate(CHECKS)]
    return spark.createDataFrame(rows, "check_no int, needs array<string>, description string, check_type string, priority string, least_docs int")


def checklist(documents: DataFrame, spark: SparkSession) -> DataFrame:
    """The checks of each audit: those whose document types it has; self-reference first if it has two documents."""
    held = documents.groupBy("audit_id").agg(F.collect_set("doc_type").alias("types"), F.count("*").alias("docs"))
    rules = F.broadcast(checks(spark))
    return held.join(rules, (F.size(F.array_except("needs", "types")) == 0) & (F.col("docs") >= F.col("least_docs"))).select("audit_id", "check_no", "check_type", "priority")


def latest(rows: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """The last written value of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    ranked = rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where(F.col("back") <= n)


def stale(heartbeats: DataFrame, now=None, seconds: int = 120) -> DataFrame:
    """Keys whose last beat is more than some seconds before now, which is the last beat of all where it is not given."""
    now = F.lit(heartbeats.agg(F.max("ts")).first()[0]) if now is None else now
    return heartbeats.groupBy("key").agg(F.max("ts").alias("last_beat")).where(F.col("last_beat") < now - F.expr(f"INTERVAL {seconds} SECONDS"))


def agent_status(events: DataFrame) -> DataFrame:
    """For each event the furthest agent that has been active so far: earlier ones are done."""
    so_far = Window.partitionBy("audit_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("furthest", F.max("agent").over(so_far)).withColumn("repeated", F.col("furthest") > F.col("agent"))


def replay(events: DataFrame, start: int) -> DataFrame:
    return events.where(F.col("seq") >= start)


def union_new(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """prior, and what is fresh by its description in lower case."""
    key = F.lower(F.trim("description"))
    return prior.unionByName(fresh.withColumn("_k", key).join(prior.select("audit_id", key.alias("_k")).distinct(), ["audit_id", "_k"], "left_anti").drop("_k"))
