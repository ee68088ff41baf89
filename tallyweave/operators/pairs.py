"""Amounts of different documents against each other: contradictions and restatements.

Which roles may be compared is a dimension table; comparison is an equi-join on audit and
shared anchor; the order of the two ids and the pair of roles are residual conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Roles that may be compared, and why.
COMPARABLE = [
    ("total_contract_value", "total_invoice", "contract total vs invoice total"),
    ("total_contract_value", "invoice_referenced_contract_value", "contract total vs invoice's stated contract reference"),
    ("total_contract_value", "total_contract_value", "contract total vs contract total across documents"),
    ("total_invoice", "total_invoice", "invoice total vs invoice total across documents"),
    ("invoice_referenced_contract_value", "invoice_referenced_contract_value", "invoice's stated contract reference vs another invoice's"),
    ("total_invoice", "invoice_subtotal", "invoice total vs invoice subtotal (VAT reconciliation)"),
    ("milestone_scheduled", "milestone_scheduled", "scheduled milestone vs scheduled milestone"),
    ("retainer", "retainer", "retainer rate vs retainer rate"),
    ("milestone_scheduled", "transaction_debit", "scheduled milestone vs bank payment"),
    ("retainer", "transaction_debit", "retainer rate vs bank payment"),
    ("transaction_debit", "transaction_debit", "bank payment vs bank payment"),
]
#: Roles that may be compared with any.
COMPARED = sorted({r for a, b, _ in COMPARABLE for r in (a, b)})
#: Roles that may be compared without a shared anchor.
ANCHORLESS = ("retainer",)
# Claim role, the role and document type that hold the truth, label.
CLAIMS = [("invoice_referenced_contract_value", "total_contract_value", "contract", "contract value")]
#: Pairs reported for an audit at most, most material first.
TOP_PAIRS = 50


def _reasons() -> dict[tuple[str, str], str]:
    return {(a, b): r for a, b, r in COMPARABLE} | {(b, a): r for a, b, r in COMPARABLE}


def role_pairs(spark: SparkSession) -> DataFrame:
    """(role1, role2, reason) in both orders."""
    return spark.createDataFrame([(a, b, r) for (a, b), r in sorted(_reasons().items())], "role1 string, role2 string, reason string")


def reason_of(role1: Column, role2: Column) -> Column:
    """The reason of role_pairs(), looked up in the row; null for roles that may not be compared."""
    reasons, names = _reasons(), [None, *COMPARED]
    at = lambda role: F.array_position(F.array(*map(F.lit, COMPARED)), role)
    return F.get(F.array(*(F.lit(reasons.get((a, b))).cast("string") for a in names for b in names)), at(role1) * len(names) + at(role2))


def materially_different(a: Column, b: Column, text_a: Column | None = None, text_b: Column | None = None) -> Column:
    """More than a hundredth and a ten-thousandth apart; if either is not parsed, whether their normalised texts differ."""
    apart = _apart(a, b)
    if text_a is None or text_b is None:
        return apart
    return F.when(a.isNotNull() & b.isNotNull(), apart).otherwise(F.coalesce(F.lower(F.trim(text_a)) != F.lower(F.trim(text_b)), F.lit(False)))


def _apart(a: Column, b: Column) -> Column:
    return F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * F.lit("0.0001").cast("decimal(5,4)") + F.lit("0.01").cast("decimal(3,2)")


def same_currency(a: Column, b: Column) -> Column:
    """Equal, or one of them is not stated."""
    code = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    return F.coalesce(code(a) == code(b), F.lit(True))


def _relative(a: Column, b: Column) -> Column:
    total = F.greatest(F.abs(a), F.abs(b)).cast("double")
    return F.when((total > 0) & a.isNotNull() & b.isNotNull(), F.abs(a - b).cast("double") / total).otherwise(F.lit(0.0))


def _pairs(rows: DataFrame, on: list[str], pairs: DataFrame) -> DataFrame:
    texts = ["normalized_value"] if "normalized_value" in rows.columns else []
    # rows of roles that may be compared, dealt once for both sides; most roles of a group may be compared, so that roles are looked at pair by pair
    rows = rows.join(F.broadcast(pairs.select(F.col("role1").alias("amount_role")).distinct()), "amount_role", "left_semi")
    side = lambda k: rows.select(*on, *(F.col(c).alias(f"{c}{k}") for c in ("entity_id", "doc_id", "doc_type", "amount_role", "amount_value", "amount_currency", *texts)))
    named = pairs.select(F.col("role1").alias("amount_role1"), F.col("role2").alias("amount_role2"), *(c for c in pairs.columns if c not in ("role1", "role2")))
    joined = side(1).join(side(2), on).where((F.col("entity_id1") < F.col("entity_id2")) & (F.col("doc_id1") != F.col("doc_id2"))).join(F.broadcast(named), ["amount_role1", "amount_role2"])
    texts = [F.col(f"{c}{k}") for c in texts for k in (1, 2)]
    kept = joined.where(same_currency(F.col("amount_currency1"), F.col("amount_currency2")) & materially_different(F.col("amount_value1"), F.col("amount_value2"), *texts))
    return kept.withColumn("relative_difference", _relative(F.col("amount_value1"), F.col("amount_value2")))


def anchored(amounts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Comparable, materially different amounts of different documents that share an anchor, one row for each anchor."""
    rows = amounts.where("anchor_id is not null")
    return _pairs(rows, ["audit_id", "anchor_id"], pairs)


def anchorless(amounts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for roles that need no anchor, without the pairs that have one."""
    rows = amounts.where(F.col("amount_role").isin(*ANCHORLESS))
    found = _pairs(rows, ["audit_id"], pairs.where("role1 = role2"))
    return found.join(anchored(rows, pairs).select("entity_id1", "entity_id2"), ["entity_id1", "entity_id2"], "left_anti")


def most_material(pairs: DataFrame, most: int = TOP_PAIRS) -> DataFrame:
    """The pairs of each audit with the largest relative differences; equals by their ids."""
    order = Window.partitionBy("audit_id").orderBy(F.desc("relative_difference"), "entity_id1", "entity_id2", F.col("anchor_id").asc_nulls_first())
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def assessed(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The most material of the deduplicated pairs of each audit: those that a model, or a rule, is asked about."""
    return most_material(dedupe(pairs), most)


def dedupe(pairs: DataFrame) -> DataFrame:
    """The first pair of each audit with the same two amounts, in either order, and reason."""
    key = F.array_sort(F.array("amount_value1", "amount_value2"))
    order = Window.partitionBy("audit_id", key, "reason").orderBy(F.desc("relative_difference"), "entity_id1", "entity_id2")
    return pairs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def severity(difference: Column, relative: Column) -> Column:
    return F.when((difference >= 5000) | (relative >= 0.05), "critical").otherwise("warning")


def conflict_rows(pairs: DataFrame, most: int = 30) -> DataFrame:
    """Rows for a report: deduplicated pairs with label and severity, at most 30 an audit."""
    rows = dedupe(pairs).withColumn("difference", F.abs(F.col("amount_value1") - F.col("amount_value2")))
    order = Window.partitionBy("audit_id").orderBy(F.desc("difference"), "entity_id1", "entity_id2")
    ranked = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    text = lambda c: F.format_number(F.col(c).cast("double"), 2)
    return ranked.select(
        "audit_id",
        F.coalesce("reason", "anchor_id", F.lit("Cross-document amount")).alias("entity_label"),
        F.col("doc_id1").alias("doc_a_id"),
        text("amount_value1").alias("doc_a_value"),
        F.col("doc_id2").alias("doc_b_id"),
        text("amount_value2").alias("doc_b_value"),
        severity(F.col("difference"), F.col("relative_difference")).alias("severity"),
    )


def reference_mismatches(amounts: DataFrame, spark: SparkSession) -> DataFrame:
    """What a document says of another against that one's own figure, by their shared anchor."""
    claims = spark.createDataFrame(CLAIMS, "claim_role string, truth_role string, truth_type string, label string")
    rows = amounts.where("anchor_id is not null and amount_value is not null")
    c = rows.join(F.broadcast(claims), F.col("amount_role") == F.col("claim_role")).select("audit_id", "anchor_id", "truth_role", "truth_type", "label", F.col("doc_id").alias("claim_doc_id"), F.col("amount_value").alias("claim_value"), F.col("amount_currency").alias("claim_currency"))
    # only amounts that a claim can be about are moved to the claims
    t = rows.where(F.col("amount_role").isin(*sorted({truth for _, truth, *_ in CLAIMS}))).select("audit_id", "anchor_id", F.col("amount_role").alias("truth_role"), F.col("doc_type").alias("truth_type"), F.col("doc_id").alias("truth_doc_id"), F.col("amount_value").alias("truth_value"), F.col("amount_currency").alias("truth_currency"))
    gap = F.abs(F.col("claim_value") - F.col("truth_value"))
    found = c.join(t, ["audit_id", "anchor_id", "truth_role", "truth_type"]).where("claim_doc_id != truth_doc_id").where(same_currency(F.col("claim_currency"), F.col("truth_currency")))
    found = found.where(gap > F.greatest(F.lit(1), F.abs("truth_value") * F.lit("0.0001").cast("decimal(5,4)"))).dropDuplicates(["claim_doc_id", "claim_value", "truth_doc_id", "truth_value"])
    relative = gap.cast("double") / F.greatest(F.abs("truth_value").cast("double"), F.lit(1.0))
    return found.select("audit_id", "label", "claim_doc_id", "truth_doc_id", F.col("claim_value").cast("double").alias("claim_value"), F.col("truth_value").cast("double").alias("truth_value"), (F.col("claim_value") - F.col("truth_value")).cast("double").alias("difference"), relative.alias("relative_difference"), severity(gap, relative).alias("severity"), F.lit(0.95).alias("confidence"))
