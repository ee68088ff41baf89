"""Evidence of findings: whether it holds the values it is cited for, and how findings are put into words."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.money import amounts_in, parse_amount, within_tiny_tolerance

# Words of a file name that mark a bank document, and of one that is no financial document.
BANK_NAMES = ["bank", "statement", "stmt"]
OTHER_NAMES = "(?i)(cv|resume|profile)"


def after_label(line: Column) -> Column:
    """What follows the first colon of a line, or the line itself."""
    at = F.instr(line, ":")
    return F.when(at > 0, F.trim(F.substr(line, at + 1))).otherwise(line)


def line_backs(line: Column, raw: Column) -> Column:
    """Whether a line of evidence holds the amount that raw is; false if raw is none."""
    target, tail = parse_amount(raw), after_label(F.coalesce(line, F.lit("")))
    near = lambda v: F.coalesce(within_tiny_tolerance(v, target), F.lit(False))
    return near(parse_amount(tail)) | F.exists(amounts_in(tail), lambda a: near(a["value"])) | near(parse_amount(line))


def snippets_back(evidence: Column, *values: Column) -> Column:
    """Whether each of the values stands in some line of the evidence."""
    found = F.flatten(F.transform(F.coalesce(evidence, F.array().cast("array<string>")), lambda e: F.transform(amounts_in(after_label(e)), lambda a: a["value"])))

    def stands(v: Column) -> Column:
        return F.exists(found, lambda x: F.coalesce(within_tiny_tolerance(x, v), F.lit(False)))

    return reduce(and_, map(stands, values), F.lit(True))


def checked_severity(severity: Column, line1: Column, raw1: Column, line2: Column, raw2: Column) -> Column:
    """A critical pair whose lines do not hold both of its values is a warning."""
    return F.when((severity == "critical") & ~(line_backs(line1, raw1) & line_backs(line2, raw2)), "warning").otherwise(severity)


def is_bank_document(doc_type: Column, filename: Column) -> Column:
    name = F.lower(F.coalesce(filename, F.lit("")))
    return F.coalesce(F.lower(doc_type) == "bank_statement", F.lit(False)) | F.contains(name, F.lit(BANK_NAMES[0])) | F.contains(name, F.lit(BANK_NAMES[1])) | F.contains(name, F.lit(BANK_NAMES[2]))


def is_other_document(filename: Column) -> Column:
    """Whether a file name is that of a document that is likely not about money."""
    return F.rlike(F.coalesce(filename, F.lit("")), F.lit(OTHER_NAMES))


def short_label(doc_id: Column, filename: Column) -> Column:
    """A document's file name, or the head of its id."""
    return F.coalesce(F.nullif(filename, F.lit("")), F.concat(F.left(doc_id, F.lit(8)), F.lit("…")))


def cited(name: Column, page: Column, raw: Column) -> Column:
    return F.format_string("%s, page %s: %s", name, F.coalesce(page, F.lit(0)).cast("string"), raw)


def reference_findings(mismatches: DataFrame, names: DataFrame) -> DataFrame:
    """Findings out of pairs.reference_mismatches(): title, description and evidence in words. names: audit_id, doc_id, filename."""
    name = lambda k: names.select("audit_id", F.col("doc_id").alias(f"{k}_doc_id"), F.col("filename").alias(f"{k}_name"))
    rows = mismatches.join(name("claim"), ["audit_id", "claim_doc_id"], "left").join(name("truth"), ["audit_id", "truth_doc_id"], "left")
    rows = rows.withColumns({f"{k}_name": F.coalesce(f"{k}_name", f"{k}_doc_id") for k in ("claim", "truth")})
    money = lambda c: F.format_number(c, 2)
    said, true = money(F.col("claim_value")), money(F.col("truth_value"))
    return rows.select(
        "audit_id", F.concat_ws(">", "claim_doc_id", "truth_doc_id").alias("finding_id"), "severity", "confidence", F.lit("detector").alias("source"),
        F.concat("claim_name", F.lit(" gives the "), "label", F.lit(" as "), said, F.lit(", "), "truth_name", F.lit(" as "), true).alias("title"),
        F.concat(F.lit("The two differ by "), money(F.col("difference")), F.lit(" ("), F.format_number(F.col("relative_difference") * 100, 1), F.lit(" %).")).alias("description"),
        F.col("claim_doc_id").alias("source_doc_id"), F.col("truth_doc_id").alias("conflicting_doc_id"), F.array(cited(F.col("claim_name"), F.lit(1), said), cited(F.col("truth_name"), F.lit(1), true)).alias("evidence"),
    )


def signatory_findings(mismatches: DataFrame) -> DataFrame:
    """Findings out of graph.signatory_mismatches()."""
    return mismatches.select(
        "audit_id", F.concat_ws(">", "instrument1", "instrument2").alias("finding_id"), F.lit("warning").alias("severity"), "confidence", F.lit("graph").alias("source"),
        F.format_string("%s (%s) amends what %s (%s) signed", "name2", "authority2", "name1", "authority1").alias("title"),
        F.format_string("%s was signed at a level %s below that of %s.", "instrument2", F.col("authority_gap").cast("string"), "instrument1").alias("description"),
        F.array(F.concat_ws(": ", "name1", "instrument1"), F.concat_ws(": ", "name2", "instrument2")).alias("evidence"),
    )
