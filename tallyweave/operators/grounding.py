"""Amounts in the prose of findings: what they stand for, and which document they come from."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyweave.functions.money import amounts_in, variants

# Words before an amount that say what it is.
ROLE_WORDS = {
    "contract_total": ["contract", "agreement", "عقد", "اتفاق"],
    "invoice_total": ["invoice", "billed", "فاتور"],
    "bank_paid_total": ["bank paid", "total paid", "bank", "paid", "transfer", "disburse", "remitt", "دفع", "سداد", "تحويل"],
}
LEAST = 1000.0
# Order of documents in a conflict row.
TYPE_ORDER = ["contract", "invoice", "payment_certificate", "bank_statement"]

def role_before(window: Column) -> Column:
    """The role whose word is nearest to the end of the window; the first of equals; null without any."""
    roles = {x: role for role, words in ROLE_WORDS.items() for x in words}
    # what goes before is taken as far as it goes, so that the word is the last one; of words at one place the first listed counts. Most places begin no word
    head = "".join(sorted({x[0] for x in roles}))
    word = F.regexp_extract(F.lower(window), f"(?s)^.*(?=[{head}])({'|'.join(roles)})", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in roles.items() for x in kv)), word)


def label_amounts(findings: DataFrame) -> DataFrame:
    """(audit_id, field, value): the largest amount of critical findings that a word of that field precedes."""
    text = F.concat(F.col("title"), F.lit(". "), F.coalesce("description", F.lit("")))
    told = F.transform(F.filter(amounts_in(text), lambda a: a["value"] >= LEAST), lambda a: F.struct(role_before(a["before"]).alias("field"), a["value"].alias("value")))
    rows = findings.where("severity = 'critical'").select("audit_id", F.inline(told)).where("field is not null")
    return rows.groupBy("audit_id", "field").agg(F.max("value").alias("value"))


def fill_gaps(snapshots: DataFrame, inferred: DataFrame) -> DataFrame:
    """Snapshots with empty totals taken from labelled amounts; a withheld bank total stays withheld."""
    fields = list(ROLE_WORDS)
    wide = inferred.groupBy("audit_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields))
    out = snapshots.join(wide, "audit_id", "left")
    usable = {f: F.col(f).isNull() & F.col(f"_{f}").isNotNull() & (F.lit(f != "bank_paid_total") | ~F.col("bank_extraction_incomplete")) for f in fields}
    names = F.concat_ws(", ", *(F.when(usable[f], f.replace("_total", "").replace("_", " ")) for f in fields))
    out = out.withColumn("_names", names).withColumns({f"_use_{f}": usable[f] for f in fields})
    out = out.withColumns({f: F.when(F.col(f"_use_{f}"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields})
    gap = F.round(F.col("bank_paid_total") - F.col("contract_total"), 2)
    any_used = F.col("_names") != ""
    note = F.when(any_used, F.concat(F.lit("Inferred from labeled finding text: "), F.col("_names"), F.lit(".")))
    out = out.withColumns({"variance_vs_contract": F.when(any_used & gap.isNotNull(), gap).otherwise(F.col("variance_vs_contract")), "notes": F.concat_ws(" ", F.when(F.col("notes") != "", F.col("notes")), note)})
    return out.select(snapshots.columns)


def owners(amounts: DataFrame) -> DataFrame:
    """(audit_id, value, owner): values, in cents, that just one document of an audit has."""
    value = F.round(F.col("amount_value").cast("double"), 2).alias("value")
    found = amounts.groupBy("audit_id", value).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    return found.where("owner = last").select("audit_id", "value", "owner")


def grounded(findings: DataFrame, documents: DataFrame, amounts: DataFrame) -> DataFrame:
    """(audit_id, finding_id, value, doc_id): each headline amount with the document that an evidence line
    quotes it from, else the only document that has it; without either it isn't grounded."""
    text = F.concat(F.col("title"), F.lit(". "), F.coalesce("description", F.lit("")))
    values = findings.select("audit_id", "finding_id", "evidence", F.explode(F.array_distinct(F.transform(F.filter(amounts_in(text), lambda a: a["value"] >= LEAST), lambda a: F.round(a["value"], 2)))).alias("value"))
    lines = values.select("audit_id", "finding_id", "value", F.posexplode(F.coalesce("evidence", F.array().cast("array<string>"))).alias("pos", "line"))
    forms = variants(F.col("value"))
    quoted = F.contains("line", forms[0])
    for f in forms[1:]:
        quoted = quoted | F.contains("line", f)
    docs = documents.select("audit_id", "doc_id", "filename")
    by_line = lines.where(quoted).join(docs, "audit_id").where(F.startswith("line", "filename"))
    by_line = by_line.groupBy("audit_id", "finding_id", "value").agg(F.min_by("doc_id", F.struct("pos", "doc_id")).alias("quoted_in"))
    out = values.drop("evidence").join(by_line, ["audit_id", "finding_id", "value"], "left").join(owners(amounts), ["audit_id", "value"], "left")
    return out.select("audit_id", "finding_id", "value", F.coalesce("quoted_in", "owner").alias("doc_id")).where("doc_id is not null")


def finding_conflicts(findings: DataFrame, documents: DataFrame, amounts: DataFrame) -> DataFrame:
    """One row for each critical or warning finding with grounded amounts of two documents: contract before
    invoice before certificate before bank, the larger amounts first."""
    rows = grounded(findings.where("severity in ('critical', 'warning')"), documents, amounts).join(documents.select("audit_id", "doc_id", "doc_type"), ["audit_id", "doc_id"], "left")
    place = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("doc_type"))
    place = F.when(F.coalesce(place, F.lit(0)) == 0, len(TYPE_ORDER) + 1).otherwise(place)
    order = Window.partitionBy("audit_id", "finding_id").orderBy(place, F.desc("value"), "doc_id")
    amount = F.struct("doc_id", "doc_type", "value")
    ranked = rows.select("audit_id", "finding_id", "doc_id", amount.alias("amount"), F.row_number().over(order).alias("rn"), F.first(amount).over(order).alias("a"))
    other = F.min_by("amount", F.when(F.col("doc_id") != F.col("a.doc_id"), F.col("rn"))).alias("b")
    pairs = ranked.groupBy("audit_id", "finding_id").agg(F.first("a").alias("a"), other).where("b is not null")
    label = lambda c: F.replace(F.coalesce(c, F.lit("document")), F.lit("_"), F.lit(" "))
    return pairs.select(
        "audit_id", "finding_id", F.col("a.doc_id").alias("doc_a_id"), F.format_number(F.col("a.value"), 2).alias("doc_a_value"), F.col("b.doc_id").alias("doc_b_id"), F.format_number(F.col("b.value"), 2).alias("doc_b_value"),
        F.concat(label(F.col("a.doc_type")), F.lit(" vs "), label(F.col("b.doc_type")), F.lit(" (from finding)")).alias("conflict_type"),
    )


def merged_conflicts(of_findings: DataFrame, of_graph: DataFrame, most: int = 30) -> DataFrame:
    """Conflict rows (audit_id, doc_a_value, doc_b_value and others alike) of findings, then those of the graph whose two amounts, in
    either order, no row before them has; at most 30 an audit, in their order by position."""
    both = of_findings.withColumn("source", F.lit(0)).unionByName(of_graph.withColumn("source", F.lit(1)))
    pair = F.array_sort(F.array("doc_a_value", "doc_b_value"))
    same = Window.partitionBy("audit_id", pair).orderBy("source", "position")
    kept = both.withColumn("rn", F.row_number().over(same)).where("source = 0 or rn = 1")
    order = Window.partitionBy("audit_id").orderBy("source", "position")
    return kept.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("position", "source").withColumnRenamed("rn", "position")


def snippets(hits: DataFrame, most: int | None = 14, chars: int | None = 180, least: int = 1) -> DataFrame:
    """The first hits of a check, by position, with different document and head of text; a check with fewer than least has none. most None: all of them; chars None: texts are told
    apart as a whole."""
    first = Window.partitionBy("audit_id", "check_no", "doc_id", F.col("text") if chars is None else F.substring("text", 1, chars)).orderBy("position")
    rows = hits.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    check = Window.partitionBy("audit_id", "check_no")
    out = rows.withColumn("snippet_no", F.row_number().over(check.orderBy("position", "doc_id")))
    out = out if most is None else out.where(F.col("snippet_no") <= most)
    return out if least <= 1 else out.withColumn("rn", F.count("*").over(check)).where(F.col("rn") >= least).drop("rn")


def _not_json(word: str):
    raise ValueError(word)


_DECODER = json.JSONDecoder(parse_constant=_not_json)


def _first_object(text: str | None) -> str | None:
    """The first bracket from which on JSON can be read, with what it holds. One that can't be read is passed over in a step or two."""
    at = (text or "").find("{")
    while at >= 0:
        try:
            return text[at : _DECODER.raw_decode(text, at)[1]]
        except ValueError:
            at = text.find("{", at + 1)
        except RecursionError:
            return None
    return None


@F.pandas_udf(StringType())
def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(_first_object)


def json_object(text: Column) -> Column:
    """The first object in a noisy text that is JSON, as it stands there; null without. Of objects in one another the outermost counts: what is deeper than Python's
    recursion goes (thousands of levels) is no object."""
    return _objects(text)


def unfenced(text: Column) -> Column:
    """The content of a code fence, or the text itself."""
    inside = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\s*\n?(.*?)```", 1)
    return F.regexp_replace(F.when(inside != "", inside).otherwise(text), r"^\s+|\s+$", "")
