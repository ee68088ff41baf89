"""The reconciliation snapshot: contract, invoice and bank totals of each audit, and their gates.

Amounts are rows of sources.ledger.AMOUNT_COLUMNS. Contract, invoice and arithmetic figures come out of one
aggregation by document; only debits, of which each transaction counts once, are looked at by row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import identifier_core

# Roles that are states or pre-aggregated sums, never summed.
NON_SUMMABLE = ("opening_balance", "closing_balance", "running_balance", "statement_total_debits", "statement_total_credits")
OUTFLOW = ("transaction_debit",)
DEFAULT_CURRENCY = "EGP"
# Least amount that counts, tolerances of sums, characters of an identifier's core that are no accident.
LEAST, TOLERANCE, DRIFT, LEAST_CORE = 1, 1, "0.005", 6
# Roles whose largest amount a document's own arithmetic is about.
_LARGEST = {
    "total": "total_invoice", "subtotal": "invoice_subtotal", "vat": "vat_tax", "fee": "late_fee",
    "assets": "total_assets", "liabilities": "total_liabilities", "equity": "total_equity", "contract": "total_contract_value",
}


def _role() -> Column:
    return F.lower(F.trim(F.coalesce("amount_role", F.lit("unknown"))))


def _of(role: str, least: bool = True) -> Column:
    kept = F.col("amount_role") == role
    return F.when(kept & (F.col("amount_value") >= LEAST) if least else kept, F.col("amount_value"))


def _text(amount: Column) -> Column:
    return F.format_number(amount.cast("double"), 2)


def _figures(amounts: DataFrame) -> dict[str, tuple[str, Column]]:
    """The figures of documents that snapshots and warnings need, each with the way in which parts of it go together."""
    invoice = ("total_invoice", "invoice_subtotal", "vat_tax")
    return {
        "filename": ("min", F.col("filename") if "filename" in amounts.columns else F.col("doc_id")),
        **{n: ("max", _of(r, False)) for n, r in _LARGEST.items()},
        "contract_value": ("max", _of("total_contract_value")),
        "scheduled": ("sum", _of("milestone_scheduled")),
        "milestones": ("sum", _of("milestone_scheduled", False)),
        "n_milestones": ("count", _of("milestone_scheduled", False)),
        **{n: ("list", _of(r)) for r, n in zip(invoice, ("totals", "subs", "vats"), strict=True)},
        "stated": ("max", _of("statement_total_debits")),
        "n_unknown": ("count", _of("unknown")),
    }


_FIRST = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "list": F.collect_list}


def by_document(amounts: DataFrame, lists: bool = True) -> DataFrame:
    """One row for each document of an audit with the figures that snapshots and warnings need, in one pass; without lists, no values are gathered one by one."""
    figures = {n: _FIRST[kind](c).alias(n) for n, (kind, c) in _figures(amounts).items() if lists or kind != "list"}
    # roles are trimmed and in lower case once for all figures
    return amounts.withColumn("amount_role", _role()).groupBy("audit_id", "doc_id", "doc_type").agg(*figures.values())


def _when_type(kind: str, value: Column) -> Column:
    return F.when(F.col("doc_type") == kind, value)


def _supported() -> Column:
    """The largest total of an invoice that some subtotal and VAT support within 1.00, else its largest total, else subtotal."""
    fits = F.filter("totals", lambda t: F.exists("subs", lambda s: F.exists("vats", lambda v: F.abs(t - (s + v)) <= TOLERANCE)))
    return F.coalesce(F.array_max(fits), F.array_max("totals"), F.array_max("subs"))


def totals(documents: DataFrame) -> DataFrame:
    """Of each audit, out of by_document(): contract_total, the largest stated value, else the sum of the scheduled
    milestones; invoice_total, the largest of its invoices'; stated debits; bank amounts of no known role."""
    return documents.groupBy("audit_id").agg(
        F.coalesce(F.max(_when_type("contract", F.col("contract_value"))), F.sum(_when_type("contract", F.col("scheduled")))).alias("contract_total"),
        F.max(_when_type("invoice", _supported())).alias("invoice_total"),
        F.sum(_when_type("bank_statement", F.col("stated"))).alias("stated"),
        F.coalesce(F.sum(_when_type("bank_statement", F.col("n_unknown"))), F.lit(0)).alias("n_unknown"),
    )


def contract_totals(amounts: DataFrame) -> DataFrame:
    """(audit_id, contract_total) of audits with contract rows."""
    rows = amounts.where("doc_type = 'contract'").where(F.col("amount_value") >= LEAST)
    return totals(by_document(rows)).select("audit_id", "contract_total")


def invoice_totals(amounts: DataFrame) -> DataFrame:
    """(audit_id, invoice_total) of audits with an invoice's total, subtotal or VAT."""
    rows = amounts.where("doc_type = 'invoice'").where((F.col("amount_value") >= LEAST) & _role().isin("total_invoice", "invoice_subtotal", "vat_tax"))
    return totals(by_document(rows)).select("audit_id", "invoice_total")


def anchor_rows(amounts: DataFrame) -> DataFrame:
    """(audit_id, anchor_id): the numbers and parties that an audit's contracts are about. A debit linked to one is a
    payment on the contract."""
    return amounts.where("doc_type = 'contract' and anchor_id is not null").select("audit_id", "anchor_id").distinct()


def contract_anchors(amounts: DataFrame) -> DataFrame:
    """(audit_id, anchors): anchor_rows() as a set for each audit, to be looked at."""
    return anchor_rows(amounts).groupBy("audit_id").agg(F.collect_set("anchor_id").alias("anchors"))


def identifier_cores(identifiers: DataFrame) -> DataFrame:
    """(audit_id, core) of the contract and invoice numbers (audit_id, identifier) of an audit; shorter cores than
    LEAST_CORE would turn up in other numbers by accident."""
    cores = identifiers.select("audit_id", identifier_core(F.col("identifier")).alias("core"))
    return cores.where(F.length("core") >= LEAST_CORE).distinct()


#: Cores of an audit that stand in one array beside its lines; an audit with more has several.
CORES = 500
#: First characters of a reference by which substrings that can't be one are left out where they are cut: of letters and digits there are at most 1,296.
HEAD = 2


def linked_refs(lines: DataFrame, cores: DataFrame, refs: DataFrame) -> DataFrame:
    """(audit_id, txn_ref): transactions whose own line (audit_id, line) names one of the audit's identifiers, so that they
    are payments on it without any edge. refs: (audit_id, txn_ref) of its statements.

    Lines are tested in their row for the audit's few identifiers. Only those that name one are cut into the substrings that may be a reference, by the lengths
    that references have and the characters that those of a length begin with, and these are joined by equality."""
    # used twice below, filtered alike, so that they are read and brought together once
    known = refs.where("txn_ref is not null and lower(trim(txn_ref)) is not null and audit_id is not null").select("audit_id", "txn_ref", identifier_core(F.col("txn_ref")).alias("part")).where("part != ''").distinct()
    part = F.row_number().over(Window.partitionBy("audit_id").orderBy("core"))
    few = cores.withColumn("k", F.floor((part - 1) / CORES)).groupBy("audit_id", "k").agg(F.collect_list("core").alias("cores"))
    lines = lines.select("audit_id", identifier_core(F.col("line")).alias("text")).where("text != ''")
    named = lines.join(few, "audit_id").where(F.exists("cores", lambda c: F.contains(F.col("text"), c))).select("audit_id", "text").distinct()
    sizes = known.groupBy("audit_id", F.length("part").alias("n")).agg(F.collect_set(F.substring("part", 1, HEAD)).alias("heads"), F.count("*").alias("refs")).where("refs > 0")
    sizes = sizes.groupBy("audit_id").agg(F.collect_list(F.struct("n", "heads")).alias("sizes"))
    text = F.col("text")
    begun = lambda s: F.filter(F.sequence(F.lit(1), F.length(text) - s["n"] + 1), lambda i: F.array_contains(s["heads"], F.substr(text, i, F.least(s["n"], F.lit(HEAD)))))
    cut = F.flatten(F.transform("sizes", lambda s: F.when(F.length(text) >= s["n"], F.transform(begun(s), lambda i: F.substr(text, i, s["n"]))).otherwise(F.array().cast("array<string>"))))
    found = named.join(sizes, "audit_id").select("audit_id", F.explode(F.array_distinct(cut)).alias("part"))
    return found.join(known, ["audit_id", "part"]).select("audit_id", "txn_ref").distinct()


def debits(amounts: DataFrame) -> DataFrame:
    """Debits that count: at least 1, without rows that have neither reference nor date if the
    audit has any that do, and the first of rows with the same reference, date or page. times: how many rows it stands for."""
    rows = amounts.where("doc_type = 'bank_statement'").where((F.col("amount_value") >= LEAST) & _role().isin(*OUTFLOW))
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = rows.withColumns({"_ref": clean("txn_ref"), "_date": clean("txn_date")})
    named = F.col("_ref").isNotNull() | F.col("_date").isNotNull()
    rows = rows.withColumn("any_named", F.max(named).over(Window.partitionBy("audit_id"))).where(named | ~F.col("any_named"))
    kind = F.when(F.col("_ref").isNotNull(), F.concat(F.lit("ref:"), F.col("_ref"))).when(F.col("_date").isNotNull(), F.concat(F.lit("date:"), F.col("_date"))).otherwise(F.concat(F.lit("page:"), F.col("source_page").cast("string")))
    rows = rows.withColumn("key", kind)
    same = Window.partitionBy("audit_id", "doc_id", "key", "amount_value")
    rows = rows.withColumns({"rn": F.row_number().over(same.orderBy("source_page", "entity_id")), "times": F.count("*").over(same)})
    return rows.where("rn = 1").drop("rn", "any_named", "_ref", "_date")


def attributed_debits(amounts: DataFrame, anchors: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """debits() with paid: whether a debit is a payment on the audit's contract. It is if its anchor is one of the contract's
    (anchors: audit_id, anchor_id or the array anchors; from the amounts where not given), or its reference is linked (refs: audit_id, txn_ref); in an audit whose
    contracts have no anchors, every debit is."""
    anchors = anchor_rows(amounts) if anchors is None else anchors
    if "anchors" in anchors.columns:
        anchors = anchors.select("audit_id", F.explode("anchors").alias("anchor_id"))
    listed = anchors.where("anchor_id is not null and audit_id is not null").select("audit_id", "anchor_id").distinct()
    rows = debits(amounts).join(listed.withColumn("_on", F.lit(True)), ["audit_id", "anchor_id"], "left").join(listed.groupBy("audit_id").agg(F.count("*").alias("_any")), "audit_id", "left")
    linked = F.lit(False)
    if refs is not None:
        ref = F.lower(F.trim("txn_ref"))
        rows = rows.withColumn("_ref", ref).join(refs.select("audit_id", ref.alias("_ref"), F.lit(True).alias("_linked")).distinct(), ["audit_id", "_ref"], "left")
        linked = F.coalesce("_linked", F.lit(False))
    paid = F.col("_any").isNull() | F.coalesce("_on", F.lit(False)) | linked
    return rows.withColumn("paid", paid).drop("_on", "_any", "_ref", "_linked")


def bank_totals(amounts: DataFrame, anchors: DataFrame | None = None, refs: DataFrame | None = None, stated: DataFrame | None = None) -> DataFrame:
    """verified: all debits; paid: those on the contract, null if there are none; stated debits; repeated: whether rows were left out as
    repeats; incomplete: stated and verified debits, where there are any, differ by more than 1 and half a percent."""
    sums = attributed_debits(amounts, anchors, refs).groupBy("audit_id").agg(F.sum("amount_value").alias("verified"), F.sum(F.when(F.col("paid"), F.col("amount_value"))).alias("paid"), (F.max("times") > 1).alias("repeated"))
    if stated is None:
        rows = amounts.where("doc_type = 'bank_statement'").where((_role() == "statement_total_debits") & (F.col("amount_value") >= LEAST))
        stated = rows.groupBy("audit_id", "doc_id").agg(F.max("amount_value").alias("m")).groupBy("audit_id").agg(F.sum("m").alias("stated"))
    drift = F.abs(F.col("verified") - F.col("stated"))
    incomplete = F.coalesce((F.col("verified") > 0) & (F.col("stated") > 0) & (drift > F.greatest(F.lit(TOLERANCE), F.col("stated") * F.lit(DRIFT).cast("decimal(4,3)"))), F.lit(False))
    return sums.join(stated, "audit_id", "full").select("audit_id", "verified", "stated", "paid", F.coalesce("repeated", F.lit(False)).alias("repeated"), incomplete.alias("incomplete"))


def _code() -> Column:
    return F.nullif(F.upper(F.trim("amount_currency")), F.lit(""))


def _ranked(counts: Column) -> tuple[Column, Column]:
    """The most frequent of an array of (n, code), the first by code of equals, and the other codes, in order."""
    ranked = F.array_sort(F.transform(counts, lambda x: F.struct((-x["n"]).alias("n"), x["code"].alias("code"))))
    others = F.array_sort(F.transform(F.slice(ranked, F.lit(2), F.greatest(F.size(ranked) - 1, F.lit(0))), lambda x: x["code"]))
    return F.get(ranked, F.lit(0))["code"], F.array_join(others, ", ")


def dominant_currency(amounts: DataFrame) -> DataFrame:
    """The most frequent currency of an audit, the first by code of equals, and the other ones, in order."""
    counts = amounts.groupBy("audit_id", _code().alias("code")).agg(F.count("*").alias("n")).where("code is not null")
    first, others = _ranked(F.col("all"))
    return counts.groupBy("audit_id").agg(F.collect_list(F.struct("n", "code")).alias("all")).select("audit_id", first.alias("currency"), others.alias("others"))


def _by_audit(amounts: DataFrame) -> DataFrame:
    """Totals as of totals(), currency and others, and the warnings w of each audit: amounts of a currency, figures of documents and totals of invoices are brought to
    a row or two for each audit on their own, and these rows together. A document that tells nothing of itself is left out before."""
    ways = {"largest": F.max, "planned": F.sum, "invoiced": F.max, "stated": F.sum, "n_unknown": F.sum}
    of = {"largest": ("contract", "contract_value"), "planned": ("contract", "scheduled"), "stated": ("bank_statement", "stated"), "n_unknown": ("bank_statement", "n_unknown")}
    one = by_document(amounts, False).select("audit_id", _told().alias("w"), *(_when_type(kind, F.col(c)).alias(name) for name, (kind, c) in of.items()))
    one = one.where(F.col("w").isNotNull() | F.coalesce(*(F.col(c).cast("double") for c in of)).isNotNull())
    said = one.groupBy("audit_id").agg(F.flatten(F.collect_list("w")).alias("w"), *(ways[c](c).alias(c) for c in of))
    rows = amounts.groupBy("audit_id", _code().alias("code")).agg(F.count("*").alias("n")).unionByName(said, True).unionByName(invoice_totals(amounts).withColumnRenamed("invoice_total", "invoiced"), True)
    out = rows.groupBy("audit_id").agg(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("n", "code"))).alias("all"), F.array_sort(F.flatten(F.collect_list("w"))).alias("w"), *(f(c).alias(c) for c, f in ways.items()))
    currency, others = _ranked(F.col("all"))
    return out.select("audit_id", F.coalesce("largest", "planned").alias("contract_total"), F.col("invoiced").alias("invoice_total"), "stated", F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.when(F.size("w") > 0, F.col("w")).alias("w"), currency.alias("currency"), others.alias("others"))


def snapshot(amounts: DataFrame, anchors: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """One row for each audit with any of the three totals, a withheld one, or a warning. notes says what to know of the bank total;
    integrity_warnings are arithmetic_warnings() and mixed currencies, in order, a line each. The amounts are read four times: for currencies, for the figures of
    documents, for what supports an invoice's total, and for the debits; a caller whose amounts are costly to make hands over a table."""
    bank = bank_totals(amounts, anchors, refs, amounts.limit(0).select("audit_id", F.col("amount_value").alias("stated"))).drop("stated", "incomplete")
    out = _by_audit(amounts).join(bank, "audit_id", "left")
    drift = F.abs(F.col("verified") - F.col("stated"))
    incomplete = F.coalesce((F.col("verified") > 0) & (F.col("stated") > 0) & (drift > F.greatest(F.lit(TOLERANCE), F.col("stated") * F.lit(DRIFT).cast("decimal(4,3)"))), F.lit(False))
    out = out.withColumn("incomplete", incomplete).withColumn("currency", F.coalesce("currency", F.lit(DEFAULT_CURRENCY)))
    out = out.withColumn("bank_paid_total", F.when(~F.col("incomplete"), F.col("paid")))
    none, unknown = F.col("bank_paid_total").isNull(), F.col("n_unknown")
    notes = F.concat_ws(
        " ",
        F.when(F.col("repeated"), "Rows of one transaction were counted once."),
        F.when(F.col("incomplete"), F.concat(F.lit("Extraction incomplete: debits of "), _text(F.col("verified")), F.lit(" out of "), _text(F.col("stated")), F.lit(" "), F.col("currency"), F.lit(" are verified, and the bank total is withheld."))),
        F.when(none & (unknown > 0), F.concat(F.lit("No bank total: "), unknown.cast("string"), F.lit(" amounts are neither debits nor credits."))),
        F.when(none, "Bank payments were not added up.").when(F.col("contract_total").isNull(), "The bank total stands without a contract total."),
    )
    mixed = F.when(F.col("others") != "", F.concat(F.lit("Amounts in "), F.col("currency"), F.lit(" and in "), F.col("others"), F.lit(" are added up together.")))
    lines = F.concat_ws("\n", F.array_join(F.transform("w", lambda x: x["warning"]), "\n"), mixed)
    number = lambda c, when=None: F.round(F.col(c) if when is None else F.when(F.col(when), F.col(c)), 2).cast("double")
    out = out.withColumn("integrity_warnings", lines)
    kept = out.where("contract_total is not null or invoice_total is not null or bank_paid_total is not null or incomplete or integrity_warnings != ''")
    return kept.select(
        "audit_id",
        "currency",
        number("contract_total").alias("contract_total"),
        number("invoice_total").alias("invoice_total"),
        number("bank_paid_total").alias("bank_paid_total"),
        F.round(F.col("bank_paid_total") - F.col("contract_total"), 2).cast("double").alias("variance_vs_contract"),
        F.col("incomplete").alias("bank_extraction_incomplete"),
        number("verified", "incomplete").alias("bank_debits_verified"),
        number("stated", "incomplete").alias("bank_debits_stated"),
        notes.alias("notes"),
        "integrity_warnings",
    )


def _checks() -> list[tuple[str, Column, Column]]:
    """Each check: its name, whether a document fails it, and what it says of that."""
    c = F.col
    fee = F.coalesce(c("fee"), F.lit(0))
    expected, sheet = c("subtotal") + c("vat") + fee, c("liabilities") + c("equity")
    said = lambda *parts: F.concat(c("filename"), F.lit(": "), *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    with_fee = F.when(fee != 0, F.concat(F.lit(" + late fee "), _text(fee))).otherwise("")
    return [
        ("invoice", (c("doc_type") == "invoice") & (F.abs(c("total") - expected) > TOLERANCE), said("subtotal ", _text(c("subtotal")), " + VAT ", _text(c("vat")), with_fee, " = ", _text(expected), ", stated total ", _text(c("total")))),
        ("balance_sheet", (c("doc_type") == "balance_sheet") & (F.abs(c("assets") - sheet) > TOLERANCE), said("liabilities ", _text(c("liabilities")), " + equity ", _text(c("equity")), " = ", _text(sheet), ", stated assets ", _text(c("assets")))),
        ("milestones", (c("doc_type") == "contract") & (c("n_milestones") >= 2) & (c("contract") - c("milestones") > TOLERANCE), said(c("n_milestones").cast("string"), " milestones of ", _text(c("milestones")), ", stated contract total ", _text(c("contract")))),
    ]


def _told() -> Column:
    """(doc_id, check, warning) of the checks that a document fails; null if it passes them all, which is seen before any is made."""
    failed = functools.reduce(Column.__or__, (when for _, when, _ in _checks()))
    every = F.array(*(F.when(when, F.struct("doc_id", F.lit(name).alias("check"), text.alias("warning"))) for name, when, text in _checks()))
    return F.when(failed, F.array_compact(every))


def arithmetic_warnings(amounts: DataFrame) -> DataFrame:
    """Documents whose own figures don't add up: invoices with total, subtotal and VAT (a late fee is part of the total), balance
    sheets with all three sums, and contracts whose two or more scheduled milestones fall short."""
    return by_document(amounts, False).select("audit_id", F.inline(_told()))
