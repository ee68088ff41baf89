"""An audit from its pages to its report, for any number of audits in one plan.

pages -> documents with their types -> chunks -> amounts by rules -> snapshot, contradictions, restatements -> findings in their phases -> gate, fold of tellings, risk.
What is read by more than one step is written as a table: documents with their pages, amounts and findings. Texts are moved once, to their documents; what is known of a
document goes with its chunks from there on, so that nothing is joined to them. Models come in by the hooks; without them rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.dealing import dealt
from tallyweave.engine import Engine
from tallyweave.folders import stored
from tallyweave.functions.money import currency_code, parse_amount
from tallyweave.functions.text import detect_language, identifier_core
from tallyweave.operators import documents, evidence, snapshot
from tallyweave.operators.extraction import role_for_type
from tallyweave.operators.findings import REFERENCE

#: Types whose documents are about the contract that they name first.
ANCHORED = ("contract", "invoice", "payment_certificate")


def read_documents(engine: Engine, pages: DataFrame) -> DataFrame:
    """(audit_id, doc_id, filename, doc_type, language, page_count, currency, reference, pages) of pages (audit_id, doc_id, filename, page, text). currency: the one that the text
    names; reference: the first number of a contract, order or invoice in it, without its punctuation; pages: (page, text) in order."""
    own = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    docs = pages.groupBy("audit_id", "doc_id").agg(F.min("filename").alias("filename"), own.alias("pages"))
    docs = docs.withColumn("text", F.array_join(F.transform("pages", lambda p: p["text"]), "\n"))
    text, name = F.col("text"), F.col("filename")
    first = F.nullif(identifier_core(F.regexp_extract(text, REFERENCE, 1)), F.lit(""))
    return docs.select("audit_id", "doc_id", "filename", engine.hooks.classify(text, name).alias("doc_type"), detect_language(text).alias("language"), F.size("pages").alias("page_count"), currency_code(text).alias("currency"), first.alias("reference"), "pages")


def pages_of(docs: DataFrame) -> DataFrame:
    """The pages of documents as of read_documents(), each with what is known of its document (about)."""
    about = F.struct("audit_id", "doc_type", "filename", "currency", "reference").alias("about")
    return docs.select("audit_id", "doc_id", about, F.inline("pages"))


def _register() -> Column:
    return F.rlike("text", F.lit(documents.REGISTER_HINT))


def _chunks(rows: DataFrame) -> DataFrame:
    own = [c for c in ("about",) if c in rows.columns]
    return rows.where("trim(text) != ''").select("doc_id", *own, (F.col("page") * 2 + F.col("k")).cast("int").alias("chunk_index"), "page", "text")


def plain_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of pages that say nothing of a register: their texts, in their rows."""
    return _chunks(pages.where(~_register()).withColumn("k", F.lit(0)))


def register_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of the other pages: prose and rows where a page is a register that was set cell by cell, else its text."""
    key = F.struct(*(c for c in ("audit_id", "doc_id", "page") if c in pages.columns))
    own = [c for c in ("about",) if c in pages.columns]
    rows = pages.where(_register()).select(key.alias("page_id"), *own, "text")
    registers = documents.register_rows(rows)
    line = F.concat(F.lit(f"{documents.ROW_MARK} "), F.col("row"))
    lines = registers.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("t")))), lambda r: r["t"]), "\n").alias("rows"))
    prose = documents.register_prose(rows)
    both = rows.join(lines, "page_id", "left").join(prose, "page_id", "left")
    parts = F.array(F.struct(F.lit(0).alias("k"), F.when(F.col("rows").isNull(), F.col("text")).otherwise(F.col("prose")).alias("text")), F.struct(F.lit(1).alias("k"), F.col("rows").alias("text")))
    return _chunks(both.select("page_id.doc_id", "page_id.page", *own, F.inline(parts)))


def read_chunks(pages: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, page, text): a page's text, and, where it is a register that was set cell by cell, its prose and its rows. Index 2n is the text of page n, 2n + 1 are its rows.
    A column about goes on with them."""
    return plain_chunks(pages).unionByName(register_chunks(pages))


def read_amounts(engine: Engine, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The amounts of documents as snapshots and pairs take them (ledger.AMOUNT_COLUMNS). Amounts of contracts, invoices and certificates are anchored at the contract that
    their document names first; those of a statement's rows aren't, and are linked by what the rows say. Of chunks whose column about the hook hands on, documents aren't looked up."""
    found = engine.hooks.entities(chunks)
    if "about" in found.columns:
        found = found.select("*", "about.*")
    else:
        found = found.join(docs.select("audit_id", "doc_id", "doc_type", "filename", "currency", "reference"), "doc_id")
    text = lambda c: c.cast("string")
    return found.select(
        "audit_id", "doc_id", "doc_type", "filename", F.concat_ws(":", text(F.col("doc_id")), text(F.col("chunk_index")), text(F.col("line_no"))).alias("entity_id"), role_for_type(F.col("amount_role"), F.col("doc_type")).alias("amount_role"),
        parse_amount(F.col("raw")).cast("decimal(18,2)").alias("amount_value"), F.col("currency").alias("amount_currency"), F.floor(F.col("chunk_index") / 2).cast("int").alias("source_page"), "txn_ref", "txn_date",
        F.when(F.col("doc_type").isin(*ANCHORED), F.col("reference")).alias("anchor_id"),
    ).where("amount_value is not null")


def linked(docs: DataFrame, chunks: DataFrame, amounts: DataFrame) -> DataFrame:
    """(audit_id, txn_ref): statement rows that name one of the audit's contracts or invoices. chunks: with their documents (about)."""
    lines = chunks.where("about.doc_type = 'bank_statement'").select("about.audit_id", F.explode(F.split("text", "\n")).alias("line"))
    named = docs.where(F.col("doc_type").isin(*ANCHORED) & F.col("reference").isNotNull()).select("audit_id", F.col("reference").alias("identifier"))
    return snapshot.linked_refs(lines, snapshot.identifier_cores(named), amounts.where("doc_type = 'bank_statement'").select("audit_id", "txn_ref"))


def pair_findings(assessed: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings out of contradictions as a hook has assessed them: severity, and the two lines that hold the amounts as evidence."""
    name = lambda k: docs.select("audit_id", F.col("doc_id").alias(f"doc_id{k}"), F.col("filename").alias(f"name{k}"))
    rows = assessed.where("is_contradiction").join(name(1), ["audit_id", "doc_id1"], "left").join(name(2), ["audit_id", "doc_id2"], "left")
    money = lambda k: F.format_number(F.col(f"amount_value{k}").cast("double"), 2)
    said = lambda k: evidence.cited(F.coalesce(f"name{k}", f"doc_id{k}"), F.lit(None).cast("int"), money(k))
    code: Column = F.coalesce("amount_currency1", "amount_currency2", F.lit(snapshot.DEFAULT_CURRENCY))
    return rows.select(
        "audit_id", F.concat_ws(">", "entity_id1", "entity_id2").alias("finding_id"), "severity", F.lit(0.8).alias("confidence"), F.lit("graph").alias("source"),
        F.concat(F.lit("Amounts differ: "), F.coalesce("reason", F.lit("amount"))).alias("title"), F.concat(code, F.lit(" "), money(1), F.lit(" against "), code, F.lit(" "), money(2), F.lit(".")).alias("description"),
        F.col("doc_id1").alias("source_doc_id"), F.col("doc_id2").alias("conflicting_doc_id"), F.array(said(1), said(2)).alias("evidence"),
    )


@dataclass
class Audit:
    """What is known of the audits after each step: documents, chunks (doc_id, chunk_index, page, text, and about of their documents) and amounts; the rest is made when it is asked for."""

    engine: Engine
    documents: DataFrame
    chunks: DataFrame
    amounts: DataFrame
    triage: DataFrame | None = None

    @cached_property
    def snapshot(self) -> DataFrame:
        return self.engine.snapshot(self.amounts, snapshot.anchor_rows(self.amounts), linked(self.documents, self.chunks, self.amounts))

    @cached_property
    def findings(self) -> DataFrame:
        many = self.documents.groupBy("audit_id").agg(F.count("*").alias("n")).where("n > 1").select("audit_id")
        shared = self.amounts.join(many, "audit_id", "left_semi")
        graph = pair_findings(self.engine.contradictions(shared), self.documents)
        return stored(self.engine.cross_check({"graph": graph, "reference": evidence.reference_findings(self.engine.references(shared), self.documents)}), "findings")

    @cached_property
    def report(self) -> DataFrame:
        # an audit without findings is reported too
        every = self.documents.select("audit_id").distinct().join(self.engine.report(self.findings, self.triage), "audit_id", "left")
        every = every.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("critical", "warnings", "findings")}).withColumn("overall_risk", F.coalesce("overall_risk", F.lit("clean")))
        return self.engine.hooks.summarise(every.drop("summary"))


def audit(engine: Engine, pages: DataFrame, triage: DataFrame | None = None, partitions: int | None = None) -> Audit:
    """Everything from pages (audit_id, doc_id, filename, page, text) on. Audits of one document have a snapshot, and no cross-check. Null texts are empty; pages without audit_id,
    doc_id or page are left out; a page that comes twice is read twice. No pages give no rows anywhere. partitions: how many the pages are dealt to."""
    kept = pages.where("audit_id is not null and doc_id is not null and page is not null")
    docs = stored(read_documents(engine, dealt(kept, partitions, "audit_id", "doc_id")), "documents")
    own = pages_of(docs)
    # registers are put together from their lines, so once; other texts are read where they lie
    chunks = plain_chunks(own).unionByName(stored(register_chunks(own), "registers"))
    docs = docs.drop("pages")
    return Audit(engine, docs, chunks, stored(read_amounts(engine, docs, chunks), "amounts"), triage)
