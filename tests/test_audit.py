"""An audit from pages to its report, on a few documents whose figures are known."""

import re

from tallyweave import audit as W
from tallyweave.audit import audit, read_chunks
from tallyweave.engine import Engine
from tallyweave.hooks import Hooks
from tallyweave.operators import snapshot as S
from tallyweave.operators.extraction import rule_entities

CONTRACT = "Service Agreement\nNumber: CTR-2024-0041\nContract value: EGP 200,000.00"
INVOICE = "Tax Invoice\nfor CTR-2024-0041\nSubtotal: EGP 155,000.00\nVAT: EGP 21,700.00\nTotal due: EGP 176,800.00"
BANK = """Bank statement in EGP
[TABLE ROW] 01/02/2025 | TXN-00000001 | opening | 10.00 | 900,000.00
[TABLE ROW] 05/02/2025 | TXN-00000002 | for CTR-2024-0041 | 50,000.00 | 850,000.00
[TABLE ROW] 09/02/2025 | TXN-00000003 | for CTR-2024-0041 | 176,700.00 | 673,300.00
[TABLE ROW] 11/02/2025 | TXN-00000004 | salaries | 18,000.00 | 655,300.00
[TABLE ROW] 12/02/2025 | TXN-00000005 | refund of CTR-2024-0041 | 1,000.00 | 656,300.00"""
FLAT = "Bank statement\nDebit\nCredit\nBalance\n05/01/2025\nTXN-00000002\n50,000.00\n750,000.00\n12/01/2025\nTXN-00000003\n75,000.00\n675,000.00\n20/01/2025\nTXN-00000004\n120,000.00\n555,000.00"
SCHEMA = "audit_id long, doc_id string, filename string, page int, text string"


def test_from_pages_to_report(spark):
    pages = [
        (1, "c1", "c1.pdf", 1, CONTRACT), (1, "i1", "i1.pdf", 1, INVOICE), (1, "b1", "b1.pdf", 1, BANK), (2, "c2", "c2.pdf", 1, CONTRACT), (3, "c3", "c3.pdf", 1, CONTRACT), (3, "c4", "c4.pdf", 2, "Contract value: EGP 200,000.00"), (3, "c4", "c4.pdf", 1, "Agreement CTR-2024-0041"),
        (4, "x", "scan.pdf", 1, None), (None, "y", "y.pdf", 1, CONTRACT), (5, "z", "z.pdf", None, CONTRACT),
    ]
    out = audit(Engine(spark), spark.createDataFrame(pages, SCHEMA).repartition(3))
    assert {r.doc_id: (r.doc_type, r.page_count, r.currency, r.reference) for r in out.documents.collect()} == {
        "c1": ("contract", 1, "EGP", "ctr20240041"), "i1": ("invoice", 1, "EGP", "ctr20240041"), "b1": ("bank_statement", 1, "EGP", "ctr20240041"), "c2": ("contract", 1, "EGP", "ctr20240041"), "c3": ("contract", 1, "EGP", "ctr20240041"), "c4": ("contract", 2, "EGP", "ctr20240041"), "x": ("unknown", 1, None, None),
    }
    snap = {r.audit_id: r for r in out.snapshot.collect()}
    one = snap[1]
    assert (one.contract_total, one.invoice_total, one.bank_paid_total, one.variance_vs_contract) == (200_000.0, 176_800.0, 226_700.0, 26_700.0)
    assert one.integrity_warnings == "i1.pdf: subtotal 155,000.00 + VAT 21,700.00 = 176,700.00, stated total 176,800.00"
    assert (snap[2].contract_total, snap[2].bank_paid_total) == (200_000.0, None) and snap[3].contract_total == 200_000.0 and 4 not in snap
    titles = {(r.audit_id, r.title, r.source_doc_id, r.conflicting_doc_id) for r in out.findings.collect()}
    assert {(a, frozenset((s, c))) for a, _, s, c in titles} == {(1, frozenset(("c1", "i1")))}
    assert any("contract total vs invoice total" in t for _, t, _, _ in titles)
    report = {r.audit_id: r for r in out.report.collect()}
    assert set(report) == {1, 2, 3, 4} and report[1].overall_risk in ("critical", "high") and report[1].summary.startswith(f"{report[1].findings} findings")
    assert {(report[a].overall_risk, report[a].findings) for a in (2, 3, 4)} == {("clean", 0)}


def test_flattened_registers_become_rows(spark):
    pages = spark.createDataFrame([(1, "b", "b.pdf", 3, FLAT), (1, "c", "c.pdf", 1, CONTRACT), (1, "d", "d.pdf", 1, " ")], SCHEMA)
    got = {(r.doc_id, r.chunk_index): r.text for r in read_chunks(pages).collect()}
    assert set(got) == {("b", 6), ("b", 7), ("c", 2)} and got["c", 2] == CONTRACT
    assert got["b", 7].split("\n")[1] == "[TABLE ROW] 12/01/2025 | TXN-00000003 | 75,000.00 | 675,000.00" and got["b", 6].startswith("Bank statement")


def test_no_pages(spark):
    out = audit(Engine(spark), spark.createDataFrame([], SCHEMA))
    assert [f.count() for f in (out.documents, out.chunks, out.amounts, out.snapshot, out.findings, out.report)] == [0] * 6


def test_a_snapshot_writes_and_moves_what_it_needs(spark, monkeypatch):
    """Findings were written for a snapshot too, pages were read twice and their texts joined three times, and amounts joined to their documents: most of the disk at size."""
    written, stored = [], W.stored
    monkeypatch.setattr(W, "stored", lambda df, what: written.append(what) or stored(df, what))
    pages = spark.createDataFrame([(1, "c1", "c1.pdf", 1, CONTRACT), (1, "i1", "i1.pdf", 1, INVOICE), (1, "b1", "b1.pdf", 1, BANK)], SCHEMA)
    out = audit(Engine(spark), pages, partitions=3)
    assert out.snapshot.count() == 1 and written == ["documents", "registers", "amounts"]
    assert out.findings.count() > 0 and out.report.count() == 1 and written[3:] == ["findings"]
    plain = W.plain_chunks(W.pages_of(W.read_documents(Engine(spark), pages)))
    plan = W.read_amounts(Engine(spark), out.documents, plain)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    texts = W.plain_chunks(W.pages_of(stored(W.read_documents(Engine(spark), pages), "documents")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in texts


def test_documents_of_two_audits_with_one_id(spark):
    """Amounts were joined to documents by their id alone, and went to both audits."""
    pages = [(1, "c", "one.pdf", 1, CONTRACT), (2, "c", "two.pdf", 1, CONTRACT.replace("200,000", "300,000")), (1, "b", "b.pdf", 1, FLAT), (2, "b", "b.pdf", 1, FLAT.replace("TXN", "REF"))]
    frame = spark.createDataFrame(pages, SCHEMA)
    out = audit(Engine(spark), frame)
    assert {r.audit_id: r.contract_total for r in out.snapshot.collect()} == {1: 200_000.0, 2: 300_000.0}
    assert {(r.audit_id, r.filename) for r in out.amounts.where("doc_id = 'c'").collect()} == {(1, "one.pdf"), (2, "two.pdf")}
    assert {(r.audit_id, r.txn_ref) for r in out.amounts.where("doc_id = 'b' and txn_ref is not null").collect()} == {(a, f"{w}-0000000{k}") for a, w in ((1, "TXN"), (2, "REF")) for k in (2, 3, 4)}
    # a hook that knows nothing of a chunk but its document and text
    own = Hooks(entities=lambda chunks: rule_entities(chunks.select("doc_id", "chunk_index", "text")))
    one = audit(Engine(spark, own), frame.where("audit_id = 1"))
    assert one.snapshot.collect() == out.snapshot.where("audit_id = 1").collect()


def test_only_what_may_be_a_reference_is_cut(spark):
    """Every substring of a reference's length was moved to the references."""
    refs = ["7", "A-1", "TXN-000041", "TXN-000042", "77", "فاتورة"]
    lines = ["CTR-2024-0041 paid by TXN-000041", "nothing of TXN-000042", "a1 CTR 2024 0041", "ctr20240041 7", "TXN-00004 CTR-2024-0041"]
    core = lambda x: re.sub("[^a-z0-9]+", "", x.lower())
    want = {r for r in refs for x in lines if "ctr20240041" in core(x) and core(r) and core(r) in core(x)}
    frames = spark.createDataFrame([(1, x) for x in lines], "audit_id long, line string"), spark.createDataFrame([(1, "ctr20240041")], "audit_id long, core string"), spark.createDataFrame([(1, r) for r in refs], "audit_id long, txn_ref string")
    found = S.linked_refs(*frames)
    assert {r.txn_ref for r in found.collect()} == want and want == {"7", "A-1", "TXN-000041"}
    assert "array_contains" in found._jdf.queryExecution().optimizedPlan().toString()
