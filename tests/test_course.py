"""Operators over evidence, extraction and the course of an audit, on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from tallyweave.engine import Engine
from tallyweave.functions import money as M
from tallyweave.functions import text as T
from tallyweave.operators import control as C
from tallyweave.operators import documents as D
from tallyweave.operators import evidence as E
from tallyweave.operators import extraction as X
from tallyweave.operators import pairs as P
from tallyweave.operators import retrieval as R
from tallyweave.sources import files, store


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_amounts_in_text(spark):
    cases = {
        "Total EGP 1,234.50 and 5,000 USD": [1234.5, 5000.0],
        "ref: 2024 EGP": [],
        "invoice # 77, EGP 1,000": [],
        "عقد رقم 12 جنيه": [],
        "المبلغ ٥٠٬٠٠٠": [],
        "دفع ٧٥ جنيه": [75.0],
        "USD 2024": [2024.0],
        "no money 5,000": [],
        "": [],
        None: [],
    }
    got = values(spark, [(t,) for t in cases], "t string", M.tagged_amounts(F.col("t")))
    assert got == list(cases.values())
    text = "x" * 200 + " EGP 5 " + "y" * 30 + " EGP 6"
    (found,) = values(spark, [(text,)], "t string", M.amounts_in(F.col("t")))
    assert [(a.position, a.end, a.before) for a in found] == [(i, i + 5, text[max(0, i - 50) : i]) for i in (201, text.rindex("EGP"))]


def test_evidence(spark):
    rows = [("c.pdf, page 2: EGP 1,000.00", "1000"), ("c.pdf: 1,000.01 USD", "EGP 1,000.00"), ("c.pdf: 1,000.02 USD", "1,000"), ("EGP 7", "seven"), (None, "7"), ("paid 5 USD: 6 USD and 7 USD", "7 USD")]
    assert values(spark, rows, "l string, r string", E.line_backs(F.col("l"), F.col("r"))) == [True, True, False, False, False, True]
    ev = [(["a: EGP 5", "b: 6 USD"], 5.0, 6.0), (["a: EGP 5"], 5.0, 6.0), (None, 5.0, 6.0)]
    assert values(spark, ev, "e array<string>, a double, b double", E.snippets_back(F.col("e"), F.col("a"), F.col("b"))) == [True, False, False]
    assert values(spark, [([],)], "e array<string>", E.snippets_back(F.col("e"))) == [True]
    docs = [("bank_statement", None), (None, "My STMT.pdf"), ("contract", "c.pdf"), (None, None)]
    assert values(spark, docs, "t string, f string", E.is_bank_document(F.col("t"), F.col("f"))) == [True, True, False, False]
    assert values(spark, [("doc-12345678-9", None), ("d", "a.pdf")], "i string, f string", E.short_label(F.col("i"), F.col("f"))) == ["doc-1234…", "a.pdf"]


def test_unparsed_amounts_differ_by_their_text(spark):
    rows = [(1.0, 1.0, "a", "b"), (None, 1.0, "A ", "a"), (None, None, "x", "y"), (None, 1.0, None, "y"), (100.0, 200.0, "a", "a")]
    assert values(spark, rows, "a double, b double, s string, t string", P.materially_different(F.col("a"), F.col("b"), F.col("s"), F.col("t"))) == [False, False, True, False, True]
    pairs = [("EGP", "egp "), ("EGP", "USD"), (None, "USD"), ("", "USD")]
    assert values(spark, pairs, "a string, b string", P.same_currency(F.col("a"), F.col("b"))) == [True, False, True, True]


def test_tables_and_types(spark):
    rows = [([["Date", "Amount"], ["1", "2"]],), ([["Date 2024", "x"], ["1,000", "2"]],), ([["a", "1,000"], ["b", "2.50"]],), ([["Date"]],), ([["note", "1.00"], [None, "x"], ["y", "2,000"], ["z", "w"]],)]
    assert values(spark, rows, "r array<array<string>>", D.is_tabular(F.col("r"))) == [True, False, True, False, True]
    assert values(spark, [(["TXN-", "003", "x", "y-", "-z"],)], "c array<string>", D.join_cells(F.col("c"))) == ["TXN-003 | x | y- | -z"]
    text = "amount total vat tax 100 200 300 400 500"
    assert values(spark, [(text,), (text + " debit",), (text[:-4],), (None,)], "t string", T.finance_type(F.col("t"))) == ["invoice", "bank_statement", None, None]
    assert values(spark, [("plain words",), (text,)], "t string", T.vocabulary_type(F.col("t"), F.lit("x.pdf"))) == ["unknown", "invoice"]


def test_rules_read_statements(spark):
    text = "Opening balance: 1,000.00\n[TABLE ROW] columns: date | ref | amount 1.00\n[TABLE ROW] 05/01/2025 | TXN-002 | Advance | 50.00 | 950.00\n[TABLE ROW] 06/01/2025 | TXN-3 | In | 10.00 | 960.00\n[TABLE ROW] 07/01/2025 | fee | 5.00 | 955.00\n[TABLE ROW] no balance 7.00\nno label 9.00"
    rows = X.rule_entities(spark.createDataFrame([("d", 0, text), ("e", 0, None)], "doc_id string, chunk_index int, text string")).orderBy("line_no").collect()
    assert [(r.amount_role, r.raw, r.txn_ref, r.txn_date) for r in rows] == [
        ("opening_balance", "1,000.00", None, None), ("unknown", "50.00", "TXN-002", "05/01/2025"), ("transaction_credit", "10.00", "TXN-3", "06/01/2025"), ("transaction_debit", "5.00", None, "07/01/2025"), ("unknown", "7.00", None, None),
    ]
    assert len(X.ROLES) == len(set(X.ROLES)) == 20 and set(X.BANK_ROLES) < set(X.ROLES)


def test_course(spark):
    states = spark.createDataFrame([(1, 1, "pending"), (1, 2, "processing"), (1, 3, "completed"), (1, 4, "processing"), (2, 1, "completed"), (3, 1, "pending"), (3, 2, "completed")], "audit_id int, seq int, status string")
    assert [r.legal for r in C.legal_states(states).orderBy("audit_id", "seq").collect()] == [True, True, True, False, False, True, False]
    log = spark.createDataFrame([(1, i, t) for i, t in enumerate(["error", "reasoning_step", "complete", "reasoning_step"])], "audit_id int, seq int, event_type string")
    assert [[r.seq for r in C.replay_to_end(log, s).orderBy("seq").collect()] for s in (0, 1, 3)] == [[0], [1, 2], [3]]
    rows = spark.createDataFrame([("b", "x", "1", "warning"), ("a", "y", "1", "critical"), ("a", "x", "1", "warning")], "entity_label string, doc_a_value string, doc_b_value string, severity string")
    assert [(r.severity, r.entity_label) for r in C.by_severity(rows).collect()] == [("critical", "a"), ("warning", "a"), ("warning", "b")]
    assert [r.entity_label for r in C.by_severity(rows, "entity_label", True).collect()] == ["b", "a", "a"] and C.visible(rows, "critical").count() == 1


def test_stores(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "old", 1), ("a", 0, "new", 2), ("b", 0, "x", 1)], "doc_id string, chunk_index int, text string, version int")
    store.store_chunks(chunks, str(tmp_path / "chunks"))
    assert [r.text for r in store.read_chunks(spark, str(tmp_path / "chunks"), ["a"]).collect()] == ["new"] and store.read_chunks(spark, str(tmp_path / "chunks")).count() == 2
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id int, embedding array<double>")
    assert store.check_vectors(vectors.limit(1), 2).count() == 1
    with pytest.raises(Exception, match="2 numbers"):
        store.check_vectors(vectors, 2).collect()
    read = spark.createDataFrame([("a", None), ("b", "broken")], "filename string, error string")
    assert [x.count() for x in store.ingested(read)] == [1, 1]
    with pytest.raises(ValueError, match="b: broken"):
        store.ingested(read.where("error is not null"))
    log = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "audit_id int, seq int")
    store.append_events(log, str(tmp_path / "log"))
    store.append_events(log, str(tmp_path / "log"))
    assert {tuple(r) for r in store.event_counts(store.cleared(spark.read.parquet(str(tmp_path / "log")), log.where("audit_id = 1"))).collect()} == {(2, 2)}
    rows = spark.createDataFrame([("l", "a", "1", "b", "2", "ok", 9)], "entity_label string, doc_a_id string, doc_a_value string, doc_b_id string, doc_b_value string, severity string, extra int")
    files.export_conflicts(rows.coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == "entity_label,doc_a_id,doc_a_value,doc_b_id,doc_b_value,severity\nl,a,1,b,2,ok\n"


def test_search_in_all_ways(spark):
    chunks = spark.createDataFrame([(1, "فاتورة رقم INV 2024 1", "arabic"), (2, "nothing of that", "english"), (3, "the graph", "english")], "doc_id long, text string, language string")
    assert [r.doc_id for r in R.keyword_matches(chunks, "فاتورة", 5).collect()] == [1]
    engine = Engine(spark)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    edges = spark.createDataFrame([("e1", "e3")], "src string, dst string")
    entities = spark.createDataFrame([("e1", 1, "Acme"), ("e3", 3, "Other")], "entity_id string, doc_id long, value string")
    found = engine.search(chunks, "reconcile Acme with INV-2024-1", 9, vectors=vectors, query_vector=[0.0, 2.0], edges=edges, entities=entities).collect()
    assert [(r.source, r.doc_id) for r in found] == [("keyword", 1), ("vector", 2), ("graph", 3)]
    assert [r.doc_id for r in engine.search(chunks, "reconcile Acme with INV-2024-1", 9, language="english", vectors=vectors, query_vector=[0.0, 2.0]).collect()] == [2]
    assert engine.sources(engine.search(chunks, "INV-2024-1")).count() == 1


def test_vectors_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(1)
    made = r.normal(size=(60, 5)).tolist()
    v = spark.createDataFrame([(i, x) for i, x in enumerate(made)] + [(90, [0.0] * 5), (91, [1.0]), (92, None)], "vec_id int, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(i, made[i]) for i in range(5)] + [(8, [0.0] * 5), (9, None)], "query_id int, query array<double>")
    unit = np.array(made) / np.linalg.norm(made, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(5) for j in np.argsort(-(unit @ unit[i]), kind="stable")[:3]}
    for numbers in (10**6, 5):
        assert {(x.query_id, x.vec_id) for x in R.vector_top_k(q, v, 3, numbers).collect()} == want
    assert R.vector_top_k(q.limit(0), v, 3).count() == 0


def test_payload(spark, sf_dir):
    from tallyweave.plans import catalog, catalog_text
    from tallyweave.sources import ledger

    snap, conflicts = Engine(spark).payload(ledger.documents_meta(spark, sf_dir), ledger.amounts(spark, sf_dir), catalog_text.said(spark, sf_dir), *catalog.links(spark, sf_dir))
    assert snap.count() == catalog.QUERIES["snapshot_filled"](spark, sf_dir).count()
    rows = conflicts.collect()
    per = {}
    for r in rows:
        per.setdefault(r.audit_id, []).append((r.position, frozenset((r.doc_a_value, r.doc_b_value))))
    assert rows and max(map(len, per.values())) <= 30 and all(sorted(p for p, _ in v) == list(range(1, len(v) + 1)) for v in per.values())


def test_balances_below_zero_fall_and_rise_like_others(spark):
    """Statements that go below zero, behind a minus or in brackets; a hyphen inside of a word is no sign."""
    rows = ["50.00 | 20.00", "30.00 | -10.00", "40.00 | -50.00", "20.00 | (30.00)", "70.00 | \u2212100.00", "5.00 | REF-95.00"]
    text = "\n".join(f"[TABLE ROW] 0{k}/01/2024 | {r}" for k, r in enumerate(rows, 1))
    found = X.rule_entities(spark.createDataFrame([("d", 0, text)], "doc_id string, chunk_index int, text string")).orderBy("line_no").collect()
    assert [(r.amount_role, r.raw) for r in found] == [("unknown", "50.00"), ("transaction_debit", "30.00"), ("transaction_debit", "40.00"), ("transaction_credit", "20.00"), ("transaction_debit", "70.00"), ("transaction_credit", "5.00")]


def test_amounts_of_a_line_are_searched_once(spark):
    text = "[TABLE ROW] 01/02/2024 | TXN-1 | 50.00 | 900.00\n[TABLE ROW] columns: 1.00\nContract value: EGP 10.00\nnone\nVAT: 2.00 of 9.00"
    frame = X.rule_entities(spark.createDataFrame([("d", 0, text)], "doc_id string, chunk_index int, text string"))
    assert sorted((r.line_no, r.amount_role, r.raw) for r in frame.collect()) == [(0, "unknown", "50.00"), (2, "total_contract_value", "10.00"), (4, "vat_tax", "2.00")]
    # amounts of rows, of labels, and what stands before a row's last one
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3
