"""Checks decided by rules over their snippets."""

import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from tallyweave.engine import Engine
from tallyweave.hooks import Hooks
from tallyweave.operators import adjudication as A
from tallyweave.operators import pairs as P
from tallyweave.plans import catalog

HITS = "audit_id int, check_no int, doc_id string, position int, page int, text string"
DOCS = "audit_id int, doc_id string, filename string, doc_type string"


def found(spark, hits, docs, checks=((1, 1, "amount_match"),), engine=None, **more):
    frames = spark.createDataFrame(list(checks), "audit_id int, check_no int, check_type string"), spark.createDataFrame(docs, DOCS), spark.createDataFrame(hits, HITS)
    return (engine or Engine(spark)).adjudicate(*frames, **more)


def test_comparable_amounts_that_differ(spark):
    docs = [(1, "c", "deal.pdf", "contract"), (1, "i", None, "invoice"), (1, "j", "other.pdf", "invoice"), (1, "b", "bank.pdf", "bank_statement")]
    hits = [
        (1, 1, "c", 1, 3, "CTR-2024-001\nContract value: EGP 10,000.00"),
        (1, 1, "i", 2, None, " about CTR 2024 001\nTotal due: EGP 12,000.00\nVAT: 5.00"),
        (1, 1, "j", 3, 1, "of CTR-2024-777\nTotal due: EGP 99,000.00"),
        (1, 1, "j", 4, 2, "no number\nTotal due: USD 50,000.00"),
        (1, 1, "b", 5, 1, "a statement\nTotal due: EGP 70,000.00"),
        (1, 1, "i", 6, 9, " about CTR 2024 001\nTotal due: EGP 12,000.00\nVAT: 5.00"),
        (1, 1, "i", 7, 1, None),
        (1, 1, "i", 8, 1, "  "),
        (2, 1, "z", 1, 1, "alone\nTotal due: EGP 1.00"),
    ]
    rows = found(spark, hits, docs).collect()
    # another contract, another currency, a role that a statement can't carry, and the same snippet again give nothing
    assert [(x.source_doc_id, x.conflicting_doc_id, x.severity, x.title) for x in rows] == [("c", "i", "critical", "Amounts differ: contract total vs invoice total")]
    assert rows[0].description == "One document has 10,000.00, another 12,000.00."
    assert rows[0].evidence == ["deal.pdf, page 3: CTR-2024-001\nContract value: EGP 10,000.00", "document 2, page 0: about CTR 2024 001\nTotal due: EGP 12,000.00\nVAT: 5.00"]
    assert (rows[0].finding_id, rows[0].source, rows[0].confidence) == ("check:1:1", "checklist", 0.75)


def test_most_material_first_and_bounds(spark):
    docs = [(a, f"d{i}", f"d{i}.pdf", "invoice") for a in (1, 2) for i in range(30)] + [(2, "s", "s.pdf", "bank_statement")]
    hits = [(a, n, f"d{i}", i, 1, f"text {i}\nInvoice total: EGP {1000 + i * i:,}.00") for a in (1, 2) for n in (1, 2) for i in range(30)]
    checks = [(1, 1, "amount_match"), (1, 2, "self_reference"), (2, 1, "amount_match"), (3, 1, "date_consistency")]
    rows = found(spark, hits, docs, checks).orderBy("audit_id", "finding_id").collect()
    # fourteen snippets are read; the widest gaps are between the first ones and the last ones
    want = sorted(((j * j - i * i, i, j) for i in range(14) for j in range(i + 1, 14)), key=lambda x: (-x[0], x[1], x[2]))[:4]
    for audit in (1, 2):
        assert [(x.source_doc_id, x.conflicting_doc_id) for x in rows if x.audit_id == audit] == [(f"d{i}", f"d{j}") for _, i, j in want]
    assert {x.check_no for x in rows} == {1}


def test_same_amounts_are_one_finding_and_reports_take_them(spark):
    docs = [(1, f"d{i}", f"d{i}.pdf", "invoice") for i in range(4)]
    hits = [(1, 1, f"d{i}", i, 1, f"text {i}\nInvoice total: EGP {9000 if i % 2 else 1000:,}.00") for i in range(4)]
    engine = Engine(spark)
    rows = found(spark, hits, docs, engine=engine)
    assert [(x.source_doc_id, x.conflicting_doc_id) for x in rows.collect()] == [("d0", "d1")]
    phases = engine.cross_check({"checklist": rows})
    assert [(x.critical, x.findings) for x in engine.report(phases).collect()] == [(1, 1)]


def test_nothing_to_decide(spark):
    docs = [(1, "a", "a.pdf", "invoice"), (1, "b", "b.pdf", "invoice")]
    assert found(spark, [], docs).count() == 0
    assert found(spark, [(1, 1, "a", 1, 1, "Total due: EGP 5.00")], []).count() == 0
    assert found(spark, [(1, 1, "a", 1, 1, "Total due: EGP 500.00"), (1, 1, "b", 2, 1, "Total due: EGP 900.00")], docs, [(1, 1, "party_match")]).count() == 0
    # the rules give way to a hook
    quiet = Engine(spark, Hooks(adjudicate=lambda checks, snippets: A.rule_adjudication(checks.where("false"), snippets)))
    assert found(spark, [(1, 1, "a", 1, 1, "Total due: EGP 500.00"), (1, 1, "b", 2, 1, "Total due: EGP 900.00")], docs, engine=quiet).count() == 0


def test_texts_and_amounts_are_moved_few_times(spark):
    hits = spark.createDataFrame([(1, 1, "a", 1, 1, "Total due: EGP 500.00"), (1, 1, "b", 2, 1, "Total due: EGP 900.00")], HITS)
    docs = spark.createDataFrame([(1, "a", "a.pdf", "invoice"), (1, "b", "b.pdf", "invoice")], DOCS)
    hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        snippets = A.snippets_of(hits, docs)
        moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", snippets._jdf.queryExecution().executedPlan().toString())
        # hits to their documents, and to their checks; documents once, beside them
        assert len(moved) == 3
        rows = Engine(spark).adjudicate(spark.createDataFrame([(1, 1, "amount_match")], "audit_id int, check_no int, check_type string"), docs, hits)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        # both sides of the pairs, and what is cited of a check: no exchange has an amount's role or a snippet's number
        assert not re.search(r"hashpartitioning\([^)]*(?:role|snippet_no)", plan)
        assert rows.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)


def test_all_snippets_are_read_whole(spark):
    """The first 14 snippets of a check were read, 900 characters of each, and of those that begin alike one."""
    docs = [(1, f"d{i}", f"d{i}.pdf", "invoice") for i in range(30)]
    head = "word " * 300
    hits = [(1, 1, f"d{i}", i, 1, f"text {i}\n{head}\nInvoice total: EGP {1000 + i * i:,}.00") for i in range(30)] + [(1, 1, "d0", 99, 2, f"text 0\n{head}\nInvoice total: EGP 9.00")]
    rows = found(spark, hits, docs, most=None).orderBy("finding_id").collect()
    values = [(1000 + i * i, i, f"d{i}") for i in range(30)] + [(9, 30, "d0")]
    want = sorted(((abs(b - a), i, j, c, d) for a, i, c in values for b, j, d in values if i < j and c != d), key=lambda x: (-x[0], x[1], x[2]))[:4]
    assert [(x.source_doc_id, x.conflicting_doc_id) for x in rows] == [x[3:] for x in want] and rows[0].description == "One document has 1,841.00, another 9.00."


LABELS = {"Contract value": "total_contract_value", "Invoice total": "total_invoice", "Subtotal": "invoice_subtotal", "Retainer": "retainer"}


def told(snippets, most):
    """What rule_adjudication() finds in (no, doc, reference, currency, [(role, value)]), of all pairs."""
    reasons, first = P._reasons(), {}
    rows = [(n, doc, ref, cur, role, value) for n, doc, ref, cur, own in snippets for role, value in own]
    for n1, d1, r1, c1, k1, v1 in rows:
        for n2, d2, r2, c2, k2, v2 in rows:
            if n1 < n2 and d1 != d2 and (k1, k2) in reasons and (not r1 or not r2 or r1 == r2) and (not c1 or not c2 or c1 == c2) and abs(v1 - v2) > max(v1, v2) * Decimal("0.0001") + Decimal("0.01"):
                key, seen = (*sorted((v1, v2)), reasons[k1, k2]), (n1, n2, k1, v1, v2, d1, d2)
                first[key] = min(first.get(key, seen), seen)
    ranked = sorted((-abs(x[3] - x[4]), x[0], x[1], key[2], x[3], *x[4:]) for key, x in first.items())[:most]
    return [(f"Amounts differ: {x[3]}", x[6], x[7], x[1], x[2], f"One document has {x[4]:,.2f}, another {x[5]:,.2f}.") for x in ranked]


def test_the_same_as_of_all_pairs(spark):
    """Amounts with and without numbers and currencies, of many snippets and few documents: values that one document has alone, or several, and gaps that are equal."""
    r, hits, docs, want = random.Random(5), [], [], {}
    for audit in range(1, 25):
        n_docs, steps, refs = r.choice([2, 3, 12]), r.choice([6, 40, 1000]), r.choice([[""], ["CTR-2024-001", "CTR-2024-002"], ["", "CTR-2024-001", "CTR-2024-002", "CTR-2024-003"]])
        docs += [(audit, f"d{i}", f"d{i}.pdf", "invoice") for i in range(n_docs)] + ([(audit, "s", "s.pdf", "bank_statement")] if audit % 3 == 0 else [])
        own, codes, labels = [], r.choice([[""], ["EGP"], ["", "EGP", "USD"]]), r.choice([sorted(LABELS), ["Invoice total"]])
        for n in range(1, 81):
            # some audits have a document with all of the lowest values
            doc, ref, cur = r.randrange(n_docs), r.choice(refs), r.choice(codes)
            low = 0 if doc == 0 and audit % 2 else 1000
            amounts = [(label, Decimal(low + r.randrange(steps) * 5 + 100)) for label in r.sample(labels, min(len(labels), r.choice([1, 1, 3])))]
            own.append((n, f"d{doc}", ref, cur, [(LABELS[label], v) for label, v in amounts]))
            hits.append((audit, 1, f"d{doc}", n, 1, "\n".join([f"snippet {n}.", f"about {ref}", *(f"{label}: {cur} {v:,}.00" for label, v in amounts)])))
        want[audit] = told(own, 1 if audit % 3 == 0 else 4)
    checks = spark.createDataFrame([(a, 1, "amount_match", "bank" if a % 3 == 0 else "") for a in want], "audit_id int, check_no int, check_type string, intents string")
    got = Engine(spark).adjudicate(checks, spark.createDataFrame(docs, DOCS), spark.createDataFrame(hits, HITS), None)
    number = lambda k: F.regexp_extract(F.col("evidence")[k], r"snippet (\d+)\.", 1).cast("int")
    rows = got.select("audit_id", "finding_id", "title", "source_doc_id", "conflicting_doc_id", number(0), number(1), "description").orderBy("audit_id", "finding_id").collect()
    assert len(rows) > 50 and {a: [tuple(x)[2:] for x in rows if x.audit_id == a] for a in want} == want


def test_amounts_are_not_all_paired(spark):
    """Values of one document below and above those of others, each of them different: a check's pairs are of a few of them."""
    rows = [(1, 1, 4, "", None, "total_invoice", Decimal(v), f"d{v % 3 if 200 < v < 800 else 0}", v) for v in range(1, 1001)]
    frame = spark.createDataFrame(rows, "audit_id int, check_no int, most int, reference string, currency string, role string, value decimal(18,2), doc_id string, snippet_no int")
    kept = {int(x.value) for x in A.outermost(frame, "reference", "currency", "role").collect()}
    assert len(kept) <= 2 * 4 * 5 and {1, 2, 3, 4, 997, 998, 999, 1000} <= kept and {x for x in kept if x % 3} & set(range(200, 210)) and {x for x in kept if x % 3} & set(range(790, 800))


def test_findings_beyond_the_first_snippets(spark, sf_dir):
    """Invoices that overstate their total are found wherever they stand among an audit's documents."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    billed = {x.o_orderkey: (x.o_custkey, Decimal(str(x.o_totalprice))) for x in orders.where("o_custkey is not null").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").collect()}
    want = {k: c for k, (c, price) in billed.items() if k % 7 == 0 and 100 > (price + 100) * Decimal("0.0001") + Decimal("0.01")}
    rows = catalog.QUERIES["checklist_findings"](spark, sf_dir).where("finding_id like 'check:4:%'").collect()
    some = {c: sorted(k for k in want if want[k] == c)[:4] for c in set(want.values())}
    assert {c: sorted(int(x.source_doc_id[9:]) for x in rows if x.audit_id == c) for c in some} == some
