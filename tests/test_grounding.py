from decimal import Decimal

from pyspark.sql import functions as F

from tallyweave.functions import money as M
from tallyweave.operators import grounding as K

FINDING = "audit_id long, finding_id string, severity string, title string, description string, evidence array<string>"


def test_amounts_and_roles(spark):
    text = "The contract is EGP 1,234.50; the bank paid 5,000 USD"
    (found,) = spark.createDataFrame([(text,)], "t string").select(M.amounts_in(F.col("t"))).first()
    assert [(a.value, a.position) for a in found] == [(1234.5, text.index("EGP")), (5000.0, text.index("5,000"))]
    assert found[1].before == text[max(0, text.index("5,000") - 50) : text.index("5,000")]
    cases = [("the contract, then the invoice of ", "invoice_total"), ("INVOICE for the contract ", "contract_total"), ("bank paid ", "bank_paid_total"), ("nothing ", None)]
    frame = spark.createDataFrame(cases, "w string, r string")
    assert all(x[0] == x[1] for x in frame.select(K.role_before(F.col("w")), "r").collect())


def test_gaps(spark):
    snap = spark.createDataFrame(
        [(1, None, 5.0, None, None, True, "Withheld."), (2, 10.0, None, None, None, False, ""), (3, 1.0, 1.0, 1.0, 0.0, False, "")],
        "audit_id long, contract_total double, invoice_total double, bank_paid_total double, variance_vs_contract double, bank_extraction_incomplete boolean, notes string",
    )
    said = [(1, "f", "critical", "Contract of EGP 2,000", "bank paid EGP 3,000", []), (2, "f", "critical", "x", "bank paid EGP 3,000 and invoice EGP 999", []), (3, "f", "critical", "Contract EGP 9,000", None, []), (2, "g", "warning", "invoice EGP 7,000", None, [])]
    got = {r.audit_id: r for r in K.fill_gaps(snap, K.label_amounts(spark.createDataFrame(said, FINDING))).collect()}
    assert (got[1].contract_total, got[1].bank_paid_total, got[1].notes) == (2000.0, None, "Withheld. Inferred from labeled finding text: contract.")
    assert (got[2].bank_paid_total, got[2].invoice_total, got[2].variance_vs_contract) == (3000.0, None, 2990.0)
    assert got[3].contract_total == 1.0 and got[3].notes == ""


def test_conflicts_name_the_documents(spark):
    docs = spark.createDataFrame([(1, "C", "contract", "c.pdf"), (1, "I", "invoice", "i.pdf"), (1, "B", "bank_statement", "b.pdf")], "audit_id long, doc_id string, doc_type string, filename string")
    amounts = spark.createDataFrame([(1, "I", Decimal("5000")), (1, "C", Decimal("7000")), (1, "B", Decimal("7000"))], "audit_id long, doc_id string, amount_value decimal(18,2)")
    rows = [
        (1, "quoted", "critical", "EGP 9,000 against EGP 5,000", "", ["b.pdf p1: paid 9,000.00"]),
        (1, "difference", "critical", "EGP 5,000 is off by EGP 1,111", "", ["none"]),
        (1, "shared", "warning", "EGP 7,000 and EGP 5,000", None, None),
        (1, "ok", "ok", "EGP 9,000 against EGP 5,000", "", ["b.pdf p1: paid 9,000.00"]),
    ]
    got = K.finding_conflicts(spark.createDataFrame(rows, FINDING), docs, amounts).collect()
    assert [(r.finding_id, r.doc_a_id, r.doc_a_value, r.doc_b_id, r.doc_b_value, r.conflict_type) for r in got] == [("quoted", "I", "5,000.00", "B", "9,000.00", "invoice vs bank statement (from finding)")]


def test_json_and_fences(spark):
    noisy = {
        'x {"a": "}"} y': '{"a": "}"}', "{'q': {1}} {": None, None: None, "none": None, "": None, "{": None, '{"a": 1': None,
        'so {not json} but {"b": [1, {"c": "\\"}{"}]} and {"d": 2}': '{"b": [1, {"c": "\\"}{"}]}', '```json\n{"k": {"l": {"m": {}}}}\n``` {open': '{"k": {"l": {"m": {}}}}', "{{{{ " * 50 + '{"z": 0}': '{"z": 0}',
    }
    frame = spark.createDataFrame(list(noisy.items()), "t string, want string")
    assert all(r.got == r.want for r in frame.select(K.json_object(F.col("t")).alias("got"), "want").collect())
    long = '{"k": "' + "x{" * 100_000 + '", "n": [' + ",".join(["1"] * 100_000) + "]}"
    assert spark.createDataFrame([("noise " + long,)], "t string").select(K.json_object(F.col("t"))).first()[0] == long
    rows = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), (" plain ",)], "t string")
    assert [r[0] for r in rows.select(K.unfenced(F.col("t"))).collect()] == ['{"a": 1}', "plain"]


def test_objects_at_any_depth(spark):
    deep = lambda n: '{"a}": [' * n + '{"z": "\\"{"}' + "]}" * n
    texts = [("noise { " + deep(n) + " } {", deep(n)) for n in (1, 5, 12, 200, 400)] + [('{"a": NaN} {"b": 1}', '{"b": 1}'), ('x { it"s {"a": 1}', '{"a": 1}')]
    rows = spark.createDataFrame(texts, "t string, want string").select(K.json_object(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_marks_in_a_text_keep_their_places(spark):
    said = spark.createDataFrame([("a\x01\x02b EGP 5 c\x02 7 USD",)], "t string")
    found = said.select(M.amounts_in(F.col("t")).alias("a")).first().a
    assert [(x.position, x.end, x.value) for x in found] == [(5, 10, 5.0), (14, 19, 7.0)]


def test_texts_are_dealt_however_orders_lie(spark, sf_dir, monkeypatch):
    """A table in one piece was searched by one task."""
    from tallyweave.plans import catalog_text

    monkeypatch.setattr(catalog_text, "TEXTS", 20)
    n = catalog_text.said(spark, sf_dir, True)
    assert n.rdd.getNumPartitions() == -(-n.count() // 20) and n.count() == catalog_text.said(spark, sf_dir).count()


def test_amounts_are_tried_where_one_may_begin(spark):
    """Numbers from their first digit, tokens where their first characters stand; the text is translated only where it has to be, and looked at once."""
    texts = {"12,345.50EGP": [12345.5], "1,2345 EGP": [2345.0], "1234,567 egp": [234567.0], "12,34 LE x": [34.0], "LEx 5": [], "٣٤٥ جنيه و USD۱۲": [345.0, 12.0], "EGP 5 USD": [5.0, 5.0], "ref 5 EGP, contract # 7 USD": [], "5.EGP": [], "١،٢٣٤ ريال": [1234.0], None: []}
    rows = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, want array<double>").select("t", "want", M.tagged_amounts(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in rows.collect()] == [(r.t, r.want) for r in rows.collect()]
    assert [list(r.v) for r in rows.select(M.scan_amounts(F.concat("t", F.lit(" ,. 999 ,1000, ..2500.5 2024 ٩٩٩٩"))).alias("v")).limit(1).collect()] == [[12345.5, 1000.0, 2500.5, 9999.0]]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(lambda") + plan.count("translate(namedlambda") >= 1 and "translate(coalesce(" not in plan


def test_role_words_are_looked_for_once(spark):
    """The nearest word of 14 by one pattern, not by a search for each of them, which made most of the work of label_amounts()."""
    windows = {"the contract says the bank paid": "bank_paid_total", "billed under the contract of ": "contract_total", "nothing": None, "Bank Paid": "bank_paid_total", "": None, "دفع ثم عقد": "contract_total", "transfer\nof the invoice": "invoice_total"}
    rows = spark.createDataFrame(list(windows.items()), "w string, role string").select(K.role_before(F.col("w")).alias("got"), "role")
    assert all(r.got == r.role for r in rows.collect())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 1
