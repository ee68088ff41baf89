"""Whole audits: pages rendered from the tables, read, and reconciled."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave import audit as W
from tallyweave import dealing
from tallyweave.engine import Engine
from tallyweave.folders import stored
from tallyweave.plans.catalog import query
from tallyweave.sources import ledger as L


def pages(spark, d):
    """A contract and, where there are lines, an invoice for each order of a customer; an invoice of every seventh order is a hundred too much. Each customer with events has a
    statement, a row for each of its events, of which those of every third name a contract of it."""
    o = L.table(spark, d, "orders").where("o_custkey is not null")
    key = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    net = F.round(price * F.lit(0.8).cast("decimal(2,1)"), 2)
    money = lambda c: F.concat(F.lit("EGP "), F.format_number(c.cast("double"), 2))
    say = lambda *parts: F.concat_ws("\n", *parts)
    number = F.concat(F.lit("CTR-2024-"), key)
    contract = say(F.lit("Service Agreement"), F.concat(F.lit("Number: "), number), F.concat(F.lit("Contract value: "), money(price)))
    total = price + F.when(F.col("o_orderkey") % 7 == 0, 100).otherwise(0)
    invoice = say(F.lit("Tax Invoice"), F.concat(F.lit("for "), number), F.concat(F.lit("Subtotal: "), money(net)), F.concat(F.lit("VAT: "), money(price - net)), F.concat(F.lit("Total due: "), money(total)))
    page = lambda rows, kind, text: rows.select(F.col("o_custkey").alias("audit_id"), F.concat(F.lit(f"{kind}-"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.concat(F.lit(f"{kind}_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"), F.lit(1).alias("page"), text.alias("text"))
    billed = o.join(L.table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    first = o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").alias("o_orderkey"))
    e = L.table(spark, d, "events").where("user_id is not null").join(first.select("user_id", number.alias("number")), "user_id")
    line = F.concat_ws(" | ", F.concat(F.lit("[TABLE ROW] "), F.date_format("ts", "dd/MM/yyyy")), F.concat(F.lit("TXN-"), F.lpad(F.col("event_id").cast("string"), 8, "0")), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("for "), F.col("number"))).otherwise("salaries"), F.format_number(F.col("value") + 10, 2), F.format_number(F.lit(10_000_000.0) - F.col("event_id") * 10, 2))
    rows = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("rows"))
    user = F.col("user_id").cast("string")
    bank = rows.select(F.col("user_id").alias("audit_id"), F.concat(F.lit("bank-"), user).alias("doc_id"), F.concat(F.lit("bank_"), user, F.lit(".pdf")).alias("filename"), F.lit(1).alias("page"), say(F.lit("Bank statement in EGP"), F.col("rows")).alias("text"))
    return page(o, "contract", contract).union(page(billed, "bill", invoice)).union(bank)


#: Orders, of which each has two pages or so, to a partition of pages; pages, of which each is a hit of two checks, to one of hits.
ORDERS = 100_000


def _audited(spark, d):
    return W.audit(Engine(spark), pages(spark, d), partitions=dealing.partitions(L.table(spark, d, "orders"), ORDERS))


@query(
    """WITH o AS (SELECT o_custkey AS audit_id, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS billed FROM orders WHERE o_custkey IS NOT NULL),
c AS (SELECT audit_id, max(CASE WHEN price >= 1 THEN price END) AS contract_total, min(o_orderkey) AS first FROM o GROUP BY 1),
i AS (SELECT audit_id, max(price + CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END) AS invoice_total, string_agg('bill_' || o_orderkey || '.pdf: subtotal ' || format('{:,.2f}', CAST(round(price * 0.8, 2) AS DOUBLE)) || ' + VAT ' || format('{:,.2f}', CAST(price - round(price * 0.8, 2) AS DOUBLE)) || ' = ' || format('{:,.2f}', CAST(price AS DOUBLE)) || ', stated total ' || format('{:,.2f}', CAST(price + 100 AS DOUBLE)), chr(10) ORDER BY 'bill-' || o_orderkey) FILTER (o_orderkey % 7 = 0) AS w FROM o WHERE billed GROUP BY 1),
v AS (SELECT user_id AS audit_id, event_id, CAST(value + 10 AS DECIMAL(18,2)) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE user_id IN (SELECT audit_id FROM c)),
p AS (SELECT audit_id, sum(v) AS paid FROM v WHERE rn > 1 AND event_id % 3 = 0 GROUP BY 1)
SELECT audit_id, CAST(contract_total AS DOUBLE) AS contract_total, CAST(invoice_total AS DOUBLE) AS invoice_total, CAST(paid AS DOUBLE) AS bank_paid_total, CAST(paid - contract_total AS DOUBLE) AS variance_vs_contract, coalesce(w, '') AS integrity_warnings FROM c LEFT JOIN i USING (audit_id) LEFT JOIN p USING (audit_id)"""
)
def audits_of_pages(spark, d):
    """The snapshot of every audit, from the text of its pages on."""
    out = _audited(spark, d).snapshot
    return out.select("audit_id", "contract_total", "invoice_total", "bank_paid_total", "variance_vs_contract", "integrity_warnings")


@query()
def audit_reports(spark, d):
    """Findings and risk of every audit, from the text of its pages on; its parts are tested with SQL, and the whole in plain Python."""
    return _audited(spark, d).report


@query(
    """WITH o AS (SELECT o_custkey AS audit_id, o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS billed, o_custkey IN (SELECT user_id FROM events) AS banked FROM orders WHERE o_custkey IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY k, kind) AS n, count(*) OVER (PARTITION BY audit_id) AS docs FROM (SELECT audit_id, k, price, billed, banked, 0 AS kind FROM o UNION ALL SELECT audit_id, k, price, billed, banked, 1 FROM o WHERE billed)),
p AS (SELECT a.audit_id, a.k, a.n, a.banked, a.price, a.price + 100 AS total FROM s a JOIN s b ON b.k = a.k AND a.kind = 0 AND b.kind = 1 WHERE a.k % 7 = 0 AND 100 > (a.price + 100) * 0.0001 + 0.01),
d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY audit_id, price ORDER BY n) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY n) AS f FROM d)
SELECT audit_id, 'check:' || check_no || ':' || f AS finding_id, CASE WHEN 100 / CAST(total AS DOUBLE) >= 0.05 THEN 'critical' ELSE 'warning' END AS severity, 'contract-' || k AS source_doc_id, 'bill-' || k AS conflicting_doc_id,
  'contract_' || k || '.pdf, page 1: Service Agreement' || chr(10) || 'Number: CTR-2024-' || lpad(CAST(k AS VARCHAR), 8, '0') || chr(10) || 'Contract value: EGP ' || format('{:,.2f}', CAST(price AS DOUBLE)) AS first
FROM c, (VALUES (1), (4)) v(check_no) WHERE f <= CASE WHEN check_no = 1 AND banked THEN 1 ELSE 4 END"""
)
def checklist_findings(spark, d):
    """What rules find for two checks of every audit in the text of all its documents, by order of their numbers; statements come last."""
    rows = stored(pages(spark, d), "pages")  # read for checks, documents and hits
    number = F.coalesce(F.regexp_extract("doc_id", "^(?:contract|bill)-([0-9]+)$", 1).try_cast("long") * 2 + F.startswith("doc_id", F.lit("bill")).cast("long"), F.lit(2**62))
    kinds = {"contract": "contract", "bill": "invoice", "bank": "bank_statement"}
    docs = rows.select("audit_id", "doc_id", "filename", F.coalesce(*(F.when(F.startswith("doc_id", F.lit(k)), v) for k, v in kinds.items())).alias("doc_type"))
    two = F.array(*(F.struct(F.lit(n).alias("check_no"), F.lit(t).alias("check_type"), F.lit(i).alias("intents")) for n, t, i in ((1, "amount_match", "bank_contract_recon"), (4, "cross_doc_consistency", "generic"))))
    checks = docs.select("audit_id").distinct().select("audit_id", F.inline(two))
    hits = rows.withColumn("position", number).withColumn("check_no", F.explode(F.array(F.lit(1), F.lit(4))))
    found = Engine(spark).adjudicate(checks, docs, hits, None, dealing.partitions(rows, ORDERS))
    return found.select("audit_id", "finding_id", "severity", "source_doc_id", "conflicting_doc_id", F.col("evidence")[0].alias("first"))
