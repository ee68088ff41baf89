"""The queries of the reconciliation operators over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.dealing import partitions
from tallyweave.functions import money as M
from tallyweave.functions import text as T
from tallyweave.operators import findings as V
from tallyweave.operators import graph as G
from tallyweave.operators import grounding as K
from tallyweave.operators import pairs as P
from tallyweave.operators import snapshot as S
from tallyweave.operators import state as Z
from tallyweave.sources import ledger as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The work of other modules: names that they need from here.
LEDGER = "WITH " + L.LEDGER_SQL


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(w)})" for w in words) + ")"


# ---------------------------------------------------------------- snapshot

CONTRACT = "con AS (SELECT audit_id, coalesce(max(CASE WHEN amount_role = 'total_contract_value' THEN amount_value END), sum(CASE WHEN amount_role = 'milestone_scheduled' THEN amount_value END)) AS contract_total FROM amounts WHERE doc_type = 'contract' AND amount_value >= 1 GROUP BY audit_id)"
INVOICE = """ivd AS (SELECT audit_id, doc_id, max(CASE WHEN amount_role = 'total_invoice' THEN amount_value END) AS t, max(CASE WHEN amount_role = 'invoice_subtotal' THEN amount_value END) AS s FROM amounts WHERE doc_type = 'invoice' AND amount_value >= 1 GROUP BY ALL),
sup AS (SELECT a.audit_id, a.doc_id, max(a.amount_value) AS t FROM amounts a JOIN amounts b ON a.doc_id = b.doc_id AND a.audit_id = b.audit_id JOIN amounts c ON a.doc_id = c.doc_id AND a.audit_id = c.audit_id
  WHERE a.doc_type = 'invoice' AND a.amount_role = 'total_invoice' AND b.amount_role = 'invoice_subtotal' AND c.amount_role = 'vat_tax' AND a.amount_value >= 1 AND b.amount_value >= 1 AND c.amount_value >= 1 AND abs(a.amount_value - b.amount_value - c.amount_value) <= 1 GROUP BY ALL),
ivt AS (SELECT audit_id, max(coalesce(sup.t, ivd.t, ivd.s)) AS invoice_total FROM ivd LEFT JOIN sup USING (audit_id, doc_id) GROUP BY audit_id)"""
DEBITS = """deb0 AS (SELECT *, txn_ref IS NOT NULL OR txn_date IS NOT NULL AS named, CASE WHEN txn_ref IS NOT NULL THEN 'ref:' || lower(trim(txn_ref)) WHEN txn_date IS NOT NULL THEN 'date:' || txn_date ELSE 'page:' || source_page END AS key
  FROM amounts WHERE doc_type = 'bank_statement' AND amount_value >= 1 AND amount_role = 'transaction_debit'),
deb1 AS (SELECT *, max(named) OVER (PARTITION BY audit_id) AS any_named FROM deb0),
deb AS (SELECT *, count(*) OVER (PARTITION BY audit_id, doc_id, key, amount_value) AS times FROM deb1 WHERE named OR NOT any_named QUALIFY row_number() OVER (PARTITION BY audit_id, doc_id, key, amount_value ORDER BY source_page, entity_id) = 1)"""
BANK = """att AS (SELECT d.*, NOT EXISTS (SELECT 1 FROM par p WHERE p.audit_id = d.audit_id) OR EXISTS (SELECT 1 FROM par p WHERE p.audit_id = d.audit_id AND p.anchor = d.anchor_id) OR EXISTS (SELECT 1 FROM lnk l WHERE l.audit_id = d.audit_id AND l.txn_ref = d.txn_ref) AS on_contract FROM deb d),
dsum AS (SELECT audit_id, sum(amount_value) AS verified, sum(amount_value) FILTER (on_contract) AS paid, max(times) > 1 AS repeated FROM att GROUP BY audit_id),
stt AS (SELECT audit_id, sum(m) AS stated FROM (SELECT audit_id, doc_id, max(amount_value) AS m FROM amounts WHERE doc_type = 'bank_statement' AND amount_role = 'statement_total_debits' AND amount_value >= 1 GROUP BY ALL) GROUP BY audit_id),
bnk AS (SELECT audit_id, verified, stated, paid, coalesce(repeated, false) AS repeated, coalesce(verified > 0 AND stated > 0 AND abs(verified - stated) > greatest(1, stated * 0.005), false) AS incomplete FROM dsum FULL JOIN stt USING (audit_id)),
unk AS (SELECT audit_id, count(*) AS n_unknown FROM amounts WHERE doc_type = 'bank_statement' AND amount_role = 'unknown' AND amount_value >= 1 GROUP BY 1)"""
CURRENCY = "ccn AS (SELECT audit_id, upper(amount_currency) AS currency, count(*) AS n FROM amounts WHERE amount_currency IS NOT NULL GROUP BY 1, 2), dcur AS (SELECT audit_id, list(currency ORDER BY n DESC, currency)[1] AS currency, array_to_string(list_sort(list(currency ORDER BY n DESC, currency)[2:]), ', ') AS others FROM ccn GROUP BY 1)"
_N = "format('{{:,.2f}}', CAST({} AS DOUBLE))"
_M = "max(CASE WHEN amount_role = '{}' THEN amount_value END) AS {}"
ARITHMETIC = f"""per AS (SELECT audit_id, doc_id, doc_type, min(filename) AS filename, {", ".join(_M.format(r, n) for n, r in (("total", "total_invoice"), ("sub", "invoice_subtotal"), ("vat", "vat_tax"), ("fee", "late_fee"), ("con", "total_contract_value"), ("ass", "total_assets"), ("lia", "total_liabilities"), ("equ", "total_equity")))},
  sum(CASE WHEN amount_role = 'milestone_scheduled' THEN amount_value END) AS ms, count(CASE WHEN amount_role = 'milestone_scheduled' THEN 1 END) AS n FROM amounts GROUP BY ALL),
warn AS (SELECT audit_id, doc_id, 'invoice' AS "check", filename || ': subtotal ' || {_N.format("sub")} || ' + VAT ' || {_N.format("vat")} || CASE WHEN coalesce(fee, 0) <> 0 THEN ' + late fee ' || {_N.format("fee")} ELSE '' END || ' = ' || {_N.format("sub + vat + coalesce(fee, 0)")} || ', stated total ' || {_N.format("total")} AS warning FROM per WHERE doc_type = 'invoice' AND abs(sub + vat + coalesce(fee, 0) - total) > 1
UNION ALL SELECT audit_id, doc_id, 'balance_sheet', filename || ': liabilities ' || {_N.format("lia")} || ' + equity ' || {_N.format("equ")} || ' = ' || {_N.format("lia + equ")} || ', stated assets ' || {_N.format("ass")} FROM per WHERE doc_type = 'balance_sheet' AND abs(ass - lia - equ) > 1
UNION ALL SELECT audit_id, doc_id, 'milestones', filename || ': ' || n || ' milestones of ' || {_N.format("ms")} || ', stated contract total ' || {_N.format("con")} FROM per WHERE doc_type = 'contract' AND n >= 2 AND con - ms > 1)"""


@query(
    LEDGER + f""", {L.LINKS_SQL}, {CONTRACT}, {INVOICE}, {DEBITS}, {BANK}, {CURRENCY}, {ARITHMETIC},
wrn AS (SELECT audit_id, string_agg(warning, chr(10) ORDER BY doc_id, "check") AS w FROM warn GROUP BY 1),
aud AS (SELECT DISTINCT audit_id FROM amounts),
allx AS (SELECT audit_id, contract_total, invoice_total, verified, stated, coalesce(incomplete, false) AS incomplete, coalesce(repeated, false) AS repeated, coalesce(n_unknown, 0) AS n_unknown, coalesce(currency, 'EGP') AS currency, CASE WHEN NOT coalesce(incomplete, false) THEN paid END AS bp,
  concat_ws(chr(10), w, CASE WHEN others <> '' THEN 'Amounts in ' || currency || ' and in ' || others || ' are added up together.' END) AS integrity_warnings
  FROM aud LEFT JOIN con USING (audit_id) LEFT JOIN ivt USING (audit_id) LEFT JOIN bnk USING (audit_id) LEFT JOIN unk USING (audit_id) LEFT JOIN dcur USING (audit_id) LEFT JOIN wrn USING (audit_id))
SELECT audit_id, currency, CAST(round(contract_total, 2) AS DOUBLE) AS contract_total, CAST(round(invoice_total, 2) AS DOUBLE) AS invoice_total, CAST(round(bp, 2) AS DOUBLE) AS bank_paid_total,
  CAST(round(bp - contract_total, 2) AS DOUBLE) AS variance_vs_contract, incomplete AS bank_extraction_incomplete, CASE WHEN incomplete THEN CAST(verified AS DOUBLE) END AS bank_debits_verified, CASE WHEN incomplete THEN CAST(stated AS DOUBLE) END AS bank_debits_stated,
  concat_ws(' ', CASE WHEN repeated THEN 'Rows of one transaction were counted once.' END, CASE WHEN incomplete THEN 'Extraction incomplete: debits of ' || {_N.format("verified")} || ' out of ' || {_N.format("stated")} || ' ' || currency || ' are verified, and the bank total is withheld.' END,
    CASE WHEN bp IS NULL AND n_unknown > 0 THEN 'No bank total: ' || n_unknown || ' amounts are neither debits nor credits.' END, CASE WHEN bp IS NULL THEN 'Bank payments were not added up.' WHEN contract_total IS NULL THEN 'The bank total stands without a contract total.' END) AS notes, integrity_warnings
FROM allx WHERE contract_total IS NOT NULL OR invoice_total IS NOT NULL OR bp IS NOT NULL OR incomplete OR integrity_warnings <> ''"""
)
def recon_snapshot(spark, d):
    rows = L.ledger(spark, d)
    return S.snapshot(rows, *links(spark, d, rows))


def links(spark, d, rows=None):
    """Contract anchors, and references linked by the statements' lines."""
    orders, events = L.table(spark, d, "orders"), L.table(spark, d, "events")
    refs = (L.bank_amounts(events) if rows is None else rows.where("doc_type = 'bank_statement'")).select("audit_id", "txn_ref")
    return S.anchor_rows(L.contract_links(orders)), S.linked_refs(L.bank_lines(events), S.identifier_cores(L.identifiers(orders)), refs)


@query(LEDGER + f", {L.LINKS_SQL} SELECT audit_id, list_sort(list(anchor)) AS anchors FROM par GROUP BY 1")
def contract_anchors(spark, d):
    return S.contract_anchors(L.contract_links(L.table(spark, d, "orders"))).withColumn("anchors", F.array_sort("anchors"))


@query(LEDGER + f", {L.LINKS_SQL} SELECT * FROM lnk")
def linked_refs(spark, d):
    """Transactions on lines that name the audit's contract, by the core of its number."""
    return links(spark, d)[1]


@query(LEDGER + f", {CONTRACT} SELECT audit_id, CAST(contract_total AS DOUBLE) AS contract_total FROM con")
def contract_total(spark, d):
    return S.contract_totals(L.amounts(spark, d)).withColumn("contract_total", F.col("contract_total").cast("double"))


@query(LEDGER + f", {INVOICE} SELECT audit_id, CAST(invoice_total AS DOUBLE) AS invoice_total FROM ivt")
def invoice_total_pick(spark, d):
    return S.invoice_totals(L.amounts(spark, d)).withColumn("invoice_total", F.col("invoice_total").cast("double"))


@query(LEDGER + f", {DEBITS} SELECT audit_id, key, entity_id, CAST(amount_value AS DOUBLE) AS amount_value FROM deb")
def bank_debit_dedupe(spark, d):
    return S.debits(L.amounts(spark, d)).select("audit_id", "key", "entity_id", F.col("amount_value").cast("double").alias("amount_value"))


@query(LEDGER + f", {L.LINKS_SQL}, {DEBITS}, {BANK} SELECT audit_id, CAST(verified AS DOUBLE) AS verified, CAST(stated AS DOUBLE) AS stated, CAST(paid AS DOUBLE) AS paid, repeated, incomplete FROM bnk")
def bank_gate(spark, d):
    rows = L.ledger(spark, d)
    return S.bank_totals(rows, *links(spark, d, rows)).select("audit_id", *(F.col(c).cast("double").alias(c) for c in ("verified", "stated", "paid")), "repeated", "incomplete")


@query(LEDGER + f", {ARITHMETIC} SELECT * FROM warn")
def doc_arithmetic(spark, d):
    return S.arithmetic_warnings(L.amounts(spark, d))


@query(LEDGER + f", {CURRENCY} SELECT audit_id, currency, others FROM dcur")
def snapshot_currency(spark, d):
    return S.dominant_currency(L.amounts(spark, d))


# ---------------------------------------------------------------- pairs

_VALUES = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(r)})" for (a, b), r in sorted(({(a, b): r for a, b, r in P.COMPARABLE} | {(b, a): r for a, b, r in P.COMPARABLE}).items()))
PAIRS = f"""rp(role1, role2, reason) AS (VALUES {_VALUES}),
anch AS (SELECT a.audit_id, a.anchor_id, a.entity_id AS entity_id1, b.entity_id AS entity_id2, a.doc_id AS doc_id1, b.doc_id AS doc_id2, a.amount_value AS v1, b.amount_value AS v2, reason, abs(a.amount_value - b.amount_value) AS diff
  FROM amounts a JOIN rp ON a.amount_role = role1 JOIN amounts b ON b.amount_role = role2 AND a.audit_id = b.audit_id AND a.anchor_id = b.anchor_id
  WHERE a.entity_id < b.entity_id AND a.doc_id <> b.doc_id AND coalesce(upper(a.amount_currency) = upper(b.amount_currency), true) AND abs(a.amount_value - b.amount_value) > greatest(abs(a.amount_value), abs(b.amount_value)) * 0.0001 + 0.01),
rel AS (SELECT *, CASE WHEN greatest(abs(v1), abs(v2)) > 0 THEN CAST(diff AS DOUBLE) / CAST(greatest(abs(v1), abs(v2)) AS DOUBLE) ELSE 0.0 END AS relative_difference FROM anch)"""
DEDUPED = "ded AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY audit_id, least(v1, v2), greatest(v1, v2), reason ORDER BY relative_difference DESC, entity_id1, entity_id2) = 1)"


@query(LEDGER + f", {PAIRS} SELECT audit_id, anchor_id, entity_id1, entity_id2, reason, relative_difference FROM rel QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY relative_difference DESC, entity_id1, entity_id2, anchor_id) <= {P.TOP_PAIRS}")
def contradictions_anchored(spark, d):
    rows = L.amounts(spark, d)
    return P.most_material(P.anchored(rows, P.role_pairs(spark))).select("audit_id", "anchor_id", "entity_id1", "entity_id2", "reason", "relative_difference")


@query(
    LEDGER + """, r AS (SELECT * FROM amounts WHERE amount_role = 'retainer'),
p AS (SELECT a.audit_id, a.entity_id AS entity_id1, b.entity_id AS entity_id2, CASE WHEN greatest(a.amount_value, b.amount_value) > 0 THEN CAST(abs(a.amount_value - b.amount_value) AS DOUBLE) / CAST(greatest(a.amount_value, b.amount_value) AS DOUBLE) ELSE 0.0 END AS relative_difference
  FROM r a JOIN r b ON a.audit_id = b.audit_id AND a.entity_id < b.entity_id WHERE a.doc_id <> b.doc_id AND a.anchor_id <> b.anchor_id AND coalesce(a.amount_currency = b.amount_currency, true) AND abs(a.amount_value - b.amount_value) > greatest(a.amount_value, b.amount_value) * 0.0001 + 0.01)
SELECT audit_id, entity_id1, entity_id2, relative_difference FROM p"""
)
def contradictions_anchorless(spark, d):
    return P.anchorless(L.amounts(spark, d), P.role_pairs(spark)).select("audit_id", "entity_id1", "entity_id2", "relative_difference")


@query(LEDGER + f", {PAIRS}, {DEDUPED} SELECT audit_id, entity_id1, entity_id2, reason FROM ded")
def pair_dedupe(spark, d):
    return P.dedupe(P.anchored(L.amounts(spark, d), P.role_pairs(spark))).select("audit_id", "entity_id1", "entity_id2", "reason")


@query(
    LEDGER + f""", {PAIRS}, {DEDUPED} SELECT audit_id, reason AS entity_label, doc_id1 AS doc_a_id, format('{{:,.2f}}', CAST(v1 AS DOUBLE)) AS doc_a_value, doc_id2 AS doc_b_id, format('{{:,.2f}}', CAST(v2 AS DOUBLE)) AS doc_b_value,
CASE WHEN diff >= 5000 OR relative_difference >= 0.05 THEN 'critical' ELSE 'warning' END AS severity FROM ded QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY diff DESC, entity_id1, entity_id2) <= 30"""
)
def conflict_rows(spark, d):
    return P.conflict_rows(P.anchored(L.amounts(spark, d), P.role_pairs(spark)))


REFERENCES = """refs AS (SELECT DISTINCT ON (claim_doc_id, cv, truth_doc_id, tv) * FROM (SELECT c.audit_id, c.doc_id AS claim_doc_id, t.doc_id AS truth_doc_id, c.amount_value AS cv, t.amount_value AS tv FROM amounts c JOIN amounts t ON c.audit_id = t.audit_id AND c.anchor_id = t.anchor_id
  WHERE c.amount_role = 'invoice_referenced_contract_value' AND t.amount_role = 'total_contract_value' AND t.doc_type = 'contract' AND c.doc_id <> t.doc_id AND coalesce(c.amount_currency = t.amount_currency, true) AND abs(c.amount_value - t.amount_value) > greatest(1, abs(t.amount_value) * 0.0001))),
refm AS (SELECT audit_id, 'contract value' AS label, claim_doc_id, truth_doc_id, CAST(cv - tv AS DOUBLE) AS difference, CAST(abs(cv - tv) AS DOUBLE) / greatest(CAST(abs(tv) AS DOUBLE), 1.0) AS relative_difference,
  CASE WHEN abs(cv - tv) >= 5000 OR CAST(abs(cv - tv) AS DOUBLE) / greatest(CAST(abs(tv) AS DOUBLE), 1.0) >= 0.05 THEN 'critical' ELSE 'warning' END AS severity, 0.95::DOUBLE AS confidence FROM refs)"""


@query(LEDGER + f", {REFERENCES} SELECT * FROM refm")
def reference_mismatch(spark, d):
    return P.reference_mismatches(L.amounts(spark, d), spark).drop("claim_value", "truth_value")


@query(LEDGER + f", rp(role1, role2, reason) AS (VALUES {_VALUES}), roles AS (SELECT DISTINCT amount_role AS r FROM amounts) SELECT a.r AS role1, b.r AS role2, coalesce(reason, '') AS reason FROM roles a CROSS JOIN roles b LEFT JOIN rp ON a.r = role1 AND b.r = role2")
def role_pairs_matrix(spark, d):
    """Every two roles that occur (a bounded set), and why they may be compared."""
    roles = L.amounts(spark, d).select(F.col("amount_role").alias("role1")).distinct()
    held = roles.agg(F.array_sort(F.collect_set("role1")).alias("all"))
    square = held.select(F.explode("all").alias("role1"), "all").select("role1", F.explode("all").alias("role2"))
    return square.join(F.broadcast(P.role_pairs(spark)), ["role1", "role2"], "left").select("role1", "role2", F.coalesce("reason", F.lit("")).alias("reason"))


# ---------------------------------------------------------------- people

TITLES = ["Chairman of the Board", "Chief Executive Officer", "CFO", "Managing Director", "Account Manager", "Clerk", "Finance Director"]
PEOPLE = f"""ppl AS (SELECT CAST(s_suppkey // 20 AS BIGINT) AS audit_id, s_name AS name, ({TITLES!r})[CAST(s_suppkey % 7 AS INTEGER) + 1] AS title, 'SG-' || s_suppkey AS doc_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Amendment 2 to BLD-2024-' || (s_suppkey % 5 + 10) WHEN s_suppkey % 3 = 1 THEN 'Agreement BLD-2024-' || (s_suppkey % 5 + 10) ELSE 'Approval sheet ' || s_suppkey END AS instrument FROM supplier)"""


def people(spark, d):
    n = F.col("s_suppkey")
    ref = (n % 5 + 10).cast("string")
    instrument = F.when(n % 3 == 0, F.concat(F.lit("Amendment 2 to BLD-2024-"), ref)).when(n % 3 == 1, F.concat(F.lit("Agreement BLD-2024-"), ref)).otherwise(F.concat(F.lit("Approval sheet "), n.cast("string")))
    return L.table(spark, d, "supplier").select(F.floor(n / 20).alias("audit_id"), F.col("s_name").alias("name"), F.element_at(F.array(*map(F.lit, TITLES)), (n % 7 + 1).cast("int")).alias("title"), F.concat(F.lit("SG-"), n.cast("string")).alias("doc_id"), F.array(instrument).alias("signed"))


_AUTHORITY = "CASE " + " ".join(f"WHEN contains(lower(trim(title)), {quoted(w)}) THEN {quoted(x)}" for w, x in T.AUTHORITIES) + " END"
_RANK = "CASE a.authority " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in T.AUTHORITY_RANKS.items()) + " ELSE 0 END"


@query(f"WITH {PEOPLE} SELECT audit_id, name, title, {_AUTHORITY} AS authority FROM ppl")
def authority_from_title(spark, d):
    return people(spark, d).select("audit_id", "name", "title", T.authority_of(F.col("title")).alias("authority"))


@query(
    f"""WITH {PEOPLE}, au AS (SELECT *, coalesce({_AUTHORITY}, 'unknown') AS authority FROM ppl),
rk AS (SELECT a.*, {_RANK} AS rank, regexp_extract(instrument, 'BLD-2024-[0-9]+') AS ref FROM au a),
p AS (SELECT b.audit_id, b.name AS name1, b.authority AS authority1, b.instrument AS instrument1, m.name AS name2, m.authority AS authority2, m.instrument AS instrument2, b.rank - m.rank AS authority_gap, b.doc_id AS d1, m.doc_id AS d2
  FROM rk b JOIN rk m ON b.audit_id = m.audit_id AND b.ref = m.ref WHERE b.ref <> '' AND starts_with(m.instrument, 'Amendment') AND m.rank < b.rank AND lower(b.name) <> lower(m.name) AND lower(b.instrument) <> lower(m.instrument))
SELECT audit_id, name1, authority1, instrument1, name2, authority2, instrument2, authority_gap, CASE WHEN authority_gap >= 2 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM p
QUALIFY row_number() OVER (PARTITION BY audit_id, least(lower(name1), lower(name2)), greatest(lower(name1), lower(name2)) ORDER BY name1, name2, instrument1, instrument2, d1, d2) = 1"""
)
def signatory_mismatch(spark, d):
    rows = people(spark, d).withColumn("authority", F.coalesce(T.authority_of(F.col("title")), F.lit("unknown")))
    return G.signatory_mismatches(rows)


# ---------------------------------------------------------------- graph

MENTIONS = "men AS (SELECT 'part:' || l_partkey AS entity_id, 'order:' || l_orderkey AS doc_id, l_orderkey * 1000 + l_suppkey AS seq, 'P' || l_partkey || '-' || l_orderkey AS value, CASE WHEN l_orderkey % 3 = 0 THEN 'USD' END AS cur, l_quantity > 49 AS mm FROM (SELECT DISTINCT l_partkey, l_orderkey, min(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))"


def mentions(spark, d):
    rows = L.table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    part, order = F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string")
    return rows.select(
        F.concat(F.lit("part:"), part).alias("entity_id"), F.concat(F.lit("order:"), order).alias("doc_id"), (F.col("l_orderkey") * 1000 + F.col("s")).alias("seq"), F.concat(F.lit("P"), part, F.lit("-"), order).alias("value"),
        F.when(F.col("l_orderkey") % 3 == 0, "USD").alias("amount_currency"), (F.col("q") > 49).alias("numeral_mismatch"),
    )


@query(f"WITH {MENTIONS} SELECT entity_id, arg_min(value, seq) AS value, arg_min(cur, seq) FILTER (cur IS NOT NULL) AS amount_currency, string_agg(doc_id, ',' ORDER BY seq, doc_id) AS doc_ids, bool_or(mm) AS numeral_mismatch, count(*) AS mention_count FROM men GROUP BY entity_id")
def entity_merge(spark, d):
    return G.merge_entities(mentions(spark, d))


EDGES = "edg AS (SELECT 'cust:' || o_custkey AS src, 'supp:' || l_suppkey AS dst, 'supplied_by' AS rel_type, 'order:' || o_orderkey AS doc_id, o_orderkey AS seq FROM (SELECT DISTINCT o_custkey, o_orderkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey))"


def edges(spark, d, n):
    """(src, dst, rel_type, doc_id, seq) by number: customers, and suppliers of their orders. What repeats goes before the tables meet, where they lie anyway."""
    placed = L.table(spark, d, "orders").select("o_custkey", "o_orderkey").repartition(n, "o_orderkey").distinct()
    lines = L.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey").distinct()
    rows = placed.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("supplied_by").alias("rel_type"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("seq"))


@query(f"WITH {EDGES} SELECT src, dst, rel_type, arg_min(doc_id, seq) AS doc_id, count(*) AS mention_count FROM edg GROUP BY ALL")
def edge_merge(spark, d):
    """Edges are merged by their numbers; texts are made of what is left."""
    n = partitions(L.table(spark, d, "lineitem"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias(c)
    return G.merge_edges(edges(spark, d, n), n).select(text("cust:", "src"), text("supp:", "dst"), "rel_type", text("order:", "doc_id"), "mention_count")


@query(
    """WITH e AS (SELECT 'cust:' || o_custkey AS src, 'order:' || o_orderkey AS dst FROM orders UNION SELECT 'order:' || l_orderkey, 'supp:' || l_suppkey FROM lineitem),
h1 AS (SELECT DISTINCT src AS seed, dst AS node FROM e WHERE starts_with(src, 'cust:')), h2 AS (SELECT DISTINCT seed, e.dst AS node FROM h1 JOIN e ON h1.node = e.src)
SELECT seed, seed AS node, 0 AS hops FROM (SELECT DISTINCT seed FROM h1) UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2"""
)
def khop2(spark, d):
    """Two steps from every customer with orders, over orders to suppliers."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    placed = L.table(spark, d, "orders").select(text("cust:", "o_custkey").alias("src"), text("order:", "o_orderkey").alias("dst"))
    return G.k_hop(placed.union(L.table(spark, d, "lineitem").select(text("order:", "l_orderkey"), text("supp:", "l_suppkey"))), placed.select(F.col("src").alias("node")))


@query(f"WITH {MENTIONS} SELECT entity_id, count(*) AS docs FROM men WHERE CAST(substr(doc_id, 7) AS BIGINT) % 2 = 1 GROUP BY entity_id")
def orphan_delete(spark, d):
    """Entities left once the documents of even orders are deleted."""
    gone = L.table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("doc_id"))
    return G.without_orphans(mentions(spark, d).select("entity_id", "doc_id"), gone)


@query(
    f"""WITH {MENTIONS}, sh AS (SELECT entity_id FROM men GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), per AS (SELECT doc_id, count(DISTINCT entity_id) AS entity_count, count(DISTINCT CASE WHEN sh.entity_id IS NOT NULL THEN entity_id END) AS shared_count FROM men LEFT JOIN sh USING (entity_id) GROUP BY 1)
SELECT 'order:' || o_orderkey AS doc_id, coalesce(entity_count, 0) AS entity_count, coalesce(shared_count, 0) AS shared_count, coalesce(shared_count, 0) = 0 AS isolated FROM orders LEFT JOIN per ON doc_id = 'order:' || o_orderkey"""
)
def linkage_trace(spark, d):
    docs = L.table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("doc_id"))
    return G.linkage(docs, mentions(spark, d).select("entity_id", "doc_id"))


@query(
    f"""WITH {MENTIONS}, sh AS (SELECT entity_id FROM men GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), per AS (SELECT doc_id, count(DISTINCT entity_id) AS n, count(DISTINCT CASE WHEN sh.entity_id IS NOT NULL THEN entity_id END) AS s FROM men LEFT JOIN sh USING (entity_id) GROUP BY 1),
ch AS (SELECT 'order:' || l_orderkey AS doc_id, count(*) AS chunk_count FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT 'order:' || o_orderkey AS doc_id, coalesce(chunk_count, 0) AS chunk_count, coalesce(n, 0) AS entity_count, CASE WHEN coalesce(chunk_count, 0) = 0 THEN 'NO CHUNKS' WHEN coalesce(n, 0) = 0 THEN 'NO ENTITIES' WHEN coalesce(s, 0) = 0 THEN 'ISOLATED' ELSE 'OK' END AS flag
FROM orders LEFT JOIN per ON per.doc_id = 'order:' || o_orderkey LEFT JOIN ch ON ch.doc_id = 'order:' || o_orderkey"""
)
def coverage_flags(spark, d):
    docs = L.table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("doc_id"))
    chunks = L.table(spark, d, "lineitem").where("l_returnflag != 'A'").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("doc_id"))
    return G.coverage(docs, chunks, mentions(spark, d).select("entity_id", "doc_id"))


@query(
    """WITH ent AS (SELECT 'S' || s_suppkey AS entity_id, s_suppkey AS seq, lower(s_name) AS k FROM supplier UNION ALL SELECT 'S' || s_suppkey, s_suppkey, 'supplier of nation ' || s_nationkey FROM supplier),
keys AS (SELECT k, arg_max(entity_id, seq) AS entity_id FROM ent GROUP BY k),
r AS (SELECT lower('Supplier of Nation ' || s_nationkey) AS a, lower(s_name) AS b FROM supplier)
SELECT DISTINCT x.entity_id AS src, y.entity_id AS dst, 'peer' AS rel_type FROM r JOIN keys x ON a = x.k JOIN keys y ON b = y.k WHERE x.entity_id <> y.entity_id"""
)
def relation_endpoints(spark, d):
    s = L.table(spark, d, "supplier")
    group = F.concat(F.lit("Supplier of Nation "), F.col("s_nationkey").cast("string"))
    ents = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("value"), group.alias("normalized_value"))
    return G.resolve_endpoints(s.select(group.alias("source"), F.concat(F.lit(" "), F.col("s_name")).alias("target"), F.lit("Peer").alias("rel_type")), ents)


@query(LEDGER + " SELECT audit_id, anchor_id, count(*) AS amounts, count(DISTINCT doc_id) AS docs FROM amounts WHERE anchor_id IS NOT NULL GROUP BY ALL")
def amount_anchors(spark, d):
    return L.amounts(spark, d).where("anchor_id is not null").groupBy("audit_id", "anchor_id").agg(F.count("*").alias("amounts"), F.count_distinct("doc_id").alias("docs"))


@query(LEDGER + " SELECT audit_id, CAST(amount_value AS DOUBLE) AS amount_value, min(doc_id) AS owner FROM amounts GROUP BY audit_id, amount_value HAVING count(DISTINCT doc_id) = 1")
def unique_owner(spark, d):
    """Values that just one document of an audit has."""
    return K.owners(L.amounts(spark, d)).withColumnRenamed("value", "amount_value")


# ---------------------------------------------------------------- findings

#: Titles of findings, one for each topic that a signature may have, and those topics.
TELLINGS = [("Restated contract value", "overpayment"), ("Bank transfer differs", "bank_recon"), ("Invoice subtotal differs", "invoice"), ("Milestone missed", "schedule"), ("VAT differs", "vat"), ("Vendor named twice", "party"), ("Expiry differs", "date"), ("Nothing special", "general")]
_TOLD = "[" + ", ".join(quoted(t) for t, _ in TELLINGS) + f"][CAST(seq % {len(TELLINGS)} AS INTEGER) + 1]"

FINDINGS = LEDGER + f""", {REFERENCES}, num AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY claim_doc_id, truth_doc_id) AS seq FROM refm),
fin AS (SELECT audit_id, seq, claim_doc_id || '>' || truth_doc_id AS finding_id, severity, CASE WHEN seq % 4 = 0 THEN 0.5 WHEN seq % 4 = 1 THEN 0.6 ELSE 0.95 END::DOUBLE AS confidence, CASE seq % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'graph' ELSE 'detector' END AS source,
  {_TOLD} AS title, 'EGP ' || format('{{:,.2f}}', abs(difference)) || CASE WHEN seq % 8 = 0 THEN ' variance' ELSE ' apart' END || ' against ' || truth_doc_id AS description, claim_doc_id, truth_doc_id, CASE WHEN seq % 2 = 0 THEN 1 ELSE 2 END AS n_evidence FROM num)"""


def findings(spark, d):
    from pyspark.sql import Window

    rows = P.reference_mismatches(L.amounts(spark, d), spark)
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("audit_id").orderBy("claim_doc_id", "truth_doc_id")).cast("long"))
    seq = F.col("seq")
    evidence = F.when(seq % 2 == 0, F.array(F.col("claim_doc_id"), F.lit(" "))).otherwise(F.array("claim_doc_id", "truth_doc_id"))
    return rows.select(
        "audit_id", "seq", F.concat_ws(">", "claim_doc_id", "truth_doc_id").alias("finding_id"), "severity", F.when(seq % 4 == 0, 0.5).when(seq % 4 == 1, 0.6).otherwise(0.95).alias("confidence"),
        F.when(seq % 3 == 0, "llm").when(seq % 3 == 1, "graph").otherwise("detector").alias("source"), F.element_at(F.array(*(F.lit(t) for t, _ in TELLINGS)), (seq % len(TELLINGS) + 1).cast("int")).alias("title"),
        F.concat(F.lit("EGP "), F.format_number(F.abs("difference"), 2), F.when(seq % len(TELLINGS) == 0, " variance").otherwise(" apart"), F.lit(" against "), F.col("truth_doc_id")).alias("description"), F.col("claim_doc_id").alias("source_doc_id"), F.col("truth_doc_id").alias("conflicting_doc_id"), evidence.alias("evidence"),
    )


@query(FINDINGS + " SELECT audit_id, finding_id, CASE WHEN severity = 'ok' THEN '' WHEN confidence < CASE source WHEN 'llm' THEN 0.65 WHEN 'graph' THEN 0.55 ELSE 0.4 END THEN 'low_confidence' WHEN source IN ('llm', 'graph') AND severity = 'critical' AND n_evidence < 2 THEN 'insufficient_evidence' ELSE '' END AS rejection FROM fin")
def finding_gate(spark, d):
    return findings(spark, d).select("audit_id", "finding_id", V.verdict(F.col("severity"), F.col("confidence"), F.col("evidence"), F.col("source")).alias("rejection"))


_COARSE = "CASE WHEN {0} < 10000 THEN round_even({0} / 100, 0) * 100 ELSE round_even({0} / 1000, 0) * 1000 END"


@query(
    FINDINGS + f""", am AS (SELECT *, CAST(replace(regexp_extract(description, 'EGP ([0-9,.]+)', 1), ',', '') AS DOUBLE) AS v FROM fin)
SELECT audit_id, finding_id, {"[" + ", ".join(quoted(x) for _, x in TELLINGS) + f"][CAST(seq % {len(TELLINGS)} AS INTEGER) + 1]"} || '|' || CASE WHEN v BETWEEN 100 AND 2000000 THEN CAST(CAST({_COARSE.format("v")} AS BIGINT) AS VARCHAR) ELSE 't:' || lower(title) END AS signature FROM am"""
)
def finding_signature(spark, d):
    return findings(spark, d).select("audit_id", "finding_id", V.signature(F.col("title"), F.col("description")).alias("signature"))


@query()
def dedup_clusters(spark, d):
    """An order-dependent fold: tested against one in plain Python."""
    return V.dedupe(findings(spark, d))


@query(FINDINGS + " SELECT audit_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings, count(*) AS findings, CAST(round(avg(confidence) * 100, 0) AS INTEGER) AS mean_confidence, CASE WHEN count(*) FILTER (severity = 'critical') >= 3 THEN 'critical' WHEN count(*) FILTER (severity = 'critical') >= 1 THEN 'high' WHEN count(*) FILTER (severity = 'warning') >= 3 THEN 'medium' WHEN count(*) FILTER (severity = 'warning') >= 1 THEN 'low' ELSE 'clean' END AS overall_risk FROM fin GROUP BY audit_id")
def risk(spark, d):
    return V.risk(findings(spark, d))


TRIAGE = "tri AS (SELECT 'scope' || (doc_id % 3) AS scope, 'sig' || (doc_id % 50) AS signature, CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'accepted' ELSE 'dismissed' END AS status, doc_id AS seq, doc_id // 10 AS updated_at FROM labels)"


def triage(spark, d):
    i = F.col("doc_id")
    status = F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, "accepted").otherwise("dismissed")
    return L.table(spark, d, "labels").select(F.concat(F.lit("scope"), (i % 3).cast("string")).alias("scope"), F.concat(F.lit("sig"), (i % 50).cast("string")).alias("signature"), status.alias("status"), i.alias("seq"), F.floor(i / 10).alias("updated_at"))


@query(f"WITH {TRIAGE} SELECT scope, signature, arg_max(status, updated_at * 1000000 + seq) AS status FROM tri GROUP BY ALL")
def triage_lww(spark, d):
    return Z.latest(triage(spark, d), ["scope", "signature"], "status", "updated_at", "seq")


@query(
    f"""WITH {TRIAGE}, sup AS (SELECT scope, signature FROM (SELECT scope, signature, arg_max(status, updated_at * 1000000 + seq) AS status FROM tri GROUP BY ALL) WHERE status = 'false_positive')
SELECT doc_id AS finding_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM sup WHERE scope = 'scope' || (doc_id % 3) AND signature = 'sig' || (doc_id % 50))"""
)
def suppression(spark, d):
    i = F.col("doc_id")
    rows = L.table(spark, d, "documents").select(i.alias("finding_id"), F.concat(F.lit("scope"), (i % 3).cast("string")).alias("scope"), F.concat(F.lit("sig"), (i % 50).cast("string")).alias("signature"))
    return V.without_suppressed(rows, triage(spark, d)).select("finding_id")


_UUID = "'6f3a8f5a-2c1b-4d3e-8a9f-' || lpad(CAST({} AS VARCHAR), 12, '0')"


@query(f"WITH f AS (SELECT o_orderkey AS finding_id, 'See ' || {_UUID.format('o_orderkey')} || ' for details' AS prose, upper({_UUID.format('o_orderkey - o_orderkey % 3')}) AS ev FROM orders) SELECT finding_id FROM f WHERE contains(lower(ev), regexp_extract(prose, '[0-9a-f]{{8}}-[0-9a-f-]{{27}}'))")
def uuid_guard(spark, d):
    """Findings whose cited id stands in their evidence."""
    key = lambda c: F.concat(F.lit("6f3a8f5a-2c1b-4d3e-8a9f-"), F.lpad(c.cast("string"), 12, "0"))
    o = F.col("o_orderkey")
    rows = L.table(spark, d, "orders").select(o.alias("finding_id"), F.concat(F.lit("See "), key(o), F.lit(" for details")).alias("prose"), F.array(F.upper(key(o - o % 3))).alias("evidence"))
    return rows.where(~V.cites_unknown_id(F.col("prose"), F.col("evidence"))).select("finding_id")


@query(f"SELECT o_orderkey, CAST({_COARSE.format('o_totalprice')} AS BIGINT) AS coarse FROM orders")
def coarse_bucket(spark, d):
    return L.table(spark, d, "orders").select("o_orderkey", M.coarse(F.col("o_totalprice")).cast("long").alias("coarse"))


@query(
    """SELECT o_custkey AS audit_id, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS completed, CAST(max(o_orderdate) AS VARCHAR) AS newest, row_number() OVER (PARTITION BY c_nationkey ORDER BY max(o_orderdate) DESC, o_custkey) AS position
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_nationkey"""
)
def archive(spark, d):
    """Audits with counts, the newest first within each scope (here a nation)."""
    from pyspark.sql import Window

    rows = L.table(spark, d, "orders").join(L.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy(F.col("o_custkey").alias("audit_id"), "c_nationkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.max("o_orderdate").alias("last"))
    position = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("last"), "audit_id")).cast("long")
    return rows.select("audit_id", "orders", "completed", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("newest"), position.alias("position"))


from tallyweave.plans import catalog_text  # noqa: E402, F401  the queries over text and state
from tallyweave.plans import catalog_course  # noqa: E402, F401  the queries over evidence, extraction, stores and the course of an audit
from tallyweave.plans import catalog_time  # noqa: E402, F401  the queries over time
from tallyweave.plans import catalog_layout  # noqa: E402, F401  the queries over word boxes
from tallyweave.plans import catalog_store  # noqa: E402, F401  the queries over stores, levels and SQL
from tallyweave.plans import catalog_audit  # noqa: E402, F401  the queries over whole audits
