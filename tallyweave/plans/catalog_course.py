"""Queries over evidence, extraction, stores and the course of an audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.dealing import partitions
from tallyweave.functions import money as M
from tallyweave.functions import text as T
from tallyweave.operators import control as C
from tallyweave.operators import documents as D
from tallyweave.operators import evidence as E
from tallyweave.operators import extraction as X
from tallyweave.operators import findings as V
from tallyweave.operators import graph as G
from tallyweave.operators import grounding as K
from tallyweave.operators import pairs as P
from tallyweave.operators import retrieval as R
from tallyweave.plans import catalog as A
from tallyweave.plans.catalog import LEDGER, query, quoted
from tallyweave.sources import ledger as L
from tallyweave.sources import store

def _money(x) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _uuid5(key: str) -> str:
    """SQL for a name-based id of a key."""
    h = f"sha1(unhex('{X.NAMESPACE}') || encode({key}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr({h}, 17, 1))::BIGINT % 4 + 1 AS INTEGER), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def _text(c):
    return c.cast("string")


# ---------------------------------------------------------------- evidence


def _lines(spark, d):
    o = L.table(spark, d, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("double")
    line = F.concat(F.lit("contract_"), _text(key), F.lit(".pdf, page 1: EGP "), F.format_number(price, 2))
    raw = F.when(key % 3 == 0, F.format_number(price, 2)).when(key % 3 == 1, F.concat(F.lit("USD "), F.format_number(price * 2, 2))).otherwise("no number")
    return o.select(key.alias("id"), line.alias("line"), raw.alias("raw"), price.alias("price"), F.when(key % 2 == 0, "critical").otherwise("warning").alias("severity"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS backed, o_orderkey % 3 <> 1 AS both_stand FROM orders")
def evidence_lines(spark, d):
    """Whether a line holds the value that it is cited for, and whether all values stand in the evidence."""
    rows = _lines(spark, d)
    second = F.when(F.col("id") % 3 == 1, F.col("price") * 2).otherwise(F.col("price"))
    return rows.select("id", E.line_backs(F.col("line"), F.col("raw")).alias("backed"), E.snippets_back(F.array("line", F.lit("nothing: here")), F.col("price"), second).alias("both_stand"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM orders")
def severity_check(spark, d):
    return _lines(spark, d).select("id", E.checked_severity(F.col("severity"), F.col("line"), F.col("raw"), F.col("line"), F.col("raw")).alias("severity"))


@query(LEDGER + " SELECT audit_id, doc_id, doc_type = 'bank_statement' OR doc_type = 'invoice' AS bank, doc_type = 'contract' AS other FROM documents_meta")
def bank_documents(spark, d):
    """Bank documents by type or file name: here invoices are called account_stmt, and contracts are somebody's resume."""
    m = L.documents_meta(spark, d)
    name = F.when(F.col("doc_type") == "invoice", F.concat(F.lit("Account_STMT_"), "doc_id")).when(F.col("doc_type") == "contract", F.lit("My_Resume.pdf")).otherwise(F.concat(F.lit("file_"), "doc_id"))
    return m.select("audit_id", "doc_id", E.is_bank_document(F.col("doc_type"), name).alias("bank"), E.is_other_document(name).alias("other"))


@query(
    LEDGER + f""", {A.REFERENCES} SELECT r.audit_id, claim_doc_id || '>' || truth_doc_id AS finding_id, 'invoice_' || substr(claim_doc_id, 4) || '.pdf gives the contract value as ' || {_money("cv")} || ', contract_' || substr(truth_doc_id, 4) || '.pdf as ' || {_money("tv")} AS title,
  'invoice_' || substr(claim_doc_id, 4) || '.pdf, page 1: ' || {_money("cv")} || '|' || 'contract_' || substr(truth_doc_id, 4) || '.pdf, page 1: ' || {_money("tv")} AS evidence FROM refs r"""
)
def reference_findings(spark, d):
    rows = E.reference_findings(P.reference_mismatches(L.amounts(spark, d), spark), L.documents_meta(spark, d))
    return rows.select("audit_id", "finding_id", "title", F.array_join("evidence", "|").alias("evidence"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '13:EGP 1000' WHEN 2 THEN '0:5 USD;14:2,000 EUR' ELSE '4:٧٥ جنيه' END AS amounts FROM orders")
def amounts_in_text(spark, d):
    """Amounts with a currency and their places; a number after a label of a reference is none."""
    said = ["Invoice # 55 of EGP 1000", "The total is EGP 1000 net", "5 USD against 2,000 EUR", "دفع ٧٥ جنيه"]
    rows = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, said)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("text"))
    found = F.transform(M.amounts_in(F.col("text")), lambda a: F.concat_ws(":", a["position"].cast("string"), F.substr(F.col("text"), a["position"] + 1, a["end"] - a["position"])))
    return rows.select("id", F.array_join(found, ";").alias("amounts"))


@query("WITH s AS (SELECT o_custkey AS a, list_distinct(list(o_orderpriority)) AS x, list_distinct(list(o_orderstatus)) AS y FROM orders GROUP BY 1) SELECT a.a AS id, len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) AS jaccard FROM s a JOIN s b ON b.a = a.a + 1")
def set_similarity(spark, d):
    s = L.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("x"))
    after = s.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("x").alias("y"))
    return s.join(after, "o_custkey").select(F.col("o_custkey").alias("id"), M.jaccard(F.col("x"), F.col("y")).alias("jaccard"))


@query(
    LEDGER + f""", {A.PAIRS}, {A.DEDUPED}, g AS (SELECT audit_id, reason AS entity_label, {_money("v1")} AS a, {_money("v2")} AS b, diff, entity_id1, entity_id2 FROM ded),
gg AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY diff DESC, entity_id1, entity_id2) AS rn FROM g QUALIFY rn <= 30),
f AS (SELECT audit_id, 0 AS source, entity_label, a, b, CAST(rn AS BIGINT) AS position FROM gg WHERE rn % 2 = 0), q AS (SELECT audit_id, 1 AS source, entity_label, a, b, CAST(rn AS BIGINT) AS position FROM gg),
u AS (SELECT * FROM f UNION ALL SELECT * FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY audit_id, least(a, b), greatest(a, b) ORDER BY source, position) AS first FROM u)
SELECT audit_id, entity_label, a AS doc_a_value, b AS doc_b_value, row_number() OVER (PARTITION BY audit_id ORDER BY source, position) AS position FROM k WHERE source = 0 OR first = 1 QUALIFY position <= 30"""
)
def merged_conflicts(spark, d):
    """Rows of findings first, then those of the graph with other amounts: here every second of the graph's is a finding's too."""
    from pyspark.sql import Window

    g = P.dedupe(P.anchored(L.amounts(spark, d), P.role_pairs(spark))).withColumn("diff", F.abs(F.col("amount_value1") - F.col("amount_value2")))
    g = g.withColumn("position", F.row_number().over(Window.partitionBy("audit_id").orderBy(F.desc("diff"), "entity_id1", "entity_id2")).cast("long")).where("position <= 30")
    text = lambda c: F.format_number(F.col(c).cast("double"), 2)
    g = g.select("audit_id", F.col("reason").alias("entity_label"), text("amount_value1").alias("doc_a_value"), text("amount_value2").alias("doc_b_value"), "position")
    out = K.merged_conflicts(g.where("position % 2 = 0"), g)
    return out.withColumn("position", F.col("position").cast("long"))


# ---------------------------------------------------------------- extraction


@query("SELECT conv_id AS doc_id, turn AS chunk_index FROM conversations WHERE length(trim(text)) >= 100 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def readable_chunks(spark, d):
    c = L.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")
    return X.readable(c, most=2).select("doc_id", "chunk_index")


def _raw_entities(spark, d):
    """What a model may say of an order: an amount of a made-up role, a person without a level, a contract number, and something else."""
    key = F.col("o_orderkey")
    k = key % 4
    price = F.format_number(F.col("o_totalprice"), 2)
    nothing = F.lit(None).cast("string")
    return L.table(spark, d, "orders").select(
        F.concat(F.lit("c"), _text(F.col("o_custkey"))).alias("chunk_id"), key.alias("pos"), F.concat(F.lit("D"), _text(F.col("o_custkey") % 10)).alias("doc_id"), F.when(key % 3 == 0, "bank_statement").otherwise("contract").alias("doc_type"),
        F.when(k == 0, "amount").when(k == 1, "person").when(k == 2, "contract_id").otherwise("clause").alias("entity_type"),
        F.when(k == 0, F.concat(price, F.lit(" egp"))).when(k == 1, F.concat(F.lit(" Ms "), _text(key % 5))).when(k == 2, F.concat(F.lit("CTR-"), _text(key % 50))).otherwise("Clause 7").alias("value"),
        F.when(k == 2, F.concat(F.lit("ctr "), _text(key % 50))).alias("normalized_value"), F.when(key % 8 == 0, " Retainer ").when(key % 8 == 4, "bribe").alias("amount_role"), F.when(key % 2 == 0, "Arabic").otherwise("klingon").alias("source_language"),
        F.when(k == 0, "YES").alias("numeral_mismatch"), F.when(key % 8 == 1, "CFO").when(key % 8 == 5, "other").alias("signing_authority_level"), F.when(k == 1, " Managing Director ").alias("role_title"),
        F.when(key % 12 == 0, F.concat(F.lit("TXN-"), _text(key))).when(k == 0, " ").alias("txn_ref"), nothing.alias("txn_date"),
    )


_ENTITY = f"""ent AS (SELECT 'c' || o_custkey AS chunk_id, o_orderkey AS pos, 'D' || (o_custkey % 10) AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'amount' WHEN 1 THEN 'person' WHEN 2 THEN 'contract_id' ELSE 'clause' END AS entity_type,
  CASE WHEN o_orderkey % 8 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE 'retainer' END WHEN o_orderkey % 8 = 4 THEN 'unknown' END AS amount_role, CASE WHEN o_orderkey % 2 = 0 THEN 'arabic' ELSE 'unknown' END AS source_language,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(round(o_totalprice, 2) AS DOUBLE) END AS amount_value, CASE WHEN o_orderkey % 4 = 0 THEN 'EGP' END AS amount_currency, CASE WHEN o_orderkey % 4 = 0 THEN true END AS numeral_mismatch,
  CASE WHEN o_orderkey % 8 = 1 THEN 'cfo' WHEN o_orderkey % 8 = 5 THEN 'director' END AS signing_authority_level, CASE WHEN o_orderkey % 4 = 1 THEN 'Managing Director' END AS role_title, CASE WHEN o_orderkey % 12 = 0 THEN 'TXN-' || o_orderkey END AS txn_ref,
  {_uuid5("CASE o_orderkey % 4 WHEN 0 THEN 'amount::D' || (o_custkey % 10) || '::EGP::' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || CASE WHEN o_orderkey % 12 = 0 THEN '::txn' || o_orderkey || '::' ELSE '' END WHEN 1 THEN 'person::ms ' || (o_orderkey % 5) WHEN 2 THEN 'contract_id::ctr' || (o_orderkey % 50) ELSE 'clause::D' || (o_custkey % 10) || '::clause 7' END")} AS entity_id FROM orders)"""


@query(f"WITH {_ENTITY} SELECT pos, entity_type, amount_role, source_language, amount_value, amount_currency, numeral_mismatch, signing_authority_level, role_title, txn_ref, entity_id FROM ent")
def sanitised_entities(spark, d):
    rows = X.sanitised(_raw_entities(spark, d))
    return rows.select("pos", "entity_type", "amount_role", "source_language", "amount_value", "amount_currency", "numeral_mismatch", "signing_authority_level", "role_title", "txn_ref", "entity_id")


@query(f"WITH {_ENTITY} SELECT chunk_id, entity_id, min(pos) AS pos, arg_max(source_language, pos) AS source_language, max(pos) % 7 AS last FROM ent GROUP BY chunk_id, entity_id")
def last_of_chunk(spark, d):
    """One record for an id in a chunk: the last, at the place of the first."""
    rows = X.sanitised(_raw_entities(spark, d)).withColumn("last", F.col("pos") % 7)
    return X.last_of_chunk(rows).select("chunk_id", "entity_id", "pos", "source_language", "last")


@query(f"SELECT doc_id, chunk_index, {_uuid5("'chunk::' || doc_id || '::' || chunk_index")} AS chunk_id, version FROM (SELECT conv_id AS doc_id, turn // 2 AS chunk_index, max(turn) AS version FROM conversations GROUP BY ALL)")
def chunk_ids(spark, d):
    """The latest chunks with their ids."""
    c = L.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("chunk_index"), "text", F.col("turn").alias("version"))
    return store.latest_chunks(c).select("doc_id", "chunk_index", "chunk_id", "version")


@query(f"SELECT DISTINCT 'cust:' || o_custkey AS src, 'prio:' || o_orderpriority AS dst, {_uuid5("'cust:' || o_custkey || '->' || 'prio:' || o_orderpriority || '::has'")} AS rel_id FROM orders")
def relation_ids(spark, d):
    e = L.table(spark, d, "orders").select(F.concat(F.lit("cust:"), _text(F.col("o_custkey"))).alias("src"), F.concat(F.lit("prio:"), "o_orderpriority").alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, " Has").otherwise("has").alias("rel_type"))
    return X.relations(e).select("src", "dst", "rel_id")


@query("SELECT DISTINCT 'part:' || l_partkey AS entity_id, 'order:' || l_orderkey AS doc_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def found_in_edges(spark, d):
    """Mentions whose entity (here larger parts) and document (open orders) both exist."""
    part, order = (lambda c, p=p: F.concat(F.lit(p), _text(F.col(c))).alias(c) for p in ("part:", "order:"))
    lines = L.table(spark, d, "lineitem")
    m = lines.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"))
    found = X.found_in(m, L.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("entity_id")), L.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("doc_id")), partitions(lines))
    return found.select(part("entity_id"), order("doc_id"))


@query(
    f"""WITH e AS (SELECT user_id AS doc_id, event_id, CAST(event_id // 100 AS INTEGER) AS chunk_index, value, strftime(ts, '%d/%m/%Y') AS day, sum(CASE WHEN event_type = 'purchase' THEN -value ELSE value END) OVER (PARTITION BY user_id ORDER BY event_id) + 1000000 AS bal FROM (SELECT event_id, user_id, ts, event_type, CAST(value AS DECIMAL(18,2)) + 1 AS value FROM events)),
p AS (SELECT *, lag(bal) OVER (PARTITION BY doc_id ORDER BY event_id) AS before FROM e)
SELECT doc_id, chunk_index, CASE WHEN bal < before THEN 'transaction_debit' WHEN bal > before THEN 'transaction_credit' ELSE 'unknown' END AS amount_role, {_money("value")} AS raw, 'TXN-' || event_id AS txn_ref, day AS txn_date FROM p
UNION ALL SELECT user_id, -1, 'opening_balance', '1,000,000.00', NULL, NULL FROM events GROUP BY user_id"""
)
def rule_entities(spark, d):
    """Amounts of statements rendered from events: balances say which movements are debits, and labels what other amounts are."""
    from pyspark.sql import Window

    e = L.table(spark, d, "events").withColumn("v", F.col("value").cast("decimal(18,2)") + 1)
    balance = F.sum(F.when(F.col("event_type") == "purchase", -F.col("v")).otherwise(F.col("v"))).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1000000
    number = lambda c: F.format_number(c.cast("double"), 2)
    row = F.concat_ws(" | ", F.concat(F.lit("[TABLE ROW] "), F.date_format("ts", "dd/MM/yyyy")), F.concat(F.lit("TXN-"), _text(F.col("event_id"))), number(F.col("v")), number(F.col("bal")))
    rows = e.withColumn("bal", balance).select("user_id", F.floor(F.col("event_id") / 100).cast("int").alias("chunk_index"), "event_id", row.alias("row"))
    chunks = rows.groupBy(F.col("user_id").alias("doc_id"), "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "row"))), lambda x: x["row"]), "\n").alias("text"))
    heads = e.select(F.col("user_id").alias("doc_id")).distinct().select("doc_id", F.lit(-1).alias("chunk_index"), F.lit("Statement of account\nOpening balance: EGP 1,000,000.00\nPage 1").alias("text"))
    return X.rule_entities(heads.unionByName(chunks)).drop("line_no")


@query("SELECT user_id AS id, CASE WHEN user_id % 3 = 0 THEN true ELSE count(*) >= 3 END AS tabular, user_id % 3 = 0 AS header FROM events GROUP BY user_id HAVING count(*) >= 2")
def tabular_rows(spark, d):
    """Whether rows of cells are a table: a header first, or amounts; here every third page has a header, and the second row of the others no amount."""
    cells = F.array(F.date_format("ts", "dd/MM/yyyy"), F.format_number(F.col("value") + 1000, 2))
    e = L.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", cells.alias("c")))).alias("x")).where("size(x) >= 2")
    rows = F.transform("x", lambda r: r["c"])
    first = F.when(F.col("user_id") % 3 == 0, F.array(F.array(F.lit("Date"), F.lit("Amount")))).otherwise(F.array(F.array(F.lit("a note"), F.lit("without numbers"))))
    e = e.select("user_id", F.concat(first, F.slice(rows, F.lit(2), F.size(rows))).alias("rows"))
    return e.select(F.col("user_id").alias("id"), D.is_tabular(F.col("rows")).alias("tabular"), D.is_header(F.col("rows")[0]).alias("header"))


@query("WITH n AS (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 3) SELECT user_id AS page_id, 'Statement of ' || user_id || chr(10) || 'Debit' || chr(10) || 'Credit' AS prose FROM n")
def register_prose(spark, d):
    """What stands before the rows of a register."""
    e = L.table(spark, d, "events")
    cells = F.concat_ws("\n", F.date_format("ts", "dd/MM/yyyy"), F.lit("TXN-"), _text(F.col("event_id")), F.format_number(F.col("value") + 1000, 2))
    page = e.groupBy(F.col("user_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", cells.alias("c")))).alias("x"))
    return D.register_prose(page.select("page_id", F.concat(F.lit("Statement of "), _text(F.col("page_id")), F.lit("\nDebit\nCredit\n"), F.array_join(F.transform("x", lambda v: v["c"]), "\n")).alias("text")))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'bank_statement' WHEN 1 THEN 'invoice' ELSE '' END AS kind FROM orders")
def finance_fallback(spark, d):
    """Noisy scans with many numbers and words of money are statements or invoices."""
    said = ["statement 1,000 2,000 3,000 4,000 5,000 total balance payment", "total 1,000 tax 2,000 payment 3,000 amount 4,000 and 5,000", "total 1,000 tax 2,000 payment 3,000 amount"]
    rows = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, said)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("text"))
    return rows.select("id", F.coalesce(T.finance_type(F.col("text")), F.lit("")).alias("kind"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'EGP 5,000|Reconcile|EGP|Acme|2024' WHEN 1 THEN 'فاتورة|شركة' ELSE '' END AS entities FROM orders")
def query_entities(spark, d):
    said = ["Reconcile EGP 5,000 of Acme in 2024", "أين فاتورة شركة", ""]
    rows = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, said)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("q"))
    return rows.select("id", F.array_join(F.array_remove(T.query_entities(F.col("q")), "أين"), "|").alias("entities"))


# ---------------------------------------------------------------- graph and search


@query("WITH e AS (SELECT DISTINCT 'cust:' || o_custkey AS src, 'prio:' || o_orderpriority AS dst FROM orders), b AS (SELECT src AS seed, dst AS node FROM e UNION SELECT dst, src FROM e) SELECT seed, node, 'has' AS rel_type FROM b WHERE starts_with(seed, 'prio:') OR seed = 'cust:1' QUALIFY row_number() OVER (PARTITION BY seed ORDER BY node) <= 50")
def one_hop(spark, d):
    e = L.table(spark, d, "orders").select(F.concat(F.lit("cust:"), _text(F.col("o_custkey"))).alias("src"), F.concat(F.lit("prio:"), "o_orderpriority").alias("dst"), F.lit("has").alias("rel_type"))
    return G.one_hop(e, e.select(F.col("dst").alias("node")).union(spark.createDataFrame([("cust:1",)], "node string")))


@query(
    """WITH f AS (SELECT DISTINCT 'order:' || l_orderkey AS doc_id, l_suppkey AS e FROM lineitem), g AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier) AS b FROM supplier), s AS (SELECT a, b FROM g WHERE a <> b UNION SELECT b, a FROM g WHERE a <> b),
h AS (SELECT e AS b, min(doc_id) AS x, max(doc_id) AS z FROM f GROUP BY 1), j AS (SELECT f.doc_id, coalesce(x <> f.doc_id OR z <> f.doc_id, false) AS c FROM f JOIN s ON e = a LEFT JOIN h USING (b))
SELECT 'order:' || o_orderkey AS doc_id, count(j.doc_id) AS edge_count, count(*) FILTER (c) AS cross_doc_edges FROM orders LEFT JOIN j ON j.doc_id = 'order:' || o_orderkey GROUP BY 1"""
)
def linkage_edges(spark, d):
    """Edges of the suppliers on an order, and those to suppliers on other orders."""
    s = L.table(spark, d, "supplier")
    n = s.agg(F.count("*").alias("n"))
    edges = s.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 1) % F.col("n")).alias("dst"))
    lines, orders = L.table(spark, d, "lineitem"), L.table(spark, d, "orders")
    held = lines.select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"))
    found = G.edge_counts(orders.select(F.col("o_orderkey").alias("doc_id")), edges, held, partitions(lines))
    return found.withColumn("doc_id", F.concat(F.lit("order:"), _text(F.col("doc_id"))))


@query(LEDGER + " SELECT audit_id, doc_id, entity_id, coalesce(string_agg(DISTINCT anchor_id, ',' ORDER BY anchor_id), '') AS anchors FROM amounts GROUP BY ALL")
def anchors_of_amounts(spark, d):
    return G.anchors_of(L.amounts(spark, d)).withColumn("anchors", F.array_join("anchors", ","))


@query("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label IN (1, 2) AND vec_id % 2 = 0), r AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.e) DESC, b.vec_id) AS rank FROM embeddings a, n b WHERE a.vec_id % 100 = 0) SELECT query_id, vec_id, rank FROM r WHERE rank <= 5")
def filtered_topk(spark, d):
    """The five nearest among vectors of two documents (labels) and one language (even ids are Arabic)."""
    v = L.table(spark, d, "embeddings")
    chunks = v.select("vec_id", "embedding", F.col("label").alias("doc_id"), F.when(F.col("vec_id") % 2 == 0, "arabic").otherwise("english").alias("language"))
    kept = R.filtered(chunks, spark.createDataFrame([(1,), (2,)], "doc_id int"), "arabic")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.vector_top_k(asked, kept, 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+'), ['für', 'und']) OR doc_id % 50 = 7 ORDER BY doc_id LIMIT 40")
def keyword_any_script(spark, d):
    """Keywords of any script: every fiftieth document ends in the words asked for in Arabic letters, joined to the German ones."""
    t = L.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 == 7, F.lit("دفع: für, und")).otherwise(F.col("text")).alias("text"))
    return R.keyword_matches(t, "FÜR und", 40).select("doc_id")


@query(
    """WITH u AS (SELECT 'keyword' AS source, 0 AS p, doc_id, text, 1.0 AS score FROM documents WHERE contains(text, 'tion') UNION ALL SELECT 'vector', 1, doc_id, text, 0.12346 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'graph', 2, doc_id, text, 0.0 FROM documents),
m AS (SELECT source FROM u QUALIFY row_number() OVER (PARTITION BY left(text, 100) ORDER BY p, score DESC, doc_id) = 1)
SELECT count(*) FILTER (source = 'keyword') AS keyword_count, count(*) FILTER (source = 'vector') AS vector_count, count(*) FILTER (source = 'graph') AS graph_count, count(*) AS total, CASE WHEN count(*) FILTER (source = 'graph') > 0 THEN 'graph' ELSE 'vector' END AS route FROM m"""
)
def search_summary(spark, d):
    t = L.table(spark, d, "documents")
    merged = R.merge_hits(t.where("contains(text, 'tion')").withColumn("score", F.lit(1.0)), t.where("doc_id % 2 = 0").withColumn("score", F.lit(0.12346)), t.withColumn("score", F.lit(0.0)))
    return R.search_summary(merged, F.lit("graph"))


# ---------------------------------------------------------------- stores


@query("SELECT conv_id AS doc_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def chunks_of_documents(spark, d):
    """Every chunk of the documents that are asked for."""
    return store.of_documents(L.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn"), L.table(spark, d, "labels").where("quality = 1"))


@query("SELECT conv_id AS doc_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def chunks_deleted(spark, d):
    return store.without_documents(L.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn"), L.table(spark, d, "labels").where("quality = 1"))


@query("SELECT o_custkey AS doc_id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS version FROM orders GROUP BY 1")
def document_upsert(spark, d):
    return store.latest_documents(L.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("version")), F.col("version"))


def _events(spark, d):
    return L.table(spark, d, "events").select(F.col("user_id").alias("audit_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "complete").otherwise("reasoning_step").alias("event_type"))


@query("SELECT user_id AS audit_id, count(*) AS events FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0) GROUP BY 1")
def event_counts(spark, d):
    """Events of the logs that are left when failed audits of even numbers start anew."""
    e = _events(spark, d)
    return store.event_counts(store.cleared(e, e.where("event_type = 'error' and audit_id % 2 = 0")))


@query("SELECT user_id AS audit_id, event_id AS seq FROM events e WHERE event_id >= 200 AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_id >= 200 AND x.event_id < e.event_id AND x.event_type IN ('error', 'signup'))")
def replay_to_end(spark, d):
    return C.replay_to_end(_events(spark, d), 200).select("audit_id", "seq")


# ---------------------------------------------------------------- the course of an audit


@query(
    LEDGER + f""", {A.REFERENCES}, {A.PAIRS}, {A.DEDUPED}, u AS (SELECT audit_id, claim_doc_id || '>' || truth_doc_id AS finding_id, 'reference' AS phase, 1 AS n FROM refm UNION ALL SELECT audit_id, entity_id1 || '>' || entity_id2, 'graph', 0 FROM ded)
SELECT audit_id, finding_id, phase, row_number() OVER (PARTITION BY audit_id ORDER BY n, finding_id) AS seq FROM u"""
)
def phase_order(spark, d):
    """Findings of the graph before those of references."""
    rows = L.amounts(spark, d)
    graph = P.dedupe(P.anchored(rows, P.role_pairs(spark))).select("audit_id", F.concat_ws(">", "entity_id1", "entity_id2").alias("finding_id"))
    refs = P.reference_mismatches(rows, spark).select("audit_id", F.concat_ws(">", "claim_doc_id", "truth_doc_id").alias("finding_id"))
    return C.in_phases({"reference": refs, "graph": graph}).select("audit_id", "finding_id", "phase", "seq")


@query(LEDGER + ", n AS (SELECT audit_id, count(*) AS docs, count(*) FILTER (doc_type = 'bank_statement') AS bank FROM documents_meta GROUP BY 1), k(check_no, check_type, bankish) AS (VALUES (0, 'self_reference', false), (1, 'amount_match', true), (2, 'date_consistency', false), (3, 'party_match', true), (4, 'cross_doc_consistency', false)), a AS (SELECT audit_id, check_no, CASE WHEN check_type = 'self_reference' THEN 'recorded' WHEN check_type = 'date_consistency' OR (check_type IN ('amount_match', 'cross_doc_consistency') AND docs > 1) THEN 'adjudicate' ELSE 'none' END AS action, bankish AND bank > 0 AS b FROM n, k) SELECT audit_id, check_no, action, CASE WHEN action <> 'adjudicate' THEN 0 WHEN b THEN 1 ELSE 4 END AS most FROM a")
def check_dispatch(spark, d):
    docs = L.documents_meta(spark, d)
    kinds = F.array(*(F.struct(F.lit(i).alias("check_no"), F.lit(t).alias("check_type"), F.lit(x).alias("intents")) for i, (t, x) in enumerate((("self_reference", "generic"), ("amount_match", "bank_contract_recon"), ("date_consistency", "schedule"), ("party_match", "bank_contract_recon"), ("cross_doc_consistency", "generic")))))
    checks = docs.select("audit_id").distinct().select("audit_id", F.inline(kinds))
    return C.dispatch(checks, docs).select("audit_id", "check_no", "action", "most")


@query("WITH p AS (SELECT c_custkey AS audit_id, c_custkey % 4 AS n_docs, c_custkey % 3 AS n_findings, c_custkey % 6 AS n_checks, c_custkey % 5 AS passes FROM customer) SELECT audit_id, CASE WHEN n_docs >= 2 AND n_findings = 0 AND n_checks < 4 AND passes < 2 THEN 'planner' ELSE 'report' END AS next, CASE WHEN n_docs >= 2 THEN 'cross_checker' ELSE 'report' END AS first FROM p")
def plan_next(spark, d):
    k = F.col("c_custkey")
    return C.goes_on(L.table(spark, d, "customer").select(k.alias("audit_id"), (k % 4).alias("n_docs"), (k % 3).alias("n_findings"), (k % 6).alias("n_checks"), (k % 5).alias("passes"))).select("audit_id", "next", "first")


@query("WITH b AS (SELECT user_id AS audit_id, max(ts) AS last FROM events GROUP BY 1), s AS (SELECT *, ['pending', 'processing', 'completed', 'failed'][audit_id % 4 + 1] AS status FROM b) SELECT audit_id, CASE status WHEN 'completed' THEN 'fetch' WHEN 'processing' THEN CASE WHEN last >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS THEN 'wait' ELSE 'restart' END ELSE 'start' END AS action FROM s")
def start_actions(spark, d):
    """What asking for an audit's run does, a day after its last event at most."""
    e = L.table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    rows = e.groupBy(F.col("user_id").alias("audit_id")).agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now))
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "failed"))), (F.col("audit_id") % 4 + 1).cast("int"))
    return rows.select("audit_id", C.start_action(status, F.col("last"), F.col("now"), 86400).alias("action"))


@query("WITH s AS (SELECT user_id AS audit_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'completed' ELSE 'failed' END AS status FROM events), p AS (SELECT *, lag(status) OVER (PARTITION BY audit_id ORDER BY seq) AS b FROM s) SELECT audit_id, seq, CASE WHEN b IS NULL THEN status = 'pending' WHEN b IN ('pending', 'failed') THEN status = 'processing' WHEN b = 'processing' THEN status <> 'pending' ELSE false END AS legal FROM p")
def legal_states(spark, d):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "signup", "completed").otherwise("failed")
    return C.legal_states(L.table(spark, d, "events").select(F.col("user_id").alias("audit_id"), F.col("event_id").alias("seq"), status.alias("status"))).select("audit_id", "seq", "legal")


@query(LEDGER + " SELECT audit_id, doc_type, count(*) AS n FROM documents_meta GROUP BY ALL")
def type_histogram(spark, d):
    return C.type_histogram(L.documents_meta(spark, d))


@query(A.FINDINGS + ", g AS (SELECT audit_id, NOT (confidence < CASE source WHEN 'llm' THEN 0.65 WHEN 'graph' THEN 0.55 ELSE 0.4 END OR (source IN ('llm', 'graph') AND severity = 'critical' AND n_evidence < 2)) AS ok FROM fin) SELECT audit_id, count(*) AS candidates, count(*) FILTER (ok) AS accepted, round(100.0 * count(*) FILTER (ok) / count(*), 1)::DOUBLE AS rate FROM g GROUP BY 1")
def pass_rate(spark, d):
    rows = A.findings(spark, d)
    return C.pass_rate(rows.withColumn("accepted", V.verdict(F.col("severity"), F.col("confidence"), F.col("evidence"), F.col("source")) == ""))


@query("WITH t AS (SELECT doc_id % 20 AS audit_id, doc_id % 100 AS finding_id, CASE WHEN toxic = 1 THEN 'false_positive' ELSE 'accepted' END AS status, doc_id AS seq FROM labels), l AS (SELECT audit_id, finding_id, arg_max(status, seq) AS triage FROM t GROUP BY ALL) SELECT doc_id % 20 AS audit_id, doc_id % 100 AS finding_id, doc_id AS row_id, triage FROM documents LEFT JOIN l ON l.audit_id = doc_id % 20 AND l.finding_id = doc_id % 100")
def triage_join(spark, d):
    i = F.col("doc_id")
    f = L.table(spark, d, "documents").select((i % 20).alias("audit_id"), (i % 100).alias("finding_id"), i.alias("row_id"))
    t = L.table(spark, d, "labels").select((i % 20).alias("audit_id"), (i % 100).alias("finding_id"), F.when(F.col("toxic") == 1, "false_positive").otherwise("accepted").alias("status"), i.alias("seq"), F.lit(0).alias("updated_at"))
    return C.with_triage(f, t).select("audit_id", "finding_id", "row_id", "triage")


@query("WITH u AS (SELECT doc_id % 20 AS audit_id, 0 AS part, doc_id, text FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id % 20, 1, doc_id, text FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY audit_id, left(text, 100) ORDER BY part, doc_id) AS rn FROM u) SELECT audit_id, part, doc_id FROM r WHERE part = 0 OR (rn = 1 AND left(text, 100) <> '')")
def all_passages(spark, d):
    """Found passages (here German ones), then all others with another head."""
    t = L.table(spark, d, "documents").select((F.col("doc_id") % 20).alias("audit_id"), F.col("doc_id").alias("position"), "doc_id", "text", "lang")
    return C.all_passages(t.where("lang = 'de'").drop("lang"), t.drop("lang")).select("audit_id", "part", "doc_id")


@query(
    LEDGER + f""", {A.REFERENCES}, n AS (SELECT audit_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c FROM refm GROUP BY 1), s AS (SELECT 'n' || c_nationkey AS scope, c_custkey AS audit_id, ['pending', 'processing', 'completed', 'completed'][c_custkey % 4 + 1] AS status, c_custkey % 97 AS created_at FROM customer)
SELECT scope, audit_id, status, created_at, CASE WHEN status = 'completed' THEN coalesce(n, 0) END AS findings, CASE WHEN status = 'completed' THEN coalesce(c, 0) END AS critical, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, audit_id) AS position FROM s LEFT JOIN n USING (audit_id)"""
)
def session_archive(spark, d):
    k = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "completed"))), (k % 4 + 1).cast("int"))
    s = L.table(spark, d, "customer").select(F.concat(F.lit("n"), _text(F.col("c_nationkey"))).alias("scope"), k.alias("audit_id"), status.alias("status"), (k % 97).alias("created_at"))
    return C.sessions_with_reports(s, P.reference_mismatches(L.amounts(spark, d), spark))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0")
def valid_rows(spark, d):
    """Rows out of JSON; every third lacks its end, and is left out."""
    e = L.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("props"))
    return C.valid_rows(e, "props", "k long", ["k"])


@query("""SELECT o_orderkey AS id, '{"status":"' || o_orderstatus || '","customer":' || o_custkey || '}' AS document FROM orders""")
def documents_as_json(spark, d):
    return C.to_document(L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")), "id")


@query("SELECT conv_id AS id, string_agg(text, '' ORDER BY turn) AS content FROM conversations WHERE role = 'user' GROUP BY 1")
def flat_content(spark, d):
    """The text of answers that come in blocks; blocks of another type are left out."""
    c = L.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "text").otherwise("tool").alias("type"), "text"))).alias("blocks"))
    return c.where(F.exists("blocks", lambda b: b["type"] == "text")).select(F.col("conv_id").alias("id"), C.flat_content(F.col("blocks")).alias("content"))


@query(
    A.FINDINGS + f""", lin AS (SELECT audit_id, string_agg('[' || severity || '] ' || title || ': ' || left(description, {C.FINDING_CHARS}), chr(10) ORDER BY seq) AS lines FROM fin WHERE seq <= {C.FINDINGS} GROUP BY 1),
sn AS (SELECT audit_id, string_agg('[' || doc_id || '] ' || left(text, {C.SNIPPET_CHARS}), chr(10) ORDER BY doc_id) AS sources FROM (SELECT doc_id % 50 AS audit_id, doc_id, trim(text, ' ') AS text FROM documents WHERE trim(text, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) <= {C.SNIPPETS}) GROUP BY 1),
hs AS (SELECT audit_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT conv_id AS audit_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {C.TURNS}) GROUP BY 1)
SELECT c_custkey AS audit_id, concat_ws(chr(10), 'Overall risk: high', lines) AS digest, coalesce(sources, '') AS sources, coalesce(history, '') AS history FROM customer LEFT JOIN lin ON lin.audit_id = c_custkey LEFT JOIN sn ON sn.audit_id = c_custkey LEFT JOIN hs ON hs.audit_id = c_custkey"""
)
def question_context(spark, d):
    audits = L.table(spark, d, "customer").select(F.col("c_custkey").alias("audit_id"), F.lit("high").alias("overall_risk"))
    passages = L.table(spark, d, "documents").select((F.col("doc_id") % 50).alias("audit_id"), F.col("doc_id").alias("position"), "doc_id", "text")
    turns = L.table(spark, d, "conversations").select(F.col("conv_id").alias("audit_id"), "turn", "role", "text")
    return C.question_context(audits, A.findings(spark, d), passages, turns)


_HEAD = "lower(left(coalesce(text, ''), 600))"


@query(f"SELECT doc_id AS id, coalesce({', '.join(f'CASE WHEN regexp_matches({_HEAD}, {quoted(p)}) THEN {quoted(t)} END' for t, p in T.TITLES)}, '') AS title_type FROM documents")
def classify_texts(spark, d):
    """The types that documents' own texts give by their heads."""
    return L.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(T.title_type(F.col("text"), F.lit("scan.pdf")), F.lit("")).alias("title_type"))
