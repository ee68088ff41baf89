"""The canonical relations of an audit, derived from the star-schema tables.

An audit is a customer. Its documents are a contract and an invoice for each order, and a
bank statement from its events. Money is computed in DECIMAL and shown as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.folders import stored
from tallyweave.shipping import ship

MONEY = "decimal(18,2)"
AMOUNT_COLUMNS = ["audit_id", "doc_id", "doc_type", "filename", "entity_id", "amount_role", "amount_value", "amount_currency", "source_page", "txn_ref", "txn_date", "anchor_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(value: Column) -> Column:
    return value.cast(MONEY)


def _cents(value: Column) -> Column:
    return F.round(value, 2).cast(MONEY)


def currencies(customer: DataFrame) -> DataFrame:
    """(audit_id, amount_currency): one in five customers states none."""
    code = F.element_at(F.array(*map(F.lit, ["USD", "EUR", "GBP", "EGP"]), F.lit(None)), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return customer.select(F.col("c_custkey").alias("audit_id"), code.alias("amount_currency"))


def invoice_sums(orders: DataFrame, lineitem: DataFrame, how: str = "inner") -> DataFrame:
    """Subtotal and VAT of each order with lines; urgent orders overstate their total by 100."""
    net = money(F.col("l_extendedprice")) * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)"))
    lines = lineitem.groupBy("l_orderkey").agg(
        _cents(F.sum(net)).alias("subtotal"),
        _cents(F.sum(net * F.col("l_tax").cast("decimal(3,2)"))).alias("vat"),
        F.min(F.when(F.col("l_returnflag") == "R", money(F.col("l_extendedprice")))).alias("retainer"),
    )
    surcharge = F.when(F.col("o_orderpriority") == "1-URGENT", 100).otherwise(0).cast(MONEY)
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), how).withColumn("total", (F.col("subtotal") + F.col("vat") + surcharge).cast(MONEY))


def _stacked(df: DataFrame, roles: dict[str, Column]) -> DataFrame:
    """A row for each role with a value."""
    pairs = F.array(*(F.struct(F.lit(r).alias("amount_role"), v.cast(MONEY).alias("amount_value")) for r, v in roles.items()))
    out = df.withColumn("_p", F.explode(pairs)).select("*", "_p.amount_role", "_p.amount_value").drop("_p")
    return out.where("amount_value is not null")


def balance_sheets(supplier: DataFrame) -> DataFrame:
    """A balance sheet for each supplier, in the audit of the customer of that number; every fifth one's assets are 100 too many."""
    assets = F.abs(money(F.col("s_acctbal"))) + F.lit(1000)
    debts = _cents(assets * F.lit(0.4).cast("decimal(2,1)"))
    key = F.col("s_suppkey").cast("string")
    rows = supplier.select("s_suppkey", assets.alias("a"), debts.alias("l"), F.when(F.col("s_suppkey") % 5 == 0, assets - debts - 100).otherwise(assets - debts).alias("e"))
    rows = _stacked(rows, {"total_assets": F.col("a"), "total_liabilities": F.col("l"), "total_equity": F.col("e")})
    nothing = F.lit(None).cast("string")
    return rows.select(
        F.col("s_suppkey").alias("audit_id"), F.concat(F.lit("BS-"), key).alias("doc_id"), F.lit("balance_sheet").alias("doc_type"), F.concat(F.lit("balance_sheet_"), key, F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("BS-"), key, F.lit(":"), F.col("amount_role")).alias("entity_id"), "amount_role", "amount_value", F.lit(1).alias("source_page"), nothing.alias("txn_ref"), nothing.alias("txn_date"), nothing.alias("anchor_id"),
    )


def contract_links(orders: DataFrame) -> DataFrame:
    """(audit_id, doc_id, doc_type, anchor_id): what an audit's contracts are linked to, their own numbers and the party of those of even number."""
    key = F.col("o_orderkey").cast("string")
    both = F.array_compact(F.array(F.concat(F.lit("CTR"), key), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("PARTY"), F.col("o_custkey").cast("string")))))
    return orders.select(F.col("o_custkey").alias("audit_id"), F.concat(F.lit("CT-"), key).alias("doc_id"), F.lit("contract").alias("doc_type"), F.explode(both).alias("anchor_id"))


def bank_lines(events: DataFrame) -> DataFrame:
    """(audit_id, line) of the statements' debits; every fifth names a contract, the audit's own or another's."""
    text = lambda c: c.cast("string")
    named = F.concat(F.lit(" for CTR-2024/"), F.lpad(text(F.col("event_id") % 7), 3, "0"))
    line = F.concat(F.lit("[TABLE ROW] "), F.date_format("ts", "dd/MM/yyyy"), F.lit(" | TXN-"), text(F.col("event_id")), F.when(F.col("event_id") % 5 == 0, named).otherwise(" salaries"), F.lit(" | "), F.format_number("value", 2))
    return events.where("event_type = 'purchase'").select(F.col("user_id").alias("audit_id"), line.alias("line"))


def identifiers(orders: DataFrame) -> DataFrame:
    """(audit_id, identifier): the contract number that an audit with orders goes by."""
    return orders.select(F.col("o_custkey").alias("audit_id"), F.concat(F.lit("ctr 2024-"), F.lpad((F.col("o_custkey") % 7).cast("string"), 3, "0")).alias("identifier")).distinct()


def order_amounts(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Amounts of the contract and the invoice of each order; orders with their amount_currency."""
    total = money(F.col("o_totalprice"))
    third = F.when(F.col("o_orderstatus") == "O", _cents(total * F.lit(0.3).cast("decimal(2,1)"))).when(F.col("o_orderstatus") == "P", _cents(total * F.lit(0.4).cast("decimal(2,1)")))
    last = F.when(F.col("o_orderstatus") == "P", total - 2 * third).otherwise(third)
    key = F.col("o_orderkey").cast("string")
    quoted = F.when(F.col("o_orderstatus") == "F", _cents(total * F.lit(1.05).cast("decimal(3,2)"))).otherwise(total)
    # what is known of an order comes together before its amounts become rows
    whole = invoice_sums(orders, lineitem, "left")
    whole = whole.select("o_orderkey", "o_custkey", "amount_currency", total.alias("t"), third.alias("m"), last.alias("m3"), "subtotal", F.when(F.col("o_orderpriority") != "5-LOW", F.col("vat")).alias("vat"), "total", F.when(F.col("l_orderkey").isNotNull(), quoted).alias("quoted"), "retainer")
    contract = {"total_contract_value": F.col("t"), "milestone_1": F.col("m"), "milestone_2": F.col("m"), "milestone_3": F.col("m3")}
    invoice = {"invoice_subtotal": F.col("subtotal"), "vat_tax": F.col("vat"), "total_invoice": F.col("total"), "invoice_referenced_contract_value": F.col("quoted"), "retainer": F.col("retainer")}
    both = _stacked(whole, contract | invoice).withColumn("doc_type", F.when(F.col("amount_role").isin(*contract), "contract").otherwise("invoice"))
    both = both.withColumn("doc_id", F.concat(F.when(F.col("doc_type") == "contract", "CT-").otherwise("IN-"), key))
    return both.select(
        F.col("o_custkey").alias("audit_id"),
        "doc_id",
        "doc_type",
        F.concat(F.col("doc_type"), F.lit("_"), key, F.lit(".pdf")).alias("filename"),
        F.concat_ws(":", "doc_id", "amount_role").alias("entity_id"),
        F.when(F.col("amount_role").startswith("milestone_"), "milestone_scheduled").otherwise(F.col("amount_role")).alias("amount_role"),
        "amount_value",
        "amount_currency",
        F.lit(1).alias("source_page"),
        F.lit(None).cast("string").alias("txn_ref"),
        F.lit(None).cast("string").alias("txn_date"),
        F.concat(F.lit("CTR"), key).alias("anchor_id"),
    )


def bank_amounts(events: DataFrame) -> DataFrame:
    roles = {"purchase": "transaction_debit", "signup": "transaction_credit", "view": "running_balance", "click": "unknown", "error": "late_fee"}
    role = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv))[F.col("event_type")]
    named = F.col("event_id") % 10 != 0
    rows = events.select(
        F.col("user_id").alias("audit_id"),
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("entity_id"),
        role.alias("amount_role"),
        money(F.col("value")).alias("amount_value"),
        (F.col("event_id") % 5 + 1).cast("int").alias("source_page"),
        F.when(named, F.concat(F.lit("TXN-"), F.col("event_id").cast("string"))).alias("txn_ref"),
        F.when(named, F.date_format("ts", "yyyy-MM-dd")).alias("txn_date"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("PARTY"), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("VENDOR"), (F.col("event_id") % 7).cast("string"))).alias("anchor_id"),
    )
    stated = rows.where("amount_role = 'transaction_debit' and txn_ref is not null and amount_value >= 1").groupBy("audit_id").agg(F.sum("amount_value").alias("s"))
    share = F.when(F.col("audit_id") % 3 == 0, 0.9).otherwise(1.0).cast("decimal(2,1)")
    stated = stated.select(
        "audit_id",
        F.concat(F.lit("ST-"), F.col("audit_id").cast("string")).alias("entity_id"),
        F.lit("statement_total_debits").alias("amount_role"),
        _cents(F.col("s") * share).alias("amount_value"),
        F.lit(1).alias("source_page"),
        F.lit(None).cast("string").alias("txn_ref"),
        F.lit(None).cast("string").alias("txn_date"),
        F.lit(None).cast("string").alias("anchor_id"),
    )
    key = F.col("audit_id").cast("string")
    return rows.unionByName(stated).withColumns({"doc_id": F.concat(F.lit("BK-"), key), "doc_type": F.lit("bank_statement"), "filename": F.concat(F.lit("bank_statement_"), key, F.lit(".pdf"))})


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All amounts of all audits; amount_value is DECIMAL(18,2)."""
    of = lambda name: table(spark, sf_dir, name)
    known = currencies(of("customer"))
    orders = of("orders").join(known.withColumnRenamed("audit_id", "o_custkey"), "o_custkey", "left")
    others = bank_amounts(of("events")).unionByName(balance_sheets(of("supplier"))).join(known, "audit_id", "left")
    return order_amounts(orders, of("lineitem")).unionByName(others).select(AMOUNT_COLUMNS)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """amounts() as a table: for queries that read them more than once."""
    return stored(amounts(spark, sf_dir), "ledger")


def documents_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit_id, doc_id, doc_type, filename, page_count of every document that has amounts."""
    orders, lineitem, events = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "events"))
    key = F.col("o_orderkey").cast("string")
    contract = orders.select("o_custkey", F.concat(F.lit("CT-"), key), F.lit("contract"), F.concat(F.lit("contract_"), key, F.lit(".pdf")), F.lit(1))
    sheet = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("BS-"), F.col("s_suppkey").cast("string")), F.lit("balance_sheet"), F.concat(F.lit("balance_sheet_"), F.col("s_suppkey").cast("string"), F.lit(".pdf")), F.lit(1))
    billed = orders.join(lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    invoice = billed.select("o_custkey", F.concat(F.lit("IN-"), key), F.lit("invoice"), F.concat(F.lit("invoice_"), key, F.lit(".pdf")), F.lit(1))
    user = F.col("user_id").cast("string")
    bank = events.groupBy("user_id").agg(F.max(F.col("event_id") % 5 + 1).cast("int").alias("pages"))
    bank = bank.select("user_id", F.concat(F.lit("BK-"), user), F.lit("bank_statement"), F.concat(F.lit("bank_statement_"), user, F.lit(".pdf")), "pages")
    return contract.union(invoice).union(bank).union(sheet).toDF("audit_id", "doc_id", "doc_type", "filename", "page_count")


#: The same relations in SQL, as common table expressions.
LEDGER_SQL = """
cur AS (SELECT c_custkey AS audit_id, CASE c_nationkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'EGP' END AS amount_currency FROM customer),
net AS (SELECT l_orderkey, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
    CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))) AS n, CAST(l_tax AS DECIMAL(3,2)) AS tax FROM lineitem),
inv AS (SELECT l_orderkey, CAST(round(sum(n), 2) AS DECIMAL(18,2)) AS subtotal, CAST(round(sum(n * tax), 2) AS DECIMAL(18,2)) AS vat,
    min(CASE WHEN l_returnflag = 'R' THEN price END) AS retainer FROM net GROUP BY l_orderkey),
ord AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders),
mil AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN CAST(round(t * 0.3, 2) AS DECIMAL(18,2)) WHEN 'P' THEN CAST(round(t * 0.4, 2) AS DECIMAL(18,2)) END AS m FROM ord),
oam AS (
  SELECT o_orderkey, o_custkey, 'contract' AS doc_type, 'CT-' || o_orderkey AS doc_id, 'total_contract_value' AS role0, t AS v FROM mil
  UNION ALL SELECT o_orderkey, o_custkey, 'contract', 'CT-' || o_orderkey, 'milestone_1', m FROM mil
  UNION ALL SELECT o_orderkey, o_custkey, 'contract', 'CT-' || o_orderkey, 'milestone_2', m FROM mil
  UNION ALL SELECT o_orderkey, o_custkey, 'contract', 'CT-' || o_orderkey, 'milestone_3', CASE WHEN o_orderstatus = 'P' THEN CAST(t - 2 * m AS DECIMAL(18,2)) ELSE m END FROM mil
  UNION ALL SELECT o_orderkey, o_custkey, 'invoice', 'IN-' || o_orderkey, 'invoice_subtotal', subtotal FROM ord JOIN inv ON o_orderkey = l_orderkey
  UNION ALL SELECT o_orderkey, o_custkey, 'invoice', 'IN-' || o_orderkey, 'vat_tax', CASE WHEN o_orderpriority <> '5-LOW' THEN vat END FROM ord JOIN inv ON o_orderkey = l_orderkey
  UNION ALL SELECT o_orderkey, o_custkey, 'invoice', 'IN-' || o_orderkey, 'total_invoice', CAST(subtotal + vat + CASE WHEN o_orderpriority = '1-URGENT' THEN 100 ELSE 0 END AS DECIMAL(18,2)) FROM ord JOIN inv ON o_orderkey = l_orderkey
  UNION ALL SELECT o_orderkey, o_custkey, 'invoice', 'IN-' || o_orderkey, 'invoice_referenced_contract_value', CASE WHEN o_orderstatus = 'F' THEN CAST(round(t * 1.05, 2) AS DECIMAL(18,2)) ELSE t END FROM ord JOIN inv ON o_orderkey = l_orderkey
  UNION ALL SELECT o_orderkey, o_custkey, 'invoice', 'IN-' || o_orderkey, 'retainer', retainer FROM ord JOIN inv ON o_orderkey = l_orderkey),
bank0 AS (SELECT user_id AS audit_id, 'EV-' || event_id AS entity_id,
    CASE event_type WHEN 'purchase' THEN 'transaction_debit' WHEN 'signup' THEN 'transaction_credit' WHEN 'view' THEN 'running_balance' WHEN 'click' THEN 'unknown' WHEN 'error' THEN 'late_fee' END AS amount_role,
    CAST(value AS DECIMAL(18,2)) AS v, CAST(event_id % 5 + 1 AS INTEGER) AS source_page, CASE WHEN event_id % 10 <> 0 THEN 'TXN-' || event_id END AS txn_ref,
    CASE WHEN event_id % 10 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS txn_date, CASE event_id % 3 WHEN 0 THEN 'PARTY' || user_id WHEN 1 THEN 'VENDOR' || (event_id % 7) END AS anchor_id FROM events),
bank AS (SELECT * FROM bank0 UNION ALL
  SELECT audit_id, 'ST-' || audit_id, 'statement_total_debits', CAST(round(sum(v) * CASE WHEN audit_id % 3 = 0 THEN 0.9 ELSE 1.0 END, 2) AS DECIMAL(18,2)), 1, NULL, NULL, NULL
  FROM bank0 WHERE amount_role = 'transaction_debit' AND txn_ref IS NOT NULL AND v >= 1 GROUP BY audit_id),
bsh0 AS (SELECT s_suppkey, abs(CAST(s_acctbal AS DECIMAL(18,2))) + 1000 AS a FROM supplier),
bsh AS (SELECT s_suppkey, CAST(a AS DECIMAL(18,2)) AS a, CAST(round(a * 0.4, 2) AS DECIMAL(18,2)) AS l, CAST(a - round(a * 0.4, 2) - CASE WHEN s_suppkey % 5 = 0 THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS e FROM bsh0),
sheets AS (SELECT s_suppkey, 'total_assets' AS role0, a AS v FROM bsh UNION ALL SELECT s_suppkey, 'total_liabilities', l FROM bsh UNION ALL SELECT s_suppkey, 'total_equity', e FROM bsh),
amounts0 AS (
  SELECT o_custkey AS audit_id, doc_id, doc_type, doc_type || '_' || o_orderkey || '.pdf' AS filename, doc_id || ':' || role0 AS entity_id,
    CASE WHEN starts_with(role0, 'milestone_') THEN 'milestone_scheduled' ELSE role0 END AS amount_role, v AS amount_value, 1 AS source_page,
    CAST(NULL AS VARCHAR) AS txn_ref, CAST(NULL AS VARCHAR) AS txn_date, 'CTR' || o_orderkey AS anchor_id FROM oam WHERE v IS NOT NULL
  UNION ALL SELECT audit_id, 'BK-' || audit_id, 'bank_statement', 'bank_statement_' || audit_id || '.pdf', entity_id, amount_role, v, source_page, txn_ref, txn_date, anchor_id FROM bank
  UNION ALL SELECT s_suppkey, 'BS-' || s_suppkey, 'balance_sheet', 'balance_sheet_' || s_suppkey || '.pdf', 'BS-' || s_suppkey || ':' || role0, role0, v, 1, NULL, NULL, NULL FROM sheets),
amounts AS (SELECT a.*, amount_currency FROM amounts0 a LEFT JOIN cur USING (audit_id)),
documents_meta AS (
  SELECT o_custkey AS audit_id, 'CT-' || o_orderkey AS doc_id, 'contract' AS doc_type, 'contract_' || o_orderkey || '.pdf' AS filename, 1 AS page_count FROM orders
  UNION ALL SELECT o_custkey, 'IN-' || o_orderkey, 'invoice', 'invoice_' || o_orderkey || '.pdf', 1 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT user_id, 'BK-' || user_id, 'bank_statement', 'bank_statement_' || user_id || '.pdf', CAST(max(event_id % 5 + 1) AS INTEGER) FROM events GROUP BY user_id
  UNION ALL SELECT s_suppkey, 'BS-' || s_suppkey, 'balance_sheet', 'balance_sheet_' || s_suppkey || '.pdf', 1 FROM supplier)
"""

#: Contract anchors, lines of statements and contract numbers, in SQL.
LINKS_SQL = """
par AS (SELECT o_custkey AS audit_id, 'CTR' || o_orderkey AS anchor FROM orders UNION SELECT o_custkey, 'PARTY' || o_custkey FROM orders WHERE o_orderkey % 2 = 0),
bln AS (SELECT user_id AS audit_id, event_id, '[TABLE ROW] ' || strftime(ts, '%d/%m/%Y') || ' | TXN-' || event_id || CASE WHEN event_id % 5 = 0 THEN ' for CTR-2024/' || lpad(CAST(event_id % 7 AS VARCHAR), 3, '0') ELSE ' salaries' END || ' | ' || format('{:,.2f}', value) AS line FROM events WHERE event_type = 'purchase'),
idc AS (SELECT DISTINCT o_custkey AS audit_id, 'ctr2024' || lpad(CAST(o_custkey % 7 AS VARCHAR), 3, '0') AS core FROM orders),
lnk AS (SELECT DISTINCT b.audit_id, r.txn_ref FROM bln b JOIN idc USING (audit_id) JOIN bank0 r ON r.audit_id = b.audit_id
  WHERE contains(regexp_replace(lower(line), '[^a-z0-9]+', '', 'g'), core) AND r.txn_ref IS NOT NULL AND contains(regexp_replace(lower(line), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(r.txn_ref), '[^a-z0-9]+', '', 'g')))
"""
