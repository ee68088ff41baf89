"""Queries over word boxes: statements rendered from events, as a page would hold them, and what is lifted out of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.folders import stored
from tallyweave.operators import layout as Y
from tallyweave.plans.catalog import query
from tallyweave.sources import ledger as L

#: Rows of a page, points from one line to the next, points of a letter's width and height, and where columns begin.
ROWS, STEP, WIDE, HIGH = 20, 22.0, 4.0, 8.0
COLUMNS = [("Date", 40.0), ("Ref", 110.0), ("Description", 190.0), ("Debit", 380.0), ("Credit", 460.0), ("Balance", 540.0)]


def _statement(spark, d):
    """Events of users as statement rows: (doc_id, page, row, cells)."""
    e = L.table(spark, d, "events").where("user_id is not null and event_id is not null and ts is not null and value is not null")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    money = F.format_number(F.col("value") + 1000, 2)
    spent = F.col("event_type") == "purchase"
    balance = F.format_number(F.col("event_id") * 10 + 5000.5, 2)
    cells = F.array(F.date_format("ts", "dd/MM/yyyy"), F.concat(F.lit("TXN-"), F.col("event_id").cast("string")), F.concat(F.lit("Payment of "), "event_type"), F.when(spent, money).otherwise(""), F.when(spent, "").otherwise(money), balance)
    rows = e.select(F.col("user_id").alias("doc_id"), at.alias("at"), cells.alias("cells"))
    return rows.select("doc_id", F.floor(F.col("at") / ROWS).cast("int").alias("page"), (F.col("at") % ROWS).cast("int").alias("row"), "cells")


def _boxes(rows, x, y, text):
    """A row for each word of a text that is set from (x, y) on."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    before = lambda i: F.length(F.array_join(F.slice(words, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0)
    set_out = F.transform(words, lambda w, i: F.struct((x + before(i) * WIDE).alias("x0"), (x + (before(i) + F.length(w)) * WIDE).alias("x1"), w.alias("text")))
    return rows.select("doc_id", "page", F.inline(set_out), y.alias("y0")).select("doc_id", "page", "x0", "y0", "x1", (F.col("y0") + HIGH).alias("y1"), "text")


def words(spark, d):
    """Pages without ruled lines: a title and a line of prose, the columns' names on the first page of a statement, its rows, and a line of prose below."""
    rows = stored(_statement(spark, d), "statement")  # read for each part of a page
    one = rows.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    top = F.lit(80.0)
    line = lambda k, text: _boxes(one, F.lit(40.0), F.lit(0.0) + k, text)
    said = line(20.0, F.concat(F.lit("Statement of account "), F.col("doc_id").cast("string"))).union(line(42.0, F.concat(F.lit("All amounts are in EGP and page "), F.col("page").cast("string"), F.lit(" follows the one before"))))
    said = said.union(_boxes(one, F.lit(40.0), top + (F.col("n") + 2) * STEP, F.lit("This statement is made without signature and is valid as it stands")))
    names = F.array(*(F.struct(F.lit(n).alias("c"), F.lit(x).alias("x")) for n, x in COLUMNS))
    heads = one.where("page = 0").select("doc_id", "page", F.inline(names))
    said = said.union(_boxes(heads, F.col("x"), top, F.col("c")))
    starts = F.array(*(F.lit(x) for _, x in COLUMNS))
    cells = rows.select("doc_id", "page", "row", F.posexplode("cells").alias("k", "c")).where("c != ''").withColumn("x", F.get(starts, F.col("k")))
    return said.union(_boxes(cells, F.col("x"), top + (F.col("row") + 1) * STEP, F.col("c")))


_ROWS = f"""ev AS (SELECT user_id AS doc_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth, ts, event_type, value FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
pg AS (SELECT *, CAST(nth // {ROWS} AS INTEGER) AS page, CAST(nth % {ROWS} AS INTEGER) AS row, event_type = 'purchase' AS spent, format('{{:,.2f}}', value + 1000) AS money FROM ev),
fl AS (SELECT doc_id, page, bool_or(spent) OR page = 0 AS debits, bool_or(NOT spent) OR page = 0 AS credits, count(*) AS n FROM pg GROUP BY doc_id, page)"""


@query(
    f"""WITH {_ROWS} SELECT doc_id, page, row AS row_no, 'Date | Ref | Description | Debit | Credit | Balance' AS header,
  strftime(ts, '%d/%m/%Y') || ' | TXN-' || event_id || ' | Payment of ' || event_type || CASE WHEN debits THEN ' | ' || CASE WHEN spent THEN money ELSE '' END ELSE '' END || CASE WHEN credits THEN ' | ' || CASE WHEN spent THEN '' ELSE money END ELSE '' END || ' | ' || format('{{:,.2f}}', event_id * 10 + 5000.5) AS row
FROM pg JOIN fl USING (doc_id, page) WHERE page = 0 OR n > 1"""
)
def lifted_rows(spark, d):
    """The rows of the statements' tables, out of where words stand; a column that a page has nothing in isn't there, and names come from the first page. A page of one row
    without names is no table."""
    return Y.table_rows(Y.tables(stored(words(spark, d), "words")), across_pages=True).select("doc_id", "page", F.col("row_no").cast("int").alias("row_no"), "header", "row")


@query(
    f"""WITH {_ROWS} SELECT doc_id, page, 'Statement of account ' || doc_id || chr(10) || 'All amounts are in EGP and page ' || page || ' follows the one before' || chr(10)
  || CASE WHEN page = 0 OR n > 1 THEN '' ELSE (SELECT min(strftime(ts, '%d/%m/%Y') || ' TXN-' || event_id || ' Payment of ' || event_type || ' ' || money || ' ' || format('{{:,.2f}}', event_id * 10 + 5000.5) || chr(10)) FROM pg WHERE pg.doc_id = fl.doc_id AND pg.page = fl.page) END
  || 'This statement is made without signature and is valid as it stands' AS text FROM fl"""
)
def prose_around(spark, d):
    """What the statements' pages say outside of their tables."""
    boxes = stored(words(spark, d), "words")
    return Y.prose(boxes, Y.tables(boxes))


@query(
    f"""WITH {_ROWS}, r AS (SELECT doc_id, page, row, [strftime(ts, '%d/%m/%Y'), 'TXN-' || event_id, 'Payment of ' || event_type, money] AS c FROM pg) SELECT doc_id, page, array_to_string(list(array_to_string(c, ' | ') ORDER BY row), chr(10)) AS rows FROM r GROUP BY ALL"""
)
def ruled_tables(spark, d):
    """The same rows set without space between columns, in ruled tables of four columns: lines say where cells are."""
    rows = stored(_statement(spark, d), "statement").select("doc_id", "page", "row", F.array(F.get("cells", F.lit(0)), F.get("cells", F.lit(1)), F.get("cells", F.lit(2)), F.concat(F.get("cells", F.lit(3)), F.get("cells", F.lit(4)))).alias("cells"))
    edges = [40.0, 84.0, 124.0, 224.0, 300.0]
    cells = rows.select("doc_id", "page", "row", F.posexplode("cells").alias("k", "c")).withColumn("x", F.get(F.array(*map(F.lit, edges)), F.col("k")))
    boxes = _boxes(cells, F.col("x"), F.lit(80.0) + F.col("row") * STEP, F.col("c"))
    one = rows.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    bottom = F.lit(76.0) + F.col("n") * STEP
    upright = one.select("doc_id", "page", F.explode(F.array(*map(F.lit, edges))).alias("x0"), F.lit(76.0).alias("y0"), bottom.alias("y1")).select("doc_id", "page", "x0", "y0", F.col("x0").alias("x1"), "y1")
    level = one.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("k")).select("doc_id", "page", F.lit(40.0).alias("x0"), (F.lit(76.0) + F.col("k") * STEP).alias("y0"), F.lit(300.0).alias("x1"), (F.lit(76.0) + F.col("k") * STEP).alias("y1"))
    found = Y.tables(boxes, upright.union(level)).where("ruled")
    return found.select("doc_id", "page", F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n").alias("rows"))
