"""Queries over text, chunks, vectors and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.dealing import dealt, partitions
from tallyweave.folders import new_folder
from tallyweave.functions import money as M
from tallyweave.functions import text as T
from tallyweave.operators import documents as D
from tallyweave.operators import extraction as X
from tallyweave.operators import grounding as K
from tallyweave.operators import retrieval as R
from tallyweave.operators import snapshot as S
from tallyweave.operators import state as Z
from tallyweave.plans.catalog import LEDGER, ORACLES, any_of, links, query, quoted
from tallyweave.sources import ledger as L
from tallyweave.sources import store
from tallyweave.streaming import eventlog

# ---------------------------------------------------------------- money in text

_PRICE = "format('{:,.2f}', CAST(o_totalprice AS DOUBLE))"
LINES = f"""ln AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'EGP ' || {_PRICE} WHEN 1 THEN {_PRICE} || ' USD' WHEN 2 THEN 'Paid in 2024: ' || {_PRICE} || ' EUR net' WHEN 3 THEN 'paid 1,000 USD and 2,000 EUR'
  WHEN 4 THEN 'INV-2024-' || o_orderkey WHEN 5 THEN 'total ' || {_PRICE} WHEN 6 THEN '١٢٣٤٥ جنيه' ELSE 'balance 500 LE against 500 LE, ref 7' END AS text FROM orders)"""


def lines(spark, d):
    key, price = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    forms = [F.concat(F.lit("EGP "), price), F.concat(price, F.lit(" USD")), F.concat(F.lit("Paid in 2024: "), price, F.lit(" EUR net")), F.lit("paid 1,000 USD and 2,000 EUR"), F.concat(F.lit("INV-2024-"), key.cast("string")), F.concat(F.lit("total "), price), F.lit("١٢٣٤٥ جنيه"), F.lit("balance 500 LE against 500 LE, ref 7")]
    return L.table(spark, d, "orders").select(key.alias("id"), F.element_at(F.array(*forms), (key % 8 + 1).cast("int")).alias("text"))


_S = "translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
_NUM = "CAST(replace({}, ',', '') AS DOUBLE)"
_YEAR = "(NOT contains({0}, '.') AND length(regexp_replace({0}, '[^0-9]', '', 'g')) = 4 AND CAST(replace({0}, ',', '') AS DOUBLE) BETWEEN 1900 AND {1})"
_YEARLESS = "list_distinct(list_transform(list_filter({0}, lambda t: NOT " + _YEAR.format("t", 2100) + "), lambda t: round(" + _NUM.format("t") + ", 8)))"


@query(
    f"""WITH {LINES}, s AS (SELECT id, trim({_S}) AS s FROM ln),
m AS (SELECT id, s, regexp_extract(s, {quoted(M.SINGLE)}, 1) AS whole, list_concat(regexp_extract_all(s, {quoted(M.LEFT)}, 1), regexp_extract_all(s, {quoted(M.RIGHT)}, 1)) AS beside, regexp_extract_all(s, {quoted(M.RUN)}) AS runs FROM s),
n AS (SELECT id, whole, {_YEARLESS.format("beside")} AS b, {_YEARLESS.format("runs")} AS r FROM m)
SELECT id, CASE WHEN whole <> '' THEN {_NUM.format("whole")} WHEN len(b) > 0 THEN CASE WHEN len(b) = 1 THEN b[1] END WHEN len(r) = 1 THEN r[1] END AS amount FROM n"""
)
def money_parse(spark, d):
    return lines(spark, d).select("id", M.parse_amount(F.col("text")).alias("amount"))


_CODE = "CASE lower(t) " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in M.CODES.items()) + " END"


@query(f"WITH {LINES}, f AS (SELECT id, list_distinct(list_transform(regexp_extract_all({_S}, {quoted('(?i)(' + M.CURRENCY + ')')}, 1), lambda t: {_CODE})) AS c FROM ln) SELECT id, CASE WHEN len(c) = 1 THEN c[1] END AS currency FROM f")
def currency_code(spark, d):
    return lines(spark, d).select("id", M.currency_code(F.col("text")).alias("currency"))


@query(f"WITH {LINES}, g AS (SELECT id, unnest(regexp_extract_all({_S}, {quoted(M.GROUP)})) AS t FROM ln), k AS (SELECT id, CAST(replace(regexp_replace(t, '[.,]+$', ''), ',', '') AS DOUBLE) AS v FROM g WHERE NOT {_YEAR.format('t', 2035)}) SELECT id, count(*) AS n, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS total FROM k WHERE v >= 1000 GROUP BY id")
def amount_scan(spark, d):
    rows = lines(spark, d).select("id", F.explode(M.scan_amounts(F.col("text"))).alias("v"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"WITH {LINES} SELECT id, array_to_string(list_sort(list_transform(regexp_extract_all(text, '[0-9][0-9,.]*'), lambda t: round(CAST(rtrim(replace(t, ',', ''), '.') AS DOUBLE), 2))), ';') AS numbers FROM ln")
def number_multiset(spark, d):
    numbers = F.transform(M.number_multiset(F.col("text")), lambda x: x.cast("string"))
    return lines(spark, d).select("id", F.array_join(numbers, ";").alias("numbers"))


# ---------------------------------------------------------------- language and type

_COUNT = "len(regexp_extract_all({}, {}))"


# Arabic letters for a to z.
ARABIC_LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنه"
FORMS = f"""fm AS (SELECT doc_id AS id, form, CASE form WHEN 0 THEN text WHEN 1 THEN 'إجمالي  المبلغ ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', '{ARABIC_LETTERS}') WHEN 2 THEN 'فاتورة رقم INV' || doc_id || E'\\nTotal   due\\n' || text ELSE '12 ' || doc_id END AS text
  FROM documents, (VALUES (0), (1), (2), (3)) v(form))"""


def forms(spark, d):
    """Every document's whole text, as it is (form 0), in Arabic letters (1) and below the head of an invoice (2), and its id without a letter (3)."""
    i, text = F.col("doc_id").cast("string"), F.col("text")
    rows = F.array(text, F.concat(F.lit("إجمالي  المبلغ "), F.translate(text, "abcdefghijklmnopqrstuvwxyz", ARABIC_LETTERS)), F.concat(F.lit("فاتورة رقم INV"), i, F.lit("\nTotal   due\n"), text), F.concat(F.lit("12 "), i))
    return L.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(rows).alias("form", "text"))


@query(f"WITH {FORMS}, c AS (SELECT id, form, {_COUNT.format("coalesce(text, '')", quoted('[؀-ۿ]'))} AS a, {_COUNT.format("coalesce(text, '')", quoted('[A-Za-z]'))} AS l FROM fm) SELECT id, form, CASE WHEN a + l = 0 THEN 'unknown' WHEN a / (a + l) > 0.7 THEN 'arabic' WHEN a / (a + l) < 0.3 THEN 'english' ELSE 'mixed' END AS language FROM c")
def detect_language(spark, d):
    return forms(spark, d).select("id", "form", T.detect_language(F.col("text")).alias("language"))


@query(
    f"""WITH {FORMS} SELECT id, form, array_to_string(list_transform(string_split(text, E'\\n'), lambda x: CASE WHEN length(x) > 0 AND {_COUNT.format('x', quoted(T.ARABIC))} / length(x) >= 0.2 THEN trim(regexp_replace(translate(regexp_replace(x, {quoted(T.DIACRITICS)}, '', 'g'), 'إأآى', 'اااي'), '\\s+', ' ', 'g')) ELSE trim(regexp_replace(x, '\\s+', ' ', 'g')) END), E'\\n') AS text FROM fm"""
)
def normalize_text(spark, d):
    return forms(spark, d).select("id", "form", T.normalize_mixed(F.col("text")).alias("text"))


HEADS = [("Tax Invoice no 7: subtotal, VAT, total due", "scan_1.pdf"), ("Agreement between A and B, effective date", "doc.pdf"), ("Balance sheet: assets, liabilities and equity", "fs.pdf"), ("IBAN, opening balance, debit, credit, transaction", "stmt.pdf"), ("Independent auditor: audit report, auditor's opinion", "a.pdf"), ("Nothing to see", "payment-certificate_3.pdf"), ("Resolved that the motion be carried unanimously", "r.pdf"), ("Bill of quantities and take-off, measured quantities", "m.pdf"), ("كشف حساب مدين دائن", "x.pdf"), ("hello", "hello.pdf")]
_HEADS = "(VALUES " + ", ".join(f"({i}, {quoted(t)}, {quoted(f)})" for i, (t, f) in enumerate(HEADS)) + ") h(k, head, filename)"
_NAME = "regexp_replace(lower(filename), '[^a-z0-9؀-ۿ]+', ' ', 'g')"
_TITLE = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({where}, {quoted(p)}) THEN {quoted(t)} END" for where in (_NAME, "lower(left(head, 600))") for t, p in T.TITLES) + ")"
_SCORES = ", ".join("(" + " + ".join(f"{w} * least({_COUNT.format('lower(head)', quoted(p))}, 3) + CASE WHEN regexp_matches({_NAME}, {quoted(p)}) THEN {max(1, w // 2)} ELSE 0 END" for p, w in rules) + f") AS {kind}" for kind, rules in T.VOCABULARY)
_BEST = "CASE " + " ".join(f"WHEN {k} = m THEN {quoted(k)}" for k, _ in T.VOCABULARY) + " END"


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, head, filename FROM orders JOIN {_HEADS} ON o_orderkey % {len(HEADS)} = k), s AS (SELECT id, {_TITLE} AS title_type, {_SCORES} FROM x), b AS (SELECT *, greatest({", ".join(k for k, _ in T.VOCABULARY)}) AS m FROM s)
SELECT id, coalesce(title_type, '') AS title_type, CASE WHEN m >= {T.LEAST_SCORE} THEN {_BEST} ELSE 'unknown' END AS vocabulary_type FROM b"""
)
def classify_documents(spark, d):
    pair = F.element_at(F.array(*(F.struct(F.lit(t).alias("head"), F.lit(f).alias("filename")) for t, f in HEADS)), (F.col("o_orderkey") % len(HEADS) + 1).cast("int"))
    rows = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pair.alias("p"))
    return rows.select("id", F.coalesce(T.title_type(F.col("p.head"), F.col("p.filename")), F.lit("")).alias("title_type"), T.vocabulary_type(F.col("p.head"), F.col("p.filename")).alias("vocabulary_type"))


# ---------------------------------------------------------------- registers and chunks


@query(
    """WITH e AS (SELECT user_id AS page_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_no, strftime(ts, '%d/%m/%Y') AS day, format('{:,.2f}', value + 1000) AS amt FROM events), n AS (SELECT page_id FROM e GROUP BY 1 HAVING count(*) >= 3)
SELECT page_id, CAST(row_no AS INTEGER) AS row_no, day || ' | TXN-' || event_id || ' | ' || amt AS row FROM e WHERE page_id IN (SELECT page_id FROM n)"""
)
def register_rows(spark, d):
    """Registers rendered from events with a cell on each line and identifiers cut at the hyphen, and put together again."""
    e = L.table(spark, d, "events")
    cells = F.concat_ws("\n", F.date_format("ts", "dd/MM/yyyy"), F.lit("TXN-"), F.col("event_id").cast("string"), F.format_number(F.col("value") + 1000, 2))
    page = e.groupBy(F.col("user_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", cells.alias("c")))).alias("x"))
    pages = page.select("page_id", F.concat(F.lit("Statement\nDebit\nCredit\n"), F.array_join(F.transform("x", lambda v: v["c"]), "\n")).alias("text"))
    return D.register_rows(pages)


@query(
    """WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, '[TABLE ROW] ' || strftime(ts, '%Y-%m-%d') || ' | TXN-' || event_id || ' | ' || format('{:,.2f}', value) AS line FROM events),
s AS (SELECT user_id, i, 0 AS chunk, length(line) + 1 AS size, line FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, s.chunk + CASE WHEN 40 + s.size + length(r.line) + 1 > 200 THEN 1 ELSE 0 END, CASE WHEN 40 + s.size + length(r.line) + 1 > 200 THEN 0 ELSE s.size END + length(r.line) + 1, r.line FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
SELECT user_id, chunk AS chunk_index, '[TABLE ROW] columns: date | ref | amount' || string_agg(chr(10) || line, '' ORDER BY i) AS text FROM s GROUP BY user_id, chunk"""
)
def row_chunks(spark, d):
    """A fold over the rows of each register, which in SQL is a recursion."""
    e = L.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("TXN-"), F.col("event_id").cast("string")), F.format_number("value", 2)).alias("row")))).alias("x"))
    rows = F.transform("x", lambda v: v["row"])
    return e.select("user_id", F.posexplode(D.chunk_rows(F.lit("date | ref | amount"), rows, 200)).alias("chunk_index", "text"))


def _split_sql(size: int = 800, overlap: int = 150) -> str:
    """Levels of pieces by separator, runs of short neighbours, and a recursion that puts the pieces of a run together."""
    blanks, seps = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)", D.SEPARATORS
    levels = ["l0 AS (SELECT doc_id AS page_id, CAST([] AS INTEGER[]) AS parent, CAST([] AS INTEGER[]) AS path, text AS piece FROM documents WHERE text IS NOT NULL)"]
    for k, sep in enumerate(seps, 1):
        s = " || ".join(f"chr({ord(c)})" for c in sep)
        cut = f"SELECT page_id, path, string_split(piece, {s}) AS parts FROM l{k - 1} WHERE length(piece) > {size}"
        levels.append(f"l{k} AS (SELECT * FROM (SELECT page_id, path AS parent, list_append(path, CAST(i AS INTEGER)) AS path, CASE WHEN i = 1 THEN '' ELSE {s} END || parts[i] AS piece FROM ({cut}) c, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) r) WHERE piece <> '')")
    n = len(seps)
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, n + 1))
    alone = f"SELECT page_id, path, piece FROM l0 WHERE length(piece) <= {size} UNION ALL SELECT page_id, path, piece FROM pieces WHERE length(piece) = {size}"
    windows = f"SELECT page_id, path, CAST(i AS INTEGER) AS s, substr(piece, i * {size - overlap} + 1, {size}) AS part FROM l{n}, LATERAL (SELECT unnest(range(0, 1 + CAST(ceil((length(piece) - {size}) / {size - overlap}) AS INTEGER))) AS i) r WHERE length(piece) > {size}"
    end = f"len(list_filter(c, lambda x: x <= c[{{}} + 1] + {size})) - 1"
    start = f"len(list_filter(c, lambda x: x < greatest(c[e + 1] - {overlap}, c[e + 2] - {size})))"
    return f"""WITH RECURSIVE {", ".join(levels)}, pieces AS ({every}),
numbered AS (SELECT *, sum(CASE WHEN length(piece) >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, parent ORDER BY path) AS run FROM pieces),
summed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY page_id, parent, run ORDER BY path) AS upto FROM numbered WHERE length(piece) < {size}),
runs AS (SELECT page_id, min(path) AS path, list(piece ORDER BY path) AS ps, list_prepend(0, list(CAST(upto AS INTEGER) ORDER BY path)) AS c FROM summed GROUP BY page_id, parent, run),
merged AS (SELECT page_id, path, ps, c, 0 AS s, CAST({end.format("0")} AS INTEGER) AS e FROM runs
  UNION ALL SELECT page_id, path, ps, c, CAST(b AS INTEGER), CAST({end.format("b")} AS INTEGER) FROM (SELECT page_id, path, ps, c, {start} AS b FROM merged WHERE e < len(ps))),
parts AS (SELECT page_id, path, s, array_to_string(ps[s + 1:e], '') AS part FROM merged UNION ALL SELECT page_id, path, 0, piece FROM ({alone}) UNION ALL {windows}),
trimmed AS (SELECT page_id, path, s, trim(part, {blanks}) AS text FROM parts)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY path, s) - 1 AS INTEGER) AS chunk_index, text FROM trimmed WHERE length(text) >= {D.LEAST_CHUNK}"""


@query(_split_sql())
def text_chunks(spark, d):
    """Parts of whole texts, cut at separators by their rank."""
    return D.text_chunks(L.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


@query("SELECT doc_id, chunk_index, arg_max(text, version) AS text, max(version) AS version FROM (SELECT conv_id AS doc_id, turn // 2 AS chunk_index, text, turn * 10 + CASE role WHEN 'user' THEN 1 ELSE 2 END AS version FROM conversations) GROUP BY ALL")
def chunk_upsert(spark, d):
    """Chunks stored in two goes, the second of other documents and of newer and older versions, and read again."""
    c = L.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("chunk_index"), "text", (F.col("turn") * 10 + F.when(F.col("role") == "user", 1).otherwise(2)).alias("version"))
    path = new_folder(spark, "chunks")
    store.store_chunks(c.where("version % 3 = 0"), path)
    store.store_chunks(c.where("version % 3 != 0"), path)
    return store.read_chunks(spark, path).select("doc_id", "chunk_index", "text", "version")


@query("SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS chunks FROM documents LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = doc_id")
def chunk_counts(spark, d):
    return R.counts(L.table(spark, d, "documents").select("doc_id"), L.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")))


# ---------------------------------------------------------------- queries

QUESTIONS = ["Reconcile INV-2024-0837 with C/MOH/2023/041", "What is the total?", "Is CON.21.A versus CON.21.B a mismatch", "PLAIN WORDS ONLY", "", "inv-2024-1 INV-2024-1 ABC-1 ABC-2 ABC-3 ABC-4 ABC-5 ABC-6"]
_QUESTIONS = "(VALUES " + ", ".join(f"({i}, {quoted(q)})" for i, q in enumerate(QUESTIONS)) + ") q(k, question)"
_TOKENS = "list_filter(regexp_extract_all(question, '\\b([A-Z0-9][A-Z0-9\\-_/.]{3,})\\b', 1), lambda t: regexp_matches(t, '[0-9_/.-]'))"


def questions(spark, d):
    return L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("o_orderkey") % len(QUESTIONS) + 1).cast("int")).alias("question"))


@query(f"SELECT o_orderkey AS id, array_to_string(list_slice({_TOKENS}, 1, 5), ' ') AS tokens FROM orders JOIN {_QUESTIONS} ON o_orderkey % {len(QUESTIONS)} = k")
def id_tokens(spark, d):
    return questions(spark, d).select("id", F.array_join(T.id_tokens(F.col("question")), " ").alias("tokens"))


@query(f"SELECT o_orderkey AS id, CASE WHEN {any_of('lower(question)', T.GRAPH_WORDS)} OR len({_TOKENS}) > 0 THEN 'graph' ELSE 'vector' END AS route FROM orders JOIN {_QUESTIONS} ON o_orderkey % {len(QUESTIONS)} = k")
def route(spark, d):
    return questions(spark, d).select("id", T.route(F.col("question")).alias("route"))


_CHECKS = "(VALUES " + ", ".join(f"({i}, {quoted(x[1])}, {quoted(x[2])})" for i, x in enumerate(Z.CHECKS)) + ") c(k, description, check_type)"
_BLOB = "lower(description || ' ' || check_type)"
_BANKISH = f"(check_type IN ('amount_match', 'cross_doc_consistency') AND {any_of(_BLOB, T.BANK_WORDS)})"


@query(
    LEDGER
    + f""", n(k, need) AS (VALUES {", ".join(f"({i}, {x[0]!r}::VARCHAR[])" for i, x in enumerate(Z.CHECKS))}), aud AS (SELECT audit_id, list(DISTINCT doc_type) AS types FROM documents_meta GROUP BY 1), i AS (SELECT k AS check_no, concat_ws(',', CASE WHEN {_BANKISH} THEN 'bank_contract_recon' END, CASE WHEN {_BANKISH} AND {any_of(_BLOB, T.INVOICE_WORDS)} THEN 'invoice_bank_recon' END,
  CASE WHEN {_BANKISH} AND {any_of(_BLOB, T.MILESTONE_WORDS)} THEN 'milestone_bank_recon' END, CASE WHEN check_type = 'date_consistency' OR {any_of(_BLOB, T.SCHEDULE_WORDS)} THEN 'schedule' END) AS x FROM {_CHECKS})
SELECT a.audit_id, i.check_no, CASE WHEN x = '' THEN 'generic' ELSE x END AS intents FROM i JOIN n ON i.check_no = n.k JOIN aud a ON list_has_all(a.types, n.need)"""
)
def check_intents(spark, d):
    """The intents of the checks that each audit's documents ask for."""
    held = Z.checklist(L.documents_meta(spark, d), spark).where("check_no > 0").select("audit_id", "check_no")
    said = Z.checks(spark).select("check_no", T.check_intents(F.col("description"), F.col("check_type")).alias("intents"))
    return held.join(F.broadcast(said), "check_no").select("audit_id", (F.col("check_no") - 1).alias("check_no"), "intents")


_COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS rank FROM n a, n b WHERE a.vec_id % 100 = 0) SELECT query_id, vec_id, rank FROM r WHERE rank <= 10")
def cosine_topk(spark, d):
    """The ten nearest of every hundredth vector among all."""
    v = L.table(spark, d, "embeddings").select("vec_id", "embedding")
    found = R.vector_top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v, 10)
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'that', 'with']) ORDER BY doc_id LIMIT 50")
def keyword_search(spark, d):
    return R.keyword_matches(L.table(spark, d, "documents"), "The THAT a with", 50).select("doc_id")


HITS = "hit AS (SELECT doc_id % 20 AS audit_id, doc_id, doc_id % 3 AS page, doc_id % 4 AS query_order, doc_id AS rank, text FROM documents)"


@query(f"WITH {HITS}, f AS (SELECT audit_id, md5(doc_id || '-' || page || '-' || left(text, 120)) AS hit, min(ROW(query_order, rank, doc_id)) AS f FROM hit GROUP BY 1, 2), r AS (SELECT audit_id, hit, row_number() OVER (PARTITION BY audit_id ORDER BY f) AS position FROM f) SELECT * FROM r WHERE position <= 25")
def multi_query_topk(spark, d):
    i = F.col("doc_id")
    hits = L.table(spark, d, "documents").select((i % 20).alias("audit_id"), "doc_id", (i % 3).alias("page"), (i % 4).alias("query_order"), i.alias("rank"), "text")
    return R.distinct_hits(hits, 25).select("audit_id", "hit", F.col("position").cast("long").alias("position"))


@query(
    """WITH u AS (SELECT 'keyword' AS source, 0 AS p, doc_id, text, CAST(n_chars AS DOUBLE) AS score FROM documents WHERE contains(text, 'tion') UNION ALL SELECT 'vector', 1, doc_id, text, 0.5 FROM documents WHERE lang = 'en' UNION ALL SELECT 'graph', 2, doc_id, text, 0.0 FROM documents)
SELECT source, doc_id, score FROM u QUALIFY row_number() OVER (PARTITION BY left(text, 100) ORDER BY p, score DESC, doc_id) = 1"""
)
def hybrid_merge(spark, d):
    t = L.table(spark, d, "documents")
    return R.merge_hits(t.where("contains(text, 'tion')").withColumn("score", F.col("n_chars")), t.where("lang = 'en'").withColumn("score", F.lit(0.5)), t.withColumn("score", F.lit(0.0))).select("source", "doc_id", "score")


@query("SELECT doc_id, CAST(CASE WHEN n <= 5 THEN 50 WHEN n <= 15 THEN least(65, 80) ELSE 80 END AS INTEGER) AS k FROM (SELECT doc_id, n_chars // 2000 + 1 AS n FROM documents)")
def adaptive_k(spark, d):
    return L.table(spark, d, "documents").select("doc_id", R.adaptive_k(F.floor(F.col("n_chars") / 2000) + 1, 50, 80).alias("k"))


_NAME = "'C' || translate(CAST({0} AS VARCHAR), '0123456789', 'abcdefghij')"
_FOUND = f"""ch AS (SELECT o_orderkey AS doc_id, o_custkey, 'INV-' || year(o_orderdate) || '-' || o_orderkey AS ref, 'Invoice INV-' || year(o_orderdate) || '-' || o_orderkey || ' of ' || {_NAME.format("o_custkey")} || ', ' || o_orderpriority AS text FROM orders),
q AS (SELECT c_custkey AS question_id, c_custkey // 100 % 3 AS kind, {_NAME.format("c_custkey")} AS name, ref FROM customer LEFT JOIN (SELECT o_custkey, arg_min(ref, doc_id) AS ref FROM ch GROUP BY 1) f ON c_custkey = o_custkey WHERE c_custkey % 100 = 0),
kw AS (SELECT question_id, doc_id, 1.0::DOUBLE AS score, text FROM q, ch WHERE kind <> 1 AND q.ref IS NOT NULL AND list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), list_filter(regexp_extract_all(lower(q.ref), '[a-z0-9]+'), lambda t: length(t) >= 2)) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY doc_id) <= 5),
near AS (SELECT question_id, v.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cosine, text FROM q JOIN embeddings a ON a.vec_id = question_id, embeddings v JOIN ch ON ch.doc_id = v.vec_id QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, v.vec_id) <= 10),
every AS (SELECT question_id, 0 AS p, 'keyword' AS source, doc_id, score, text FROM kw UNION ALL SELECT question_id, 1, 'vector', doc_id, round(cosine, 4), text FROM near
  UNION ALL SELECT question_id, 2, 'graph', doc_id, 0.0, text FROM q JOIN ch ON o_custkey = question_id WHERE kind = 0),
found AS (SELECT *, row_number() OVER (PARTITION BY question_id, left(text, 100) ORDER BY p, score DESC, doc_id) = 1 AS kept FROM every)"""


def _asked(spark, d):
    """Questions about every hundredth customer and the vectors that stand for them; all orders as chunks, with the graph of customers and orders."""
    name = lambda c: F.concat(F.lit("C"), F.translate(c.cast("string"), "0123456789", "abcdefghij"))
    orders, v = L.table(spark, d, "orders"), L.table(spark, d, "embeddings")
    ref = F.concat_ws("-", F.lit("INV"), F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string"))
    chunks = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Invoice "), ref, F.lit(" of "), name(F.col("o_custkey")), F.lit(", "), "o_orderpriority").alias("text"))
    first = orders.groupBy("o_custkey").agg(F.min_by(ref, "o_orderkey").alias("ref"))
    own, kind = name(F.col("c_custkey")), F.floor(F.col("c_custkey") / 100) % 3
    question = F.when(kind == 0, F.concat(F.lit("reconcile invoices of "), own, F.coalesce(F.concat(F.lit(" with "), "ref"), F.lit("")))).when(kind == 1, F.concat(F.lit("how much does "), own, F.lit(" owe"))).otherwise(F.concat(F.lit("is it paid: "), F.coalesce("ref", F.lit("?"))))
    asked = L.table(spark, d, "customer").where("c_custkey % 100 = 0").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").join(v.select(F.col("vec_id").alias("c_custkey"), F.col("embedding").alias("query")), "c_custkey", "left")
    questions = asked.select(F.col("c_custkey").alias("question_id"), question.alias("question"), "query")
    edges = orders.select(name(F.col("o_custkey")).alias("src"), ref.alias("dst"))
    entities = orders.select(ref.alias("entity_id"), F.col("o_orderkey").alias("doc_id"), F.lit("invoice").alias("value")).unionByName(orders.select(name(F.col("o_custkey")).alias("entity_id"), F.lit(None).cast("long").alias("doc_id"), name(F.col("o_custkey")).alias("value")).distinct())
    return questions, R.search_many(questions, chunks, 10, v.select("vec_id", "embedding"), edges, entities)


@query(f"WITH {_FOUND} SELECT question_id, source, doc_id, score FROM found WHERE kept")
def search_many(spark, d):
    """Many questions at once: by identifier, by vector and by graph."""
    return _asked(spark, d)[1].where("kept").select("question_id", "source", "doc_id", "score")


@query(
    f"""WITH {_FOUND}, n AS (SELECT question_id, count(*) FILTER (source = 'keyword') AS keyword_count, count(*) FILTER (source = 'vector') AS vector_count, count(*) FILTER (source = 'graph') AS graph_count, count(*) FILTER (kept) AS total FROM found GROUP BY 1)
SELECT q.question_id, CASE WHEN kind <> 1 AND coalesce(graph_count, 0) > 0 THEN 'graph' ELSE 'vector' END AS route, coalesce(keyword_count, 0) AS keyword_count, coalesce(vector_count, 0) AS vector_count, coalesce(graph_count, 0) AS graph_count, coalesce(total, 0) AS total, CASE WHEN kind = 1 THEN '' ELSE coalesce(ref, '') END AS ids FROM q LEFT JOIN n ON n.question_id = q.question_id"""
)
def search_summaries(spark, d):
    """What each of these questions has found, and by which route."""
    rows = R.search_summaries(*_asked(spark, d))
    return rows.withColumn("ids", F.array_join("id_tokens", ",")).drop("id_tokens")


# ---------------------------------------------------------------- state


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def chat_last_n(spark, d):
    return Z.last_n(L.table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("WITH b AS (SELECT user_id AS key, max(ts) AS last_beat FROM events GROUP BY 1) SELECT key, strftime(last_beat, '%Y-%m-%d %H:%M:%S') AS last_beat FROM b WHERE last_beat < (SELECT max(ts) FROM events) - INTERVAL 120 SECONDS")
def heartbeat_stale(spark, d):
    beats = Z.stale(L.table(spark, d, "events").select(F.col("user_id").alias("key"), "ts"))
    return beats.select("key", F.date_format("last_beat", "yyyy-MM-dd HH:mm:ss").alias("last_beat"))


_AGENT = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"


@query(f"WITH a AS (SELECT user_id AS audit_id, event_id AS seq, {_AGENT} AS agent FROM events), f AS (SELECT *, max(agent) OVER (PARTITION BY audit_id ORDER BY seq) AS furthest FROM a) SELECT audit_id, seq, CAST(furthest AS INTEGER) AS furthest, furthest > agent AS repeated FROM f")
def agent_status_fold(spark, d):
    agent = F.expr(_AGENT)
    return Z.agent_status(L.table(spark, d, "events").select(F.col("user_id").alias("audit_id"), F.col("event_id").alias("seq"), agent.alias("agent"))).select("audit_id", "seq", "furthest", "repeated")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, d):
    rows = L.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return eventlog.tumbling(rows).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, d):
    rows = L.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return eventlog.sessions(rows).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


@query("SELECT user_id AS audit_id, event_id AS seq FROM events WHERE event_id >= 500")
def event_replay(spark, d):
    return Z.replay(L.table(spark, d, "events").select(F.col("user_id").alias("audit_id"), F.col("event_id").alias("seq")), 500)


_RULES = "(VALUES (0, []::VARCHAR[], 'self_reference', 'high', 2), " + ", ".join(f"({i + 1}, {x[0]!r}::VARCHAR[], {quoted(x[2])}, {quoted(x[3])}, 1)" for i, x in enumerate(Z.CHECKS)) + ") r(check_no, needs, check_type, priority, least_docs)"


@query(LEDGER + f", h AS (SELECT audit_id, list(DISTINCT doc_type) AS types, count(*) AS docs FROM documents_meta GROUP BY 1) SELECT audit_id, CAST(check_no AS INTEGER) AS check_no, check_type, priority FROM h, {_RULES} WHERE list_has_all(types, needs) AND docs >= least_docs")
def checklist_rules(spark, d):
    return Z.checklist(L.documents_meta(spark, d), spark)


@query("WITH p AS (SELECT c_nationkey AS audit_id, 'Check ' || c_mktsegment AS description FROM customer WHERE c_acctbal > 5000), f AS (SELECT c_nationkey AS audit_id, upper('check ' || c_mktsegment) AS description FROM customer) SELECT * FROM p UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.audit_id = f.audit_id AND lower(trim(p.description)) = lower(trim(f.description)))")
def replan_union(spark, d):
    c = L.table(spark, d, "customer")
    text = F.concat(F.lit("Check "), F.col("c_mktsegment"))
    return Z.union_new(c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("audit_id"), text.alias("description")), c.select(F.col("c_nationkey").alias("audit_id"), F.upper(text).alias("description")))


@query("WITH h AS (SELECT o_orderkey AS id, sha1(unhex('6f3a8f5a2c1b4d3e8a9f1b2c3d4e5f6a') || encode('contract_id::ctr' || o_orderkey)) AS h FROM orders) SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::BIGINT % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS entity_id FROM h")
def entity_ids(spark, d):
    key = F.concat(F.lit("contract_id::"), T.identifier_core(F.concat(F.lit("CTR-"), F.col("o_orderkey").cast("string"))))
    return L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.uuid5("6f3a8f5a2c1b4d3e8a9f1b2c3d4e5f6a", key).alias("entity_id"))


@query(LEDGER + f", a AS (SELECT entity_id, CASE WHEN audit_id % 2 = 0 THEN 'bank_statement' ELSE doc_type END AS dt, amount_role AS r FROM amounts) SELECT entity_id, CASE WHEN dt = 'bank_statement' AND r NOT IN ({', '.join(map(quoted, X.BANK_ROLES))}) THEN 'unknown' ELSE r END AS role FROM a")
def role_demotion(spark, d):
    """Roles that a document's type can't carry become unknown; here every second audit calls all its documents bank statements."""
    kind = F.when(F.col("audit_id") % 2 == 0, "bank_statement").otherwise(F.col("doc_type"))
    return L.amounts(spark, d).select("entity_id", X.role_for_type(F.col("amount_role"), kind).alias("role"))


# ---------------------------------------------------------------- grounding


SAID = "sd AS (SELECT o_custkey AS audit_id, o_orderkey AS finding_id, CASE WHEN o_orderstatus = 'P' THEN 'warning' ELSE 'critical' END AS severity, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders)"


#: Orders whose texts are one task's: a table may lie in fewer pieces than there are cores, and to search a text takes longer than to move its order.
TEXTS = 100_000


def said(spark, d, dealt_out=False):
    """A finding for each order that names a contract, an invoice and a payment. dealt_out: in partitions of TEXTS orders, however they lie."""
    price = lambda x: F.format_number(F.col("o_totalprice").cast("decimal(18,2)").cast("double") * x, 2)
    orders = L.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return dealt(orders, partitions(orders, TEXTS) if dealt_out else None, "o_orderkey").select(
        F.col("o_custkey").alias("audit_id"), F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_orderstatus") == "P", "warning").otherwise("critical").alias("severity"), F.concat(F.lit("Contract of EGP "), price(1)).alias("title"),
        F.concat(F.lit("It was billed at "), price(2), F.lit(" EGP, and the bank paid EGP "), price(4)).alias("description"), F.array(*(F.concat(F.lit(k), F.col("o_orderkey").cast("string"), F.lit(".pdf: EGP "), price(x)) for k, x in (("contract_", 1), ("invoice_", 2)))).alias("evidence"),
    )


@query(f"WITH {SAID}, c AS (SELECT audit_id, CAST(max(t) AS DOUBLE) AS m FROM sd WHERE severity = 'critical' AND t >= 1000 GROUP BY 1), i AS (SELECT audit_id, CAST(max(t) AS DOUBLE) * 2 AS m FROM sd WHERE severity = 'critical' AND CAST(t AS DOUBLE) * 2 >= 1000 GROUP BY 1), b AS (SELECT audit_id, CAST(max(t) AS DOUBLE) * 4 AS m FROM sd WHERE severity = 'critical' AND CAST(t AS DOUBLE) * 4 >= 1000 GROUP BY 1) SELECT audit_id, 'contract_total' AS field, m AS value FROM c UNION ALL SELECT audit_id, 'invoice_total', m FROM i UNION ALL SELECT audit_id, 'bank_paid_total', m FROM b")
def label_amounts(spark, d):
    return K.label_amounts(said(spark, d, True))


@query(
    f"""WITH snap AS ({ORACLES["recon_snapshot"]}), {SAID}, lab AS (SELECT audit_id, CAST(max(t) FILTER (t >= 1000) AS DOUBLE) AS c, CAST(max(t) FILTER (2 * t >= 1000) AS DOUBLE) * 2 AS i, CAST(max(t) FILTER (4 * t >= 1000) AS DOUBLE) * 4 AS b FROM sd WHERE severity = 'critical' GROUP BY 1),
u AS (SELECT snap.*, contract_total IS NULL AND c IS NOT NULL AS uc, invoice_total IS NULL AND i IS NOT NULL AS ui, bank_paid_total IS NULL AND NOT bank_extraction_incomplete AND b IS NOT NULL AS ub, c, i, b FROM snap LEFT JOIN lab USING (audit_id)),
f AS (SELECT * REPLACE (CASE WHEN uc THEN c ELSE contract_total END AS contract_total, CASE WHEN ui THEN i ELSE invoice_total END AS invoice_total, CASE WHEN ub THEN b ELSE bank_paid_total END AS bank_paid_total) FROM u)
SELECT audit_id, currency, contract_total, invoice_total, bank_paid_total, CASE WHEN (uc OR ui OR ub) AND bank_paid_total IS NOT NULL AND contract_total IS NOT NULL THEN round(bank_paid_total - contract_total, 2) ELSE variance_vs_contract END AS variance_vs_contract, bank_extraction_incomplete, bank_debits_verified, bank_debits_stated,
  concat_ws(' ', nullif(notes, ''), CASE WHEN uc OR ui OR ub THEN 'Inferred from labeled finding text: ' || concat_ws(', ', CASE WHEN uc THEN 'contract' END, CASE WHEN ui THEN 'invoice' END, CASE WHEN ub THEN 'bank paid' END) || '.' END) AS notes, integrity_warnings FROM f"""
)
def snapshot_filled(spark, d):
    """Snapshots with their gaps filled."""
    rows = L.ledger(spark, d)
    return K.fill_gaps(S.snapshot(rows, *links(spark, d, rows)), K.label_amounts(said(spark, d, True)))


_FORMS = " OR ".join(f"contains(line, format('{{{{:{f}}}}}', v))" for f in (",.2f", ",.0f", ".2f", ".0f"))


@query(
    LEDGER + f""", {SAID}, v AS (SELECT audit_id, finding_id, unnest(list_distinct([round(CAST(t AS DOUBLE), 2), round(CAST(t AS DOUBLE) * 2, 2), round(CAST(t AS DOUBLE) * 4, 2)])) AS v FROM sd),
l AS (SELECT audit_id, finding_id, 0 AS pos, 'contract_' || finding_id || '.pdf: EGP ' || format('{{:,.2f}}', CAST(t AS DOUBLE)) AS line FROM sd UNION ALL SELECT audit_id, finding_id, 1, 'invoice_' || finding_id || '.pdf: EGP ' || format('{{:,.2f}}', CAST(t AS DOUBLE) * 2) FROM sd),
q AS (SELECT v.audit_id, v.finding_id, v, arg_min(doc_id, ROW(pos, doc_id)) AS quoted FROM v JOIN l USING (audit_id, finding_id) JOIN documents_meta m ON m.audit_id = v.audit_id AND starts_with(line, filename) WHERE v >= 1000 AND ({_FORMS.replace("{{", "{").replace("}}", "}")}) GROUP BY ALL),
o AS (SELECT audit_id, round(CAST(amount_value AS DOUBLE), 2) AS v, min(doc_id) AS owner FROM amounts GROUP BY 1, 2 HAVING count(DISTINCT doc_id) = 1),
g AS (SELECT audit_id, finding_id, v, coalesce(quoted, owner) AS doc_id FROM v LEFT JOIN q USING (audit_id, finding_id, v) LEFT JOIN o USING (audit_id, v) WHERE v >= 1000 AND coalesce(quoted, owner) IS NOT NULL),
k AS (SELECT g.*, doc_type, row_number() OVER (PARTITION BY g.audit_id, finding_id ORDER BY CASE doc_type WHEN 'contract' THEN 1 WHEN 'invoice' THEN 2 WHEN 'payment_certificate' THEN 3 WHEN 'bank_statement' THEN 4 ELSE 5 END, v DESC, doc_id) AS rn FROM g LEFT JOIN documents_meta m USING (audit_id, doc_id)),
a AS (SELECT * FROM k WHERE rn = 1), b AS (SELECT k.* FROM k JOIN a USING (audit_id, finding_id) WHERE k.doc_id <> a.doc_id QUALIFY row_number() OVER (PARTITION BY k.audit_id, k.finding_id ORDER BY k.rn) = 1)
SELECT audit_id, finding_id, a.doc_id AS doc_a_id, format('{{:,.2f}}', a.v) AS doc_a_value, b.doc_id AS doc_b_id, format('{{:,.2f}}', b.v) AS doc_b_value, replace(coalesce(a.doc_type, 'document'), '_', ' ') || ' vs ' || replace(coalesce(b.doc_type, 'document'), '_', ' ') || ' (from finding)' AS conflict_type FROM a JOIN b USING (audit_id, finding_id)"""
)
def finding_conflicts(spark, d):
    """Conflict rows of findings with their amounts grounded."""
    return K.finding_conflicts(said(spark, d), L.documents_meta(spark, d), L.amounts(spark, d))


@query("WITH h AS (SELECT doc_id % 20 AS audit_id, doc_id % 3 AS check_no, doc_id, doc_id AS position, text FROM documents), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY audit_id, check_no, doc_id, left(text, 180) ORDER BY position) = 1) SELECT audit_id, check_no, doc_id, row_number() OVER (PARTITION BY audit_id, check_no ORDER BY position, doc_id) AS snippet_no FROM f QUALIFY row_number() OVER (PARTITION BY audit_id, check_no ORDER BY position, doc_id) <= 14")
def snippet_dedupe(spark, d):
    i = F.col("doc_id")
    hits = L.table(spark, d, "documents").select((i % 20).alias("audit_id"), (i % 3).alias("check_no"), "doc_id", i.alias("position"), "text")
    return K.snippets(hits).select("audit_id", "check_no", "doc_id", F.col("snippet_no").cast("long").alias("snippet_no"))


_DEEP = 11


@query(f"SELECT event_id, repeat('{{\"a}}\":', {_DEEP}) || props || repeat('}}', {_DEEP}) AS object FROM events")
def json_objects(spark, d):
    """The JSON object, twelve deep, out of a model's noisy answer around it."""
    deep = F.concat(F.lit('{"a}":' * _DEEP), F.col("props"), F.lit("}" * _DEEP))
    noisy = F.concat(F.lit("Here you are: ```json\n"), deep, F.lit("\n``` {unclosed"))
    return L.table(spark, d, "events").select("event_id", K.json_object(noisy).alias("object"))
