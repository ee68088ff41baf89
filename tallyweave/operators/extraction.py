"""Entities out of chunks: which chunks are read, what rules find in them, and how what a model found is put in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.dealing import dealt
from tallyweave.functions.money import currency_code, parse_amount
from tallyweave.functions.text import AUTHORITY_RANKS, authority_of, chunk_key, entity_key, relation_key, uuid5
from tallyweave.operators.documents import AMOUNT, ROW_DATE, ROW_MARK

#: Name space of this engine's ids.
NAMESPACE = "6f3a8f5a2c1b4d3e8a9f1b2c3d4e5f6a"
# Roles of amounts, those that a bank statement may carry, languages.
ROLES = """total_contract_value milestone_scheduled retainer total_invoice invoice_subtotal invoice_line_item invoice_referenced_contract_value transaction_debit transaction_credit
statement_total_debits statement_total_credits running_balance opening_balance closing_balance total_assets total_liabilities total_equity vat_tax late_fee unknown""".split()
BANK_ROLES = ["transaction_debit", "transaction_credit", "statement_total_debits", "statement_total_credits", "running_balance", "opening_balance", "closing_balance", "vat_tax", "late_fee", "unknown"]
LANGUAGES = ["arabic", "english", "mixed", "unknown"]
# Least characters of a chunk that is read, and of its text that is.
LEAST_CHARS, READ_CHARS = 100, 2000
# What stands before an amount below zero: a minus with a blank or bar before it, or a bracket that closes behind the amount.
BELOW_ZERO = rf"(?:(?<![^\s|])[-\u2212]|\((?=(?:{AMOUNT})\)))"
#: Words of a line's label and the role that they give the amount after it, in order.
LABELS = [
    ("opening balance", "opening_balance"), ("closing balance", "closing_balance"), ("total debits", "statement_total_debits"), ("total credits", "statement_total_credits"), ("subtotal", "invoice_subtotal"), ("vat", "vat_tax"),
    ("late fee", "late_fee"), ("contract value", "total_contract_value"), ("contract total", "total_contract_value"), ("total due", "total_invoice"), ("invoice total", "total_invoice"), ("total amount", "total_invoice"),
    ("total assets", "total_assets"), ("total liabilities", "total_liabilities"), ("equity", "total_equity"), ("retainer", "retainer"), ("milestone", "milestone_scheduled"),
]


def readable(chunks: DataFrame, least: int = LEAST_CHARS, most: int | None = None) -> DataFrame:
    """Chunks (doc_id, chunk_index, text) with enough to read; of each document the first most by index where that is given."""
    out = chunks.where(F.length(F.trim("text")) >= least)
    if most is None:
        return out
    return out.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))).where(F.col("rn") <= most).drop("rn")


def role_for_type(role: Column, doc_type: Column) -> Column:
    """The role, or unknown if a document of this type can't carry it."""
    return F.when((doc_type == "bank_statement") & ~role.isin(BANK_ROLES), "unknown").otherwise(role)


def _one_of(value: Column, allowed: list[str], other: Column | str | None) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(allowed), v).otherwise(F.lit(other) if other is None or isinstance(other, str) else other)


def sanitised(entities: DataFrame) -> DataFrame:
    """Entities as a model gives them (chunk_id, pos, doc_id, doc_type, entity_type, value, normalized_value, amount_role, source_language,
    numeral_mismatch, signing_authority_level, role_title, txn_ref, txn_date: strings but for pos) with closed sets for what must be one,
    parsed amounts and currencies, and their ids. What only an amount, or a person, has is null elsewhere."""
    e = entities
    amount, person = F.col("entity_type") == "amount", F.col("entity_type") == "person"
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    level = _one_of(F.col("signing_authority_level"), list(AUTHORITY_RANKS), None)
    e = e.withColumns(
        {
            "normalized_value": F.coalesce("normalized_value", "value", F.lit("")),
            "source_language": _one_of(F.col("source_language"), LANGUAGES, "unknown"),
            "amount_role": F.when(amount, role_for_type(_one_of(F.col("amount_role"), ROLES, "unknown"), F.col("doc_type"))),
            "amount_value": F.when(amount, F.coalesce(parse_amount(F.col("normalized_value")), parse_amount(F.col("value")))),
            "amount_currency": F.when(amount, F.coalesce(currency_code(F.col("normalized_value")), currency_code(F.col("value")))),
            "numeral_mismatch": F.when(amount & F.col("numeral_mismatch").isNotNull(), F.lower("numeral_mismatch").isin("true", "1", "yes")),
            "txn_ref": F.when(amount, text(F.col("txn_ref"))),
            "txn_date": F.when(amount, text(F.col("txn_date"))),
            "signing_authority_level": F.when(person, F.when(F.coalesce(level, F.lit("other")).isin("other", "unknown"), F.coalesce(authority_of(F.col("role_title")), level)).otherwise(level)),
            "role_title": F.when(person, text(F.col("role_title"))),
        }
    )
    key = entity_key(F.col("entity_type"), F.col("normalized_value"), F.col("doc_id"), F.col("amount_value"), F.col("amount_currency"), F.col("txn_ref"), F.col("txn_date"))
    return e.withColumn("entity_id", uuid5(NAMESPACE, key))


def last_of_chunk(entities: DataFrame) -> DataFrame:
    """One record for an id in a chunk: the last one, at the first one's place."""
    rest = [c for c in entities.columns if c not in ("chunk_id", "entity_id", "pos")]
    return entities.groupBy("chunk_id", "entity_id").agg(F.min("pos").alias("pos"), F.max_by(F.struct(*rest), "pos").alias("r")).select("chunk_id", "entity_id", "pos", "r.*")


def with_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with the id that a document's chunk of this index always has."""
    return chunks.withColumn("chunk_id", uuid5(NAMESPACE, chunk_key(F.col("doc_id").cast("string"), F.col("chunk_index"))))


def relations(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, rel_type) with their id, each once."""
    return edges.withColumn("rel_id", uuid5(NAMESPACE, relation_key(F.col("src"), F.col("dst"), F.col("rel_type")))).dropDuplicates(["rel_id"])


def found_in(mentions: DataFrame, entities: DataFrame, documents: DataFrame, partitions: int | None = None) -> DataFrame:
    """(entity_id, doc_id) of mentions whose entity and document both exist, each once. Ids may be numbers as well as texts. What is left of the mentions is told apart where it
    lies by document. partitions: how many the mentions are dealt to."""
    known = lambda df, c: dealt(df.select(c), partitions, c).distinct()
    rows = mentions.select("entity_id", "doc_id").join(known(entities, "entity_id"), "entity_id", "left_semi")
    return dealt(rows, partitions, "doc_id").join(known(documents, "doc_id"), "doc_id", "left_semi").select("entity_id", "doc_id").distinct()


def rule_entities(chunks: DataFrame) -> DataFrame:
    """Amounts that rules find in chunks (doc_id, chunk_index, text): (doc_id, chunk_index, line_no, amount_role, raw, txn_ref, txn_date).

    A register's row has its movement last but one and its balance last: a balance that falls makes it a debit, one that rises a
    credit; the first row of a document is unknown. A balance behind a minus, or in brackets, is below zero. A row with one amount is unknown too. Elsewhere a line's label gives
    the role. Where chunks have a column about, of what is known of their document, it is part of the document's key, and amounts have it too."""
    doc = ["doc_id", *(c for c in ("about",) if c in chunks.columns)]
    is_row = lambda line: F.startswith(line, F.lit(ROW_MARK)) & ~F.contains(line, F.lit("columns:"))
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")

    def lines(chunks: DataFrame, kind: Callable[[Column], Column], more: Callable[[Column, Column], list[Column]]) -> DataFrame:
        """Lines of a kind that have amounts, with line_no, found and more of them: worked out in the chunk's row, so that each is once."""
        numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
        read = F.transform(F.filter(numbered, lambda x: kind(x["line"])), lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.regexp_extract_all(x["line"], F.lit(f"({AMOUNT})"), F.lit(1)).alias("found")))
        kept = F.transform(F.filter(read, lambda x: F.size(x["found"]) > 0), lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), x["found"].alias("found"), *more(x["line"], x["found"])))
        return chunks.select(*doc, "chunk_index", F.inline(kept))

    by_doc = Window.partitionBy(*doc).orderBy("chunk_index", "line_no")
    last = lambda line: F.try_element_at(F.regexp_extract_all(line, F.lit(f"({BELOW_ZERO}?(?:{AMOUNT}))"), F.lit(1)), F.lit(-1))
    rows = lines(chunks.where(F.contains("text", F.lit(ROW_MARK))), is_row, lambda line, found: [F.when(F.size(found) > 1, last(line)).alias("last")])
    balance = number(F.try_element_at("found", F.lit(-1)))
    rows = rows.withColumn("balance", F.when(F.rlike("last", F.lit("^[0-9]")), balance).when(F.col("last").isNotNull(), -balance))
    rows = rows.withColumn("before", F.lag("balance").over(by_doc))
    step = F.signum(F.col("balance") - F.col("before"))
    cells = F.regexp_replace(F.col("line"), r"^\[TABLE ROW\]\s*", "")
    day = F.nullif(F.trim(F.regexp_extract(cells, ROW_DATE, 0)), F.lit(""))
    ref = F.nullif(F.regexp_extract(cells, r"\b([A-Z]{2,}-[0-9A-Z-]+)\b", 1), F.lit(""))
    of_rows = rows.select(*doc, "chunk_index", "line_no", F.when(step < 0, "transaction_debit").when(step > 0, "transaction_credit").otherwise("unknown").alias("amount_role"), F.when(F.size("found") > 1, F.try_element_at("found", F.lit(-2))).otherwise(F.try_element_at("found", F.lit(-1))).alias("raw"), ref.alias("txn_ref"), day.alias("txn_date"))
    label = lambda line, found: F.lower(F.call_function("substring_index", line, F.try_element_at(found, F.lit(1)), F.lit(1)))
    role = lambda label: F.coalesce(*(F.when(F.contains(label, F.lit(w)), F.lit(r)) for w, r in LABELS))
    nothing = F.lit(None).cast("string")
    labelled = lines(chunks, lambda line: ~is_row(line), lambda line, found: [F.get(F.transform(F.array(label(line, found)), role), F.lit(0)).alias("amount_role")])
    of_labels = labelled.where("amount_role is not null").select(*doc, "chunk_index", "line_no", "amount_role", F.try_element_at("found", F.lit(1)).alias("raw"), nothing.alias("txn_ref"), nothing.alias("txn_date"))
    return of_rows.unionByName(of_labels)
