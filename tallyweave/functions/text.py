"""Identifiers, languages and document types of text, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.money import amounts_in

# Arabic letters, and marks that are left out.
ARABIC = "[؀-ۿݐ-ݿ]"
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭـ]"

# Ordered title patterns of document types.
TITLES = [
    ("payment_certificate", r"payment[\s_-]*cert|interim[\s_-]*payment|\bipc\b|\bpc[-\s]?\d{4}[-\s]?\d+|شهاد[ةه]\s*(استحقاق\s*)?(ال)?دفع|مستخلص\s*(دفع|رقم)"),
    ("board_resolution", r"board[\s_-]*resolution|board\s*(of\s*directors\s*)?(meeting\s*)?minutes|\bbr[-\s]?\d{4}[-\s]?\d+|محضر\s*اجتماع\s*مجلس|قرار\s*مجلس\s*(ال)?[إا]دار[ةه]"),
    ("qs_report", r"\bqs[\s_-]*(report|rpt)|quantity[\s_-]*survey|certification[\s_-]*report|\bqs[-\s]?rpt[-\s]?\d+|مساح[ةه]\s*(ال)?كميات|تقرير\s*(ال)?كميات"),
    ("bank_statement", r"bank[\s_-]*statement|account[\s_-]*statement|كشف\s*حساب"),
    ("invoice", r"\binvoice\b|tax\s*invoice|\binv[-\s]?[a-z]*[-\s]?\d{4}|فاتور[ةه]"),
    ("contract", r"\bcontract\b|\bagreement\b|\bsubcontract\b|عقد\s*(مقاول[ةه]|من\s*الباطن)?"),
]
# Fixed value: characters of a text's head that may hold its title.
TITLE_WINDOW = 600

# Vocabulary patterns of document types, with weights, in order.
VOCABULARY = [
    ("invoice", [(r"\binvoice\b", 3), (r"\binvoice\s*(no|number|#)\b", 5), (r"tax\s*invoice", 4), (r"\bsubtotal\b", 3), (r"\bvat\b|\bvalue\s*added\s*tax\b", 3), (r"\btotal\s*(amount|due|payable)\b", 4), (r"\bpo\s*(no|number|#)\b", 2), (r"فاتور[هة]|فواتير", 4), (r"المبلغ\s*(الاجمالي|الإجمالي|المستحق)", 4), (r"ضريب[هة]|ضريبه", 2)]),
    ("contract", [(r"\bcontract\b|\bagreement\b", 4), (r"\bbetween\b.*\band\b", 3), (r"\beffective\s*date\b|\bterm\b|\btermination\b", 3), (r"\bparty\b|\bparties\b", 2), (r"عقد|اتفاقي[هة]", 4), (r"الطرف\s*(الاول|الأول|الثاني)", 3), (r"الشروط\s*والاحكام|الشروط\s*والأحكام", 3)]),
    ("balance_sheet", [(r"balance\s*sheet", 5), (r"\bassets?\b", 3), (r"\bliabilit(y|ies)\b", 3), (r"\bequity\b|\bshareholders?\b", 3), (r"الميزاني[هة]", 5), (r"الاصول|الأصول", 3), (r"الخصوم", 3), (r"حقوق\s*الملكي[هة]", 3)]),
    ("bank_statement", [(r"bank\s*statement|account\s*statement", 5), (r"\biban\b|\bswift\b|\bbic\b", 3), (r"\btransaction(s)?\b", 3), (r"\bdebit\b|\bcredit\b", 3), (r"\bopening\s*balance\b|\bclosing\s*balance\b", 4), (r"كشف\s*حساب", 5), (r"مدين|دائن|رصيد", 3), (r"تحويل|ايداع|إيداع|سحب", 2)]),
    ("audit_report", [(r"audit\s*report", 5), (r"independent\s*auditor", 4), (r"\bauditor'?s?\s*opinion\b", 4), (r"تقرير\s*المراجع[هة]?", 5), (r"مراجع\s*حسابات", 4), (r"راي\s*المراجع|رأي\s*المراجع", 4)]),
    ("payment_certificate", [(r"payment\s*certificate", 6), (r"interim\s*payment\s*certificate|\bipc\b", 6), (r"gross\s*(certified|valuation)|amount\s*certified|certified\s*(gross|amount|payable)", 5), (r"less\s*retention|retention\s*held|previously\s*certified", 4), (r"work\s*executed\s*to\s*date|value\s*of\s*work\s*done", 3), (r"شهاد[ةه]\s*(استحقاق\s*)?(ال)?دفع|مستخلص", 6), (r"المبلغ\s*المعتمد|القيم[ةه]\s*المعتمد[ةه]", 4)]),
    ("qs_report", [(r"quantity\s*survey(or|ing)?|\bqs\s*report|certification\s*report", 6), (r"measured\s*quantit|bill\s*of\s*quantities|\bboq\b|take[-\s]*off", 4), (r"مساح[ةه]\s*(ال)?كميات|تقرير\s*(ال)?كميات|حصر\s*(ال)?كميات", 6)]),
    ("board_resolution", [(r"board\s*(of\s*directors\s*)?(meeting\s*)?(minutes|resolution)", 6), (r"\bresolved\s*(that|to)\b|quorum|\bmotion\b|unanimously", 3), (r"محضر\s*اجتماع|قرار\s*مجلس\s*(ال)?[إا]دار[ةه]|مجلس\s*(ال)?[إا]دار[ةه]", 5)]),
]
# Least score of a type, and what tells a noisy statement or invoice.
LEAST_SCORE = 5
AMOUNT_LIKE = r"[0-9][0-9,.]{2,}"
FINANCE_WORDS = r"amount|total|vat|tax|payment|invoice|statement|transaction|balance|رصيد|المبلغ|فاتور[هة]|كشف\s*حساب"
STATEMENT_WORDS = r"statement|transaction|debit|credit|كشف\s*حساب|رصيد"
LEAST_NUMBERS, LEAST_FINANCE = 5, 4

# Titles that name a signing authority, most senior first.
AUTHORITIES = [("chairman", "chairman"), ("رئيس مجلس", "chairman"), ("chief executive", "ceo"), ("ceo", "ceo"), ("المدير التنفيذي", "ceo"), ("chief financial", "cfo"), ("cfo", "cfo"), ("finance director", "director"), ("managing director", "director"), ("director", "director"), ("مدير عام", "director"), ("manager", "manager"), ("مدير", "manager")]
# Ranks of authorities.
AUTHORITY_RANKS = {"chairman": 5, "ceo": 4, "cfo": 3, "director": 2, "manager": 1, "other": 0, "unknown": 0}
# Words that call for relations between documents.
GRAPH_WORDS = ["reconcil", "contradict", "cross-document", "cross document", "across documents", "between documents", "versus", " vs ", "discrepanc", "mismatch", "linked", "traceab"]
# Words of check intents.
BANK_WORDS = ["bank", "statement", "reconcil", "payment", "paid", "transfer", "disbursement", "remittance", "deposit", "debit", "credit", "transaction", "بنك", "تحويل", "دفع", "سداد", "كشف"]
INVOICE_WORDS = ["invoice", "billed", "billing", "فاتورة"]
MILESTONE_WORDS = ["milestone", "installment", "دفعة", "مرحلة"]
SCHEDULE_WORDS = ["schedule", "due date", "payment date", "مواعيد", "جدول"]


# Shape of identifiers in questions, what one of them must hold, and what separates the words of file names.
ID_TOKEN, ID_MARK, NAME_GAPS = r"\b([A-Z0-9][A-Z0-9\-_/.]{3,})\b", "[0-9_/.-]", "[^a-z0-9؀-ۿ]+"


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def identifier_core(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")


def is_arabic(text: Column, least: float = 0.3) -> Column:
    return F.coalesce((F.length(text) > 0) & (F.regexp_count(text, F.lit(ARABIC)) / F.length(text) >= least), F.lit(False))


def detect_language(text: Column) -> Column:
    """arabic, english or mixed by the share of Arabic among Arabic and ASCII letters; unknown without either."""
    arabic, latin = F.regexp_count(text, F.lit("[؀-ۿ]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    share = F.try_divide(arabic, arabic + latin)
    return F.when(share > 0.7, "arabic").when(share < 0.3, "english").when(share.isNotNull(), "mixed").otherwise("unknown")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_arabic(text: Column) -> Column:
    return collapse(F.translate(F.regexp_replace(text, DIACRITICS, ""), "إأآى", "اااي"))


def normalize_mixed(text: Column) -> Column:
    """Line by line: Arabic rules from a fifth of Arabic characters on, else white space only."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(is_arabic(line, 0.2), normalize_arabic(line)).otherwise(collapse(line))), "\n")


def _first(pairs: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*(F.when(c, F.lit(x)) for x, c in pairs))


def plain_name(filename: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(filename, F.lit(""))), NAME_GAPS, " ")


def title_type(text: Column, filename: Column) -> Column:
    """The first type whose pattern is in the file name, else in the head of the text."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, TITLE_WINDOW))
    # inside lambdas, so that the name and the head are made once
    titled = lambda words: F.get(F.transform(F.array(words), lambda w: _first([(t, F.rlike(w, F.lit(p))) for t, p in TITLES])), F.lit(0))
    return F.coalesce(titled(plain_name(filename)), titled(head))


def vocabulary_scores(text: Column, filename: Column) -> list[tuple[str, Column]]:
    """A type's patterns are counted only where their union occurs in the text, or in the name: most types ask for one search."""
    body, name = F.lower(F.coalesce(text, F.lit(""))), plain_name(filename)
    out = []
    for kind, rules in VOCABULARY:
        union = F.lit("|".join(f"(?:{p})" for p, _ in rules))
        in_body, in_name = F.lit(0), F.lit(0)
        for pattern, weight in rules:
            in_body = in_body + weight * F.least(F.regexp_count(body, F.lit(pattern)), F.lit(3))
            in_name = in_name + F.when(F.rlike(name, F.lit(pattern)), max(1, weight // 2)).otherwise(0)
        out.append((kind, F.when(F.rlike(body, union), in_body).otherwise(0) + F.when(F.rlike(name, union), in_name).otherwise(0)))
    return out


def finance_type(text: Column) -> Column:
    """For noisy scans: with many numbers and words of money a statement or an invoice, else null."""
    body = F.lower(F.coalesce(text, F.lit("")))
    money = (F.regexp_count(body, F.lit(AMOUNT_LIKE)) >= LEAST_NUMBERS) & (F.regexp_count(body, F.lit(FINANCE_WORDS)) >= LEAST_FINANCE)
    return F.when(money, F.when(F.rlike(body, F.lit(STATEMENT_WORDS)), "bank_statement").otherwise("invoice"))


def vocabulary_type(text: Column, filename: Column) -> Column:
    """The type with the highest score from LEAST_SCORE on, the first of equals; else what finance_type() says, else unknown."""
    scored = F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(vocabulary_scores(text, filename))))
    # inside a lambda, so that the scores are computed once
    return F.transform(F.array(F.array_max(scored)), lambda best: F.when(best["score"] >= LEAST_SCORE, best["kind"]).otherwise(F.coalesce(finance_type(text), F.lit("unknown"))))[0]


def document_type(text: Column, filename: Column) -> Column:
    return F.coalesce(title_type(text, filename), vocabulary_type(text, filename))


def authority_of(title: Column) -> Column:
    t = F.lower(F.trim(title))
    return _first([(level, F.contains(t, F.lit(word))) for word, level in AUTHORITIES])


def authority_rank(level: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in AUTHORITY_RANKS.items() for x in kv))[F.lower(level)], F.lit(0))


def id_tokens(query: Column, most: int = 5) -> Column:
    """Identifier-shaped tokens with a digit or separator, the first of each spelling, at most five."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(ID_TOKEN), 1)
    kept = F.filter(found, lambda t: F.rlike(t, F.lit(ID_MARK)))
    lowered = F.transform(kept, F.lower)
    return F.slice(F.filter(kept, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1), 1, most)


def query_entities(query: Column, most: int = 5) -> Column:
    """What a question is about: its amounts, capitalised words and long numbers, and Arabic words, each once, in that order."""
    q = F.coalesce(query, F.lit(""))
    words = F.slice(F.regexp_extract_all(q, F.lit(r"(\b[A-Z][a-zA-Z]+\b|\b[0-9]{4,}\b)"), 1), 1, most)
    arabic = F.slice(F.regexp_extract_all(q, F.lit("([؀-ۿ]{3,})"), 1), 1, most)
    return F.array_distinct(F.concat(F.transform(amounts_in(q), lambda a: F.trim(a["raw"])), words, arabic))


def entity_key(kind: Column, normalized: Column, doc_id: Column, amount: Column, currency: Column, ref: Column, day: Column) -> Column:
    """What an entity's id is made of: an amount's document, currency, value and transaction; the core of a contract's or an invoice's
    number, and the name of a company or person, whatever the document; of anything else the document too."""
    k, text = F.lower(F.trim(F.coalesce(kind, F.lit("other")))), F.lower(F.trim(F.coalesce(normalized, F.lit(""))))
    doc, core, when = F.coalesce(doc_id, F.lit("")), identifier_core(ref), F.lower(F.trim(F.coalesce(day, F.lit(""))))
    code = F.coalesce(F.nullif(F.upper(F.trim(currency)), F.lit("")), F.lit("NONE"))
    txn = F.when((core != "") | (when != ""), F.concat(F.lit("::"), core, F.lit("::"), when)).otherwise("")
    of_amount = F.concat(F.lit("amount::"), doc, F.lit("::"), code, F.lit("::"), F.round(amount, 2).cast("decimal(38,2)").cast("string"), txn)
    name = F.when(k.isin("contract_id", "invoice_id"), F.coalesce(F.nullif(identifier_core(text), F.lit("")), text)).otherwise(text)
    everywhere = k.isin("contract_id", "invoice_id", "company", "person")
    return F.when((k == "amount") & amount.isNotNull(), of_amount).when(everywhere, F.concat_ws("::", k, name)).otherwise(F.concat_ws("::", k, doc, name))


def chunk_key(doc_id: Column, index: Column) -> Column:
    return F.concat_ws("::", F.lit("chunk"), doc_id, index.cast("long").cast("string"))


def relation_key(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(source, F.lit("->"), target, F.lit("::"), F.lower(F.trim(F.coalesce(kind, F.lit("other")))))


def route(query: Column) -> Column:
    q = F.trim(F.coalesce(query, F.lit("")))
    return F.when(contains_any(F.lower(q), GRAPH_WORDS) | (F.size(id_tokens(q)) > 0), "graph").otherwise("vector")


def check_intents(description: Column, check_type: Column) -> Column:
    """Intents of a check, comma-joined in a fixed order."""
    blob = F.lower(F.concat_ws(" ", description, check_type))
    bank = check_type.isin("amount_match", "cross_doc_consistency") & contains_any(blob, BANK_WORDS)
    found = F.concat_ws(
        ",",
        F.when(bank, "bank_contract_recon"),
        F.when(bank & contains_any(blob, INVOICE_WORDS), "invoice_bank_recon"),
        F.when(bank & contains_any(blob, MILESTONE_WORDS), "milestone_bank_recon"),
        F.when((check_type == "date_consistency") | contains_any(blob, SCHEDULE_WORDS), "schedule"),
    )
    return F.when(found == "", "generic").otherwise(found)


def uuid5(namespace_hex: str, key: Column) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(key, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
