"""Findings: the gates they pass, their signatures, duplicates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.money import coarse, scan_amounts, tagged_amounts
from tallyweave.functions.text import contains_any

# Topics of signatures, in order.
TOPICS = [
    ("overpayment", ["overpay", "exceeds", "overrun", "above contract", "beyond the contract", "variance"]),
    ("bank_recon", ["bank", "paid", "payment", "transfer", "disburse", "remittance", "debit", "credit"]),
    ("invoice", ["invoice", "billed", "billing", "subtotal"]),
    ("schedule", ["schedule", "milestone", "due date", "payment date", "installment"]),
    ("vat", ["vat", "tax"]),
    ("party", ["party", "vendor", "signatory", "name mismatch", "counterparty"]),
    ("date", ["date inconsistency", "dated", "expiry", "effective date"]),
]
# Topics of duplicates, in order, and the words of the story that bank, contract and invoice share.
GAP_WORDS = ["overpayment", "exceeds contract", "exceeds the contract", "exceeds invoice", "exceeds both", "paid more", "overpaid", "contract value", "contract total", "contract cap", "bank paid", "total paid", "versus contract", "vs contract", "cumulative", "unauthorized", "overrun", "above contract", "beyond the contract", "authorized value", "variance"]
INVOICE_MARKERS = ["invoice", "inv-", "invoicing", "billed", "subtotal"]
PAYMENT_MARKERS = ["contract", "bank", "paid", "payment", "payable", "disbursement", "transfer", "milestone", "advance", "overpayment", "exceeds", "debit", "credit"]
BUCKETS = [
    ("retainer", ["retainer", "march", "monthly", "article 2"]),
    ("invoice", ["invoice", "inv-", "billed", "subtotal", "invoicing"]),
    ("schedule", ["schedule", "milestone", "due date", "payment date", "payment schedule"]),
    ("vat", ["vat", "tax"]),
]
# Amounts that tell a story, least confidences by source, shapes of ids and of references.
LEAST_AMOUNT, LARGEST_AMOUNT = 100.0, 2_000_000.0
FLOORS = {"llm": 0.65, "graph": 0.55}
OTHER_FLOOR = 0.40
UUID = r"\b([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\b"
REFERENCE = r"(?i)\b((?:CTR|INV|CNT|PO|CON|SI)[-\s]?[0-9]{2,4}[-\s]?[0-9]{2,})\b"


def verdict(severity: Column, confidence: Column, evidence: Column, source: Column) -> Column:
    """Why the gate rejects a finding; an empty string if it accepts it."""
    floor = F.coalesce(F.create_map(*(F.lit(x) for kv in FLOORS.items() for x in kv))[source], F.lit(OTHER_FLOOR))
    backed = F.size(F.filter(F.coalesce(evidence, F.array().cast("array<string>")), lambda e: F.trim(e) != ""))
    return F.when(severity == "ok", "").when(confidence < floor, "low_confidence").when(source.isin("llm", "graph") & (severity == "critical") & (backed < 2), "insufficient_evidence").otherwise("")


def cites_unknown_id(prose: Column, evidence: Column) -> Column:
    """Whether the prose has a UUID that the evidence doesn't."""
    text = F.lower(F.array_join(F.coalesce(evidence, F.array().cast("array<string>")), " "))
    return F.exists(F.regexp_extract_all(F.coalesce(prose, F.lit("")), F.lit(UUID), 1), lambda u: ~F.contains(text, F.lower(u)))


def _first_topic(text: Column, topics: list[tuple[str, list[str]]]) -> Column:
    return F.coalesce(*(F.when(contains_any(text, words), F.lit(t)) for t, words in topics), F.lit("general"))


def _headline(values: Column) -> Column:
    kept = F.filter(values, lambda v: v.between(LEAST_AMOUNT, LARGEST_AMOUNT))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda v: coarse(v).cast("long"))))


def signature(title: Column, description: Column) -> Column:
    """Topic and coarse amounts, or the head of the title: the same whatever documents a finding is about."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))))
    amounts = _headline(tagged_amounts(text))
    tail = F.when(F.size(amounts) > 0, F.array_join(F.transform(amounts, lambda a: a.cast("string")), ",")).otherwise(F.concat(F.lit("t:"), F.substring(F.lower(F.trim(F.coalesce(title, F.lit("")))), 1, 40)))
    return F.concat(_first_topic(text, TOPICS), F.lit("|"), tail)


def bucket(title: Column, description: Column) -> Column:
    blob = F.lower(F.concat(title, F.lit(" "), F.substring(F.coalesce(description, F.lit("")), 1, 800)))
    gap = contains_any(blob, GAP_WORDS) | (contains_any(blob, INVOICE_MARKERS) & contains_any(blob, PAYMENT_MARKERS))
    return F.when(gap, "bank_contract_gap").otherwise(_first_topic(blob, BUCKETS))


#: Topics that tell one story together; amounts of two tellings that may differ if they share a reference.
_ONE_STORY = ("bank_contract_gap", "invoice")
_MOST_AMOUNTS = 8
_KEPT = "audit_id long, position int, finding_id string, severity string, confidence double, topic string"


class Stories:
    """The findings of one audit, as they come: those kept so far, and where a finding that tells the same as one of them would be found."""

    def __init__(self) -> None:
        self.kept, self.places = [], {}

    @staticmethod
    def same(f, p) -> bool:
        both = f.topic == p.topic or (f.topic in _ONE_STORY and p.topic in _ONE_STORY)
        amounts, others = set(f.amounts), set(p.amounts)
        if both and "general" not in (f.topic, p.topic):
            if f.docs and p.docs and not set(f.docs) & set(p.docs):
                return False
            shared = bool(set(f.refs) & set(p.refs))
            if amounts and others:
                return bool(amounts & others) or (shared and len(amounts | others) <= _MOST_AMOUNTS)
            return f.title[:30] == p.title[:30] if not amounts and not others else shared
        return f.docs == p.docs and ((bool(amounts) and f.amounts == p.amounts) or (not amounts and not others and f.title[:40] == p.title[:40]))

    @staticmethod
    def keys(f) -> list[tuple]:
        """Whatever tells the same as f has one of these keys in common with it."""
        story = _ONE_STORY[0] if f.topic in _ONE_STORY else f.topic
        told = [("amount", story, a) for a in f.amounts] + [("ref", story, r) for r in f.refs] + ([] if f.amounts else [("head", story, f.title[:30])])
        return told + [("exact", tuple(f.docs), tuple(f.amounts) or f.title[:40])]

    def add(self, f) -> None:
        keys = self.keys(f)
        near = sorted({at for k in keys for at in self.places.get(k, ())})
        at = next((k for k in near if self.same(f, self.kept[k])), None)
        if at is None:
            at = len(self.kept)
            self.kept.append(f)
        elif (f.rank, f.confidence) > (self.kept[at].rank, self.kept[at].confidence):
            self.kept[at] = f
        else:
            return
        for k in keys:
            self.places.setdefault(k, set()).add(at)


class FoldFindings:
    """A table function over findings of audits, in order: what is kept of each audit once all of its findings have come."""

    def __init__(self) -> None:
        self.audit, self.stories = None, Stories()

    def eval(self, row):
        self.audit = row.audit_id
        self.stories.add(row)

    def terminate(self):
        for k, f in enumerate(self.stories.kept):
            yield self.audit, k, f.finding_id, f.severity, f.confidence, f.topic


#: To be called with rows of told(), partitioned by audit_id and ordered by seq; also from SQL, once it is registered under a name.
fold_findings = F.udtf(FoldFindings, returnType=_KEPT)


def told(findings: DataFrame) -> DataFrame:
    """What of a finding says which story it tells: audit_id, seq, and rank, title, topic, amounts, docs and refs beside it."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    refs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 1), lambda t: F.regexp_replace(F.upper(t), r"\s+", ""))))
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).when(F.col("severity") == "ok", 1).otherwise(0)
    amounts = _headline(F.concat(tagged_amounts(text), scan_amounts(text)))
    docs = F.array_sort(F.array_distinct(F.array_compact(F.array("source_doc_id", "conflicting_doc_id"))))
    title = F.coalesce("title", F.lit(""))
    return findings.select(
        F.col("audit_id").cast("long").alias("audit_id"), F.col("seq").cast("long").alias("seq"), "finding_id", F.coalesce("severity", F.lit("")).alias("severity"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        rank.alias("rank"), F.lower(title).alias("title"), bucket(title, F.col("description")).alias("topic"), amounts.alias("amounts"), docs.alias("docs"), refs.alias("refs"),
    )


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding of each story, by audit: in order of seq, a finding joins the first kept one that tells the same,
    and takes its place if it is more severe, or as severe and more confident.

    Findings come one after the other, sorted by Spark; an audit's kept ones are held, and only those with an amount, reference, title or documents in
    common with a finding are compared with it. Null titles and descriptions are empty, a null confidence is 0."""
    return fold_findings(told(findings).asTable().partitionBy("audit_id").orderBy("seq"))


def risk(findings: DataFrame) -> DataFrame:
    """Counts, mean confidence in percent, and overall risk of each audit."""
    critical, warning = F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "warning")
    mean = F.round(F.avg("confidence") * 100, 0).cast("int")
    out = findings.groupBy("audit_id").agg(critical.alias("critical"), warning.alias("warnings"), F.count("*").alias("findings"), mean.alias("mean_confidence"))
    level = F.when(F.col("critical") >= 3, "critical").when(F.col("critical") >= 1, "high").when(F.col("warnings") >= 3, "medium").when(F.col("warnings") >= 1, "low").otherwise("clean")
    return out.withColumn("overall_risk", level)


def suppressed_signatures(triage: DataFrame) -> DataFrame:
    """(scope, signature) whose latest verdict is a false positive."""
    latest = triage.groupBy("scope", "signature").agg(F.max_by("status", F.struct("updated_at", "seq")).alias("status"))
    return latest.where("status = 'false_positive'").select("scope", "signature")


def without_suppressed(findings: DataFrame, triage: DataFrame) -> DataFrame:
    return findings.join(suppressed_signatures(triage), ["scope", "signature"], "left_anti")


def levels(findings: DataFrame) -> DataFrame:
    """Findings (scope, audit_id, topic, severity, confidence) counted on every level in one pass: by all four, by scope, audit and severity, by scope and topic, by scope and
    severity, by scope, and all together. level is the grouping id: a bit for each of scope, audit_id, topic and severity that is summed over, the first one the largest;
    it tells a total from a group whose own value is null."""
    by = ["scope", "audit_id", "topic", "severity"]
    sets = [by, ["scope", "audit_id", "severity"], ["scope", "topic"], ["scope", "severity"], ["scope"], []]
    critical, warning = (F.count_if(F.col("severity") == s) for s in ("critical", "warning"))
    out = findings.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, by))
    return out.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("findings"), critical.alias("critical"), warning.alias("warnings"), F.round(F.avg("confidence"), 6).alias("confidence"))
