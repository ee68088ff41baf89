"""The course of an audit: phases, states, dispatch of checks, and what a report or an answer is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a session with those that may follow, types of events and the ones that end a log.
NEXT_STATES = {"pending": ["processing"], "processing": ["completed", "failed", "processing"], "failed": ["processing"], "completed": []}
EVENT_TYPES = ["connected", "reasoning_step", "report_ready", "complete", "error", "sources", "delta", "done"]
TERMINAL = ["complete", "error"]
# Order of the phases of a cross-check.
PHASES = ["graph", "reference", "signatory", "checklist"]
SEVERITIES = ["critical", "warning", "ok"]
# Bounds of a question's context.
SNIPPETS, SNIPPET_CHARS, FINDINGS, FINDING_CHARS, TURNS = 12, 700, 25, 300, 8
MAX_PASSES = 2


def in_phases(parts: dict[str, DataFrame]) -> DataFrame:
    """Findings (audit_id, finding_id, ...) of the phases one after the other, numbered by audit as seq: what follows depends on order."""
    out = None
    for k, name in enumerate(PHASES):
        if name in parts:
            part = parts[name].withColumns({"phase": F.lit(name), "phase_no": F.lit(k)})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("audit_id").orderBy("phase_no", "finding_id")).cast("long")).drop("phase_no")


def dispatch(checks: DataFrame, documents: DataFrame) -> DataFrame:
    """checks (audit_id, check_no, check_type) with action: adjudicate (amounts and consistency of two documents or more, and dates), recorded
    (self-references, which the references phase decides) or none; and how many findings one may give."""
    n = documents.groupBy("audit_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("doc_type") == "bank_statement").alias("n_bank"))
    kind, many = F.col("check_type"), F.coalesce("n_docs", F.lit(0)) > 1
    action = F.when(kind == "self_reference", "recorded").when(kind == "date_consistency", "adjudicate").when(kind.isin("amount_match", "cross_doc_consistency") & many, "adjudicate").otherwise("none")
    bankish = F.coalesce(F.col("intents").contains("bank"), F.lit(False)) if "intents" in checks.columns else F.lit(False)
    out = checks.join(n, "audit_id", "left").withColumn("action", action)
    return out.withColumn("most", F.when(F.col("action") != "adjudicate", 0).when(bankish & (F.col("n_bank") > 0), 1).otherwise(4)).drop("n_docs", "n_bank")


def goes_on(plans: DataFrame) -> DataFrame:
    """Where an audit goes (audit_id, n_docs, n_findings, n_checks, passes): one document skips the cross-check; one with two documents or more, no
    finding, fewer than four checks and fewer than two passes is planned again."""
    again = (F.col("n_docs") >= 2) & (F.col("n_findings") == 0) & (F.col("n_checks") < 4) & (F.col("passes") < MAX_PASSES)
    return plans.withColumn("next", F.when(again, "planner").otherwise("report")).withColumn("first", F.when(F.col("n_docs") >= 2, "cross_checker").otherwise("report"))


def start_action(status: Column, last_beat: Column, now: Column, seconds: int = 120) -> Column:
    """What asking for an audit's run does: fetch a completed one, wait for one that is alive, start any other."""
    alive = F.coalesce(last_beat >= now - F.expr(f"INTERVAL {seconds} SECONDS"), F.lit(False))
    return F.when(status == "completed", "fetch").when((status == "processing") & alive, "wait").when(status == "processing", "restart").otherwise("start")


def legal_states(changes: DataFrame) -> DataFrame:
    """Changes (audit_id, seq, status) with legal: whether a session may go from its last status to this one; the first must be pending."""
    before = F.lag("status").over(Window.partitionBy("audit_id").orderBy("seq"))
    allowed = F.create_map(*(x for k, v in NEXT_STATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    legal = F.when(before.isNull(), F.col("status") == "pending").otherwise(F.coalesce(F.array_contains(allowed[before], F.col("status")), F.lit(False)))
    return changes.withColumn("legal", legal)


def replay_to_end(events: DataFrame, start: int = 0) -> DataFrame:
    """Events (audit_id, seq, event_type) from start on, up to the first that ends the log."""
    rows = events.where(F.col("seq") >= start)
    so_far = Window.partitionBy("audit_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("event_type").isin(TERMINAL)).over(so_far), F.lit(False))
    return rows.withColumn("_ended", ended).where("not _ended").drop("_ended")


def type_histogram(documents: DataFrame) -> DataFrame:
    """Documents of each type in an audit."""
    return documents.groupBy("audit_id", F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"))


def pass_rate(candidates: DataFrame) -> DataFrame:
    """Candidates and accepted ones (accepted: boolean) of an audit, and the share in percent; 0 without candidates."""
    out = candidates.groupBy("audit_id").agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"))
    return out.withColumn("rate", F.round(100 * F.col("accepted") / F.col("candidates"), 1))


def with_triage(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """Findings with the latest verdict of their audit's reviewers: triage has audit_id, finding_id, status, updated_at, seq."""
    latest = triage.groupBy("audit_id", "finding_id").agg(F.max_by("status", F.struct("updated_at", "seq")).alias("triage"))
    return findings.join(latest, ["audit_id", "finding_id"], "left")


def all_passages(found: DataFrame, whole: DataFrame, chars: int = 100) -> DataFrame:
    """Passages (audit_id, position, doc_id, text) that a search found, then all of the bank documents whose head none before has."""
    both = found.withColumn("part", F.lit(0)).unionByName(whole.withColumn("part", F.lit(1))).withColumn("head", F.substring("text", 1, chars))
    first = Window.partitionBy("audit_id", "head").orderBy("part", "position", "doc_id")
    kept = both.withColumn("rn", F.row_number().over(first)).where("part = 0 or (rn = 1 and head != '')")
    return kept.select("audit_id", "part", "position", "doc_id", "text")


def sessions_with_reports(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """Sessions (scope, audit_id, status, created_at) with the findings of their report (audit_id, severity), counted where they are completed,
    and their place in the scope, the newest first."""
    n = reports.groupBy("audit_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("c"))
    done = F.col("status") == "completed"
    out = sessions.join(n, "audit_id", "left").withColumns({"findings": F.when(done, F.coalesce("n", F.lit(0))), "critical": F.when(done, F.coalesce("c", F.lit(0)))})
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("created_at"), "audit_id"))
    return out.select("scope", "audit_id", "status", "created_at", "findings", "critical", place.cast("long").alias("position"))


def newest(sessions: DataFrame, scope: str, most: int = 100) -> DataFrame:
    """The newest sessions of a scope: a top-k, without a sort of them all."""
    return sessions.where(F.col("scope") == scope).orderBy(F.desc("created_at"), "audit_id").limit(most)


def by_severity(rows: DataFrame, by: str = "severity", descending: bool = False) -> DataFrame:
    """Conflict rows in the order of a table's column: the most severe first, or any other column; equals by entity_label and values."""
    key = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) if by == "severity" else F.col(by)
    return rows.orderBy(key.desc() if descending else key.asc(), "entity_label", "doc_a_value", "doc_b_value")


def visible(findings: DataFrame, severity: str | None = None) -> DataFrame:
    return findings if severity in (None, "all") else findings.where(F.col("severity") == severity)


def valid_rows(rows: DataFrame, column: str, schema: str, needed: list[str]) -> DataFrame:
    """JSON rows as columns; those that don't parse, or lack what is needed, are left out."""
    out = rows.withColumn("_r", F.from_json(column, schema, {"mode": "PERMISSIVE"})).where("_r is not null")
    for c in needed:
        out = out.where(F.col(f"_r.{c}").isNotNull())
    return out.drop(column).select("*", "_r.*").drop("_r")


def to_document(rows: DataFrame, key: str) -> DataFrame:
    """(key, document): rows as JSON, as a keyed store holds them. valid_rows() is the way back."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns if c != key))).alias("document"))


def flat_content(blocks: Column) -> Column:
    """The text of an answer that comes as blocks (type, text): those of type text, joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")


def question_context(audits: DataFrame, findings: DataFrame, passages: DataFrame, turns: DataFrame) -> DataFrame:
    """What an answer about an audit is grounded on: (audit_id, digest, sources, history).

    digest: overall risk and the first FINDINGS findings (seq) in short; sources: the first SNIPPETS passages (position), cut; history:
    the last TURNS turns (turn). audits: audit_id, overall_risk."""
    line = F.concat(F.lit("["), "severity", F.lit("] "), "title", F.lit(": "), F.substring(F.coalesce("description", F.lit("")), 1, FINDING_CHARS))

    def joined(rows: DataFrame, text: Column, order: str, most: int, name: str, newest_first: bool = False) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("audit_id").orderBy(F.desc(order) if newest_first else F.col(order)))
        kept = rows.select("audit_id", F.col(order).alias("o"), text.alias("t"), rank.alias("rn")).where(F.col("rn") <= most)
        return kept.groupBy("audit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias(name))

    out = audits.join(joined(findings, line, "seq", FINDINGS, "lines"), "audit_id", "left")
    quoted = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.substring(F.trim("text"), 1, SNIPPET_CHARS))
    out = out.join(joined(passages.where("trim(text) != ''"), quoted, "position", SNIPPETS, "sources"), "audit_id", "left")
    out = out.join(joined(turns, F.concat("role", F.lit(": "), "text"), "turn", TURNS, "history", True), "audit_id", "left")
    digest = F.concat_ws("\n", F.concat(F.lit("Overall risk: "), "overall_risk"), "lines")
    return out.select("audit_id", digest.alias("digest"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("history", F.lit("")).alias("history"))
