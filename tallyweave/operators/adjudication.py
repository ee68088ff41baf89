"""Checks of a checklist, decided by rules over the snippets that were found for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.dealing import dealt, partitions as partitions_of
from tallyweave.folders import stored
from tallyweave.functions.money import currency_code, parse_amount
from tallyweave.functions.text import identifier_core
from tallyweave.operators import evidence, grounding, pairs
from tallyweave.operators.extraction import role_for_type, rule_entities
from tallyweave.operators.findings import REFERENCE

# Snippets that a check needs at least, those that a model is asked about at once, characters that are cited of one; the confidence of a finding.
LEAST, ASKED, CITED, CONFIDENCE = 2, 14, 220, 0.75
#: Snippets to a partition of their amounts.
ROWS = 200_000
ADVICE = "Compare both records and correct the one that is wrong."


def snippets_of(hits: DataFrame, documents: DataFrame, most: int | None = None, partitions: int | None = None) -> DataFrame:
    """The snippets of each check out of its hits (audit_id, check_no, doc_id, position, page, text), with file name and type of their documents (audit_id, doc_id, filename,
    doc_type): those with different document or text, whole, the first most by position where that is given; none where there are fewer than two. Hits without text are none. partitions: how many
    the hits are dealt to."""
    rows = hits.select("audit_id", "check_no", "doc_id", "position", "page", F.btrim("text", F.lit(" \t\n\r")).alias("text")).where("text != ''")
    about = documents.dropDuplicates(["audit_id", "doc_id"]).select("audit_id", "doc_id", "filename", "doc_type")
    # hits come to their documents first, and to their audits then: texts that several checks have lie beside each other, and take their place once where they are packed
    rows = dealt(rows, partitions, "audit_id", "doc_id").join(about, ["audit_id", "doc_id"], "left")
    return grounding.snippets(dealt(rows, partitions, "audit_id") if partitions else rows.repartition("audit_id"), most, None, LEAST)


def _figures(snippets: DataFrame) -> DataFrame:
    """The amounts that rules find in snippets, of roles that may be compared, with what their snippet is about: a currency, and the first number of a contract, order or invoice
    (an empty one where it names none). Those of an audit are in one partition. snippets: a table."""
    # what is known of a snippet goes with its key, so that nothing is joined to its amounts
    key = F.struct("audit_id", "check_no", "snippet_no", "most", F.col("doc_id").alias("document"), "doc_type", currency_code(F.col("text")).alias("currency"), identifier_core(F.regexp_extract("text", REFERENCE, 1)).alias("reference"))
    found = rule_entities(snippets.select(key.alias("doc_id"), F.col("snippet_no").alias("chunk_index"), "text"))
    value = parse_amount(F.col("raw")).cast("decimal(18,2)")
    rows = found.select("doc_id.*", role_for_type(F.col("amount_role"), F.col("doc_id.doc_type")).alias("role"), value.alias("value")).drop("doc_type").withColumnRenamed("document", "doc_id")
    return rows.where(F.col("value").isNotNull() & F.col("role").isin(pairs.COMPARED)).repartition(partitions_of(snippets, ROWS), "audit_id")


def outermost(rows: DataFrame, *group: str) -> DataFrame:
    """Of the amounts of a check that are alike in group, those of which one of the check's `most` widest gaps can be made; the others can't be in a finding.

    A value is owned by its document, or shared where several have it; its first two documents stand for it. Kept are the `most` lowest and highest values of an owner, of the
    most + 1 owners that have the lowest, or highest, one. An amount that isn't among the lowest finds `most` lower values beside it that its partner can be set against as well, since
    no more than one owner is the partner's document; each of these gaps is wider. The same holds for the highest."""
    key = ["audit_id", "check_no", *group]
    alike, owner, all_of = Window.partitionBy(*key, "value"), Window.partitionBy(*key, "owner"), Window.partitionBy(*key)
    rows = rows.withColumns({"place": F.row_number().over(alike.orderBy("snippet_no")), "docs": F.count("*").over(alike)}).where("place <= 2")
    rows = rows.withColumn("owner", F.when(F.col("docs") == 1, F.col("doc_id"))).withColumns({"lowest": F.min("value").over(owner), "highest": F.max("value").over(owner)})
    # values are owned once, so that an owner's outermost value stands for it
    at = {"low": F.dense_rank().over(owner.orderBy("value")), "high": F.dense_rank().over(owner.orderBy(F.desc("value"))), "owner_low": F.dense_rank().over(all_of.orderBy("lowest")), "owner_high": F.dense_rank().over(all_of.orderBy(F.desc("highest")))}
    kept = rows.withColumns(at).where("low <= most and owner_low <= most + 1 or high <= most and owner_high <= most + 1")
    return kept.drop("place", "docs", "owner", "lowest", "highest", *at)


def _met(rows: DataFrame) -> DataFrame:
    """Amounts as they are set against each other, by the number that they are about. What names no number may be about any: where a check has such amounts, the others stand
    beside them once more (other), whatever their number. Of amounts alike in one document the first counts."""
    free = F.max(F.col("reference") == "").over(Window.partitionBy("audit_id", "check_no"))
    own, beside = F.struct("reference", F.lit(False).alias("other")), F.struct(F.lit("").alias("reference"), F.lit(True).alias("other"))
    places = F.when(F.col("free") & (F.col("reference") != ""), F.array(own, beside)).otherwise(F.array(own))
    rows = rows.withColumn("free", free).withColumn("places", places).drop("reference", "free").select("*", F.inline("places")).drop("places")
    group = ("reference", "other", "currency", "role")
    return outermost(rows.groupBy("audit_id", "check_no", "most", *group, "value", "doc_id").agg(F.min("snippet_no").alias("snippet_no")), *group)


def rule_adjudication(checks: DataFrame, snippets: DataFrame) -> DataFrame:
    """Findings of checks (audit_id, check_no, most; others have none): amounts of comparable roles that differ materially, in snippets of two documents.

    Amounts of two currencies, or of snippets that name two contracts, aren't compared. The same two amounts for one reason are one finding, of the first snippets; a check
    gives its most material ones, at most `most`. All snippets of a check are read. Of its amounts those that can make these findings are set against each other, as many as its numbers
    ask for and not their square. Without checks or snippets there are no findings."""
    asked = checks.where("most > 0").select("audit_id", "check_no", "most").dropDuplicates(["audit_id", "check_no"])
    snippets = stored(snippets.join(asked, ["audit_id", "check_no"]), "snippets")  # read several times
    rows = _met(_figures(snippets)).groupBy("audit_id", "check_no", "most", "reference").agg(F.collect_list(F.struct("snippet_no", "doc_id", "role", "value", "currency", "other")).alias("met"))

    def differ(a: Column, b: Column) -> Column:
        apart = pairs.materially_different(a["value"], b["value"]) & pairs.same_currency(a["currency"], b["currency"])
        return (a["snippet_no"] < b["snippet_no"]) & (a["doc_id"] != b["doc_id"]) & ~(a["other"] & b["other"]) & apart & pairs.reason_of(a["role"], b["role"]).isNotNull()

    # what is set against each other lies in one row: of a few values for each role and currency, so that no row is large
    both = rows.select("*", F.explode("met").alias("a")).select("audit_id", "check_no", "most", "a", F.explode(F.filter("met", lambda b: differ(F.col("a"), b))).alias("b"))
    both = both.select("audit_id", "check_no", "most", *(F.col(f"{s}.{c}").alias(f"{c}{k}") for k, s in ((1, "a"), (2, "b")) for c in ("snippet_no", "doc_id", "role", "value")))
    both = both.withColumn("reason", pairs.reason_of(F.col("role1"), F.col("role2")))
    once = Window.partitionBy("audit_id", "check_no", F.array_sort(F.array("value1", "value2")), "reason").orderBy("snippet_no1", "snippet_no2", "role1", "value1")
    gap = F.abs(F.col("value1") - F.col("value2"))
    told = both.withColumn("rn", F.row_number().over(once)).where("rn = 1").withColumn("gap", gap)
    first = Window.partitionBy("audit_id", "check_no").orderBy(F.desc("gap"), "snippet_no1", "snippet_no2", "reason", "value1")
    told = told.withColumn("finding_no", F.row_number().over(first)).where("finding_no <= most")
    said = evidence.cited(F.coalesce("filename", F.concat(F.lit("document "), F.col("snippet_no").cast("string"))), F.col("page"), F.substring("text", 1, CITED))
    # of an audit's snippets those that findings cite, looked up among them by its few numbers
    wanted = told.groupBy("audit_id").agg(F.flatten(F.collect_list(F.array(*(F.struct("check_no", F.col(c).alias("snippet_no")) for c in ("snippet_no1", "snippet_no2"))))).alias("wanted"))
    cites = snippets.select("audit_id", F.struct("check_no", "snippet_no").alias("place"), said.alias("said")).join(wanted, "audit_id").where(F.array_contains("wanted", F.col("place")))
    told = told.join(cites.groupBy("audit_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "said"))).alias("cited")), "audit_id")
    cited = lambda c: F.col("cited")[F.struct("check_no", F.col(c).alias("snippet_no"))]
    money = lambda k: F.format_number(F.col(f"value{k}").cast("double"), 2)
    relative = F.try_divide(F.col("gap").cast("double"), F.greatest(F.abs("value1"), F.abs("value2")).cast("double"))
    return told.select(
        "audit_id", F.concat_ws(":", F.lit("check"), F.col("check_no").cast("string"), F.col("finding_no").cast("string")).alias("finding_id"), "check_no", pairs.severity(F.col("gap"), relative).alias("severity"),
        F.lit(CONFIDENCE).alias("confidence"), F.lit("checklist").alias("source"), F.concat(F.lit("Amounts differ: "), "reason").alias("title"),
        F.concat(F.lit("One document has "), money(1), F.lit(", another "), money(2), F.lit(".")).alias("description"), F.col("doc_id1").alias("source_doc_id"), F.col("doc_id2").alias("conflicting_doc_id"),
        F.array(cited("snippet_no1"), cited("snippet_no2")).alias("evidence"), F.lit(ADVICE).alias("recommendation"),
    )
