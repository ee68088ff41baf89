"""What is left to models outside: each hook has a deterministic default."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.money import number_multiset
from tallyweave.functions.text import query_entities
from tallyweave.functions.text import document_type
from tallyweave.operators.adjudication import rule_adjudication
from tallyweave.operators.documents import LEAST_ROWS, has_amount
from tallyweave.operators.extraction import rule_entities
from tallyweave.operators.pairs import severity


def rule_assessment(pairs: DataFrame) -> DataFrame:
    """Comparable, materially different pairs are contradictions; severity by their difference."""
    gap = F.abs(F.col("amount_value1") - F.col("amount_value2"))
    return pairs.withColumns({"is_contradiction": F.lit(True), "severity": severity(gap, F.col("relative_difference"))})


def summary(risks: DataFrame) -> DataFrame:
    text = F.format_string("%d findings: %d critical, %d warnings. Overall risk: %s.", "findings", "critical", "warnings", "overall_risk")
    return risks.withColumn("summary", text)


def repaired(original: Column, repair: Column) -> Column:
    """A repaired table's text if it has the numbers of the original, and amounts in three rows or more, else the original."""
    rows = F.size(F.filter(F.split(repair, "\n"), has_amount)) >= LEAST_ROWS
    return F.when((number_multiset(original) == number_multiset(repair)) & rows, repair).otherwise(original)


@dataclass
class Hooks:
    classify: Callable[[Column, Column], Column] = document_type
    assess: Callable[[DataFrame], DataFrame] = rule_assessment
    summarise: Callable[[DataFrame], DataFrame] = summary
    repair: Callable[[Column], Column] = field(default=lambda text: text)
    entities: Callable[[DataFrame], DataFrame] = rule_entities
    about: Callable[[Column], Column] = query_entities
    adjudicate: Callable[[DataFrame, DataFrame], DataFrame] = rule_adjudication
    ocr: Callable[[bytes], str] | None = None
