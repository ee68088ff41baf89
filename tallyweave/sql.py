"""The operators from SQL: temporary functions for what is a rule on values, table functions for what is a rule on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.functions.text import AUTHORITIES, AUTHORITY_RANKS
from tallyweave.operators.findings import FLOORS, OTHER_FLOOR, fold_findings, told
from tallyweave.operators.pairs import role_pairs
from tallyweave.shipping import ship


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cases(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in pairs) + f" ELSE {otherwise} END"


#: Name, arguments, type and body of each scalar function. What they say is what the Column builders of the same rules say; a test holds them together.
SCALARS = {
    "tw_coarse": ("v DOUBLE", "DOUBLE", "CASE WHEN v < 10000 THEN bround(v / 100) * 100 ELSE bround(v / 1000) * 1000 END"),
    "tw_same_currency": ("a STRING, b STRING", "BOOLEAN", "coalesce(nullif(upper(trim(a)), '') = nullif(upper(trim(b)), ''), true)"),
    "tw_differ": ("a DECIMAL(18,2), b DECIMAL(18,2)", "BOOLEAN", "abs(a - b) > greatest(abs(a), abs(b)) * CAST('0.0001' AS DECIMAL(5,4)) + CAST('0.01' AS DECIMAL(3,2))"),
    "tw_severity": ("gap DOUBLE, relative DOUBLE", "STRING", "CASE WHEN gap >= 5000 OR relative >= 0.05 THEN 'critical' ELSE 'warning' END"),
    "tw_authority": ("title STRING", "STRING", _cases([(f"contains(lower(trim(title)), {_quoted(w)})", _quoted(x)) for w, x in AUTHORITIES], "NULL")),
    "tw_authority_rank": ("level STRING", "INT", _cases([(f"level = {_quoted(k)}", str(v)) for k, v in AUTHORITY_RANKS.items()], "0")),
    "tw_verdict": ("severity STRING, confidence DOUBLE, backed INT, source STRING", "STRING", _cases([("severity = 'ok'", "''"), (f"confidence < {_cases([(f'source = {_quoted(k)}', str(v)) for k, v in FLOORS.items()], str(OTHER_FLOOR))}", "'low_confidence'"), ("source IN ('llm', 'graph') AND severity = 'critical' AND backed < 2", "'insufficient_evidence'")], "''")),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session: tw_... on values, tw_fold_findings as a table function, and the table tw_role_pairs (role1, role2, reason)."""
    ship(spark)
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("tw_fold_findings", fold_findings)
    role_pairs(spark).createOrReplaceTempView("tw_role_pairs")


def view(name: str, rows: DataFrame) -> None:
    """A relation by name for SQL."""
    rows.createOrReplaceTempView(name)


def findings_view(name: str, findings: DataFrame) -> None:
    """Findings as tw_fold_findings takes them: SELECT * FROM tw_fold_findings(TABLE(name) PARTITION BY audit_id ORDER BY seq)."""
    told(findings).createOrReplaceTempView(name)
