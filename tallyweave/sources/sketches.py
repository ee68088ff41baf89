"""Sketches of logs that are kept for each audit and merged upward: how many different values there are, and quantiles, without reading the log again.

A sketch has a fixed size whatever it has seen; merged sketches say the same in whatever order they are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count are two to this power; its error is about 1.04 divided by the root of their number.
LG_K = 12
#: k of a quantile sketch; the rank of what it gives is off by about 1.7 % at 200.
K = 200
#: Relative error of distinct counts, and of ranks, that is not passed but for one case in many thousands.
DISTINCT_ERROR, RANK_ERROR = 4 * 1.04 / 2 ** (LG_K / 2), 0.04


def sketched(rows: DataFrame, by: list[str], distinct: str, number: str) -> DataFrame:
    """One row for each group: n rows, a sketch of the different values of one column, and one of another's quantiles. Nulls aren't counted in either; a group of nulls alone has
    null for that sketch."""
    has = lambda c: F.count(F.col(c)) > 0
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct).cast("string"), LG_K).alias("different"), F.kll_sketch_agg_double(F.col(number).cast("double"), K).alias("spread"), has(number).alias("_some"))
    return out.withColumn("spread", F.when(F.col("_some"), F.col("spread"))).drop("_some")


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of groups, of which the rows of several make one: by fewer columns, or of more days."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("different").alias("different"), F.kll_merge_agg_double("spread").alias("spread"))


def estimates(sketches: DataFrame, *ranks: float) -> DataFrame:
    """The sketches' rows with different (an estimate) and quantiles, one for each rank."""
    at = F.kll_sketch_get_quantile_double("spread", F.array(*map(F.lit, ranks)))
    return sketches.withColumns({"quantiles": at, "different": F.hll_sketch_estimate("different")}).drop("spread")
