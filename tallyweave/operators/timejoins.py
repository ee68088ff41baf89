"""Joins by time: the last row before a moment, and the ranges that a moment lies in.

Neither compares each row of a key with each other one. Both deal a key's rows to slices of time, so that a key with very many
rows goes to many tasks; slices are an equality, and the exact condition on time decides within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Moments of a key in a slice on average, beyond which the key is cut into more of them.
SLICE = 200_000
#: Length of the shortest cell in microseconds, and how many of them the next larger one has.
CELL, FACTOR = 3_600_000_000, 16


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _named(df: DataFrame, key: str, time: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), micros(F.col(time)).alias("_at"), F.struct(*(F.col(c) for c in df.columns)).alias("_row"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, ties: list[str], slice_rows: int = SLICE) -> DataFrame:
    """(left, right): each row of left, as a struct, with the row of right of the same key that has the latest time not after its own; null where
    there is none, or where key or time of left is null. Of right rows of one key and time the largest by `ties` counts, nulls smallest; rows without key or time never do.

    Moments of both sides, each once, stand in one order by key and slice of time, and the last right row is carried forward within a slice. What a slice begins with
    is carried over from the last right row of the slices before, a row for each. A key has as many slices of equal length as its moments ask for."""
    lefts, rights = _named(left, key, left_time), _named(right, key, right_time)
    whole = F.struct(*(F.col(f"_row.{c}") for c in ties), "_row")
    best = rights.where("_key is not null and _at is not null").groupBy("_key", "_at").agg(F.max_by("_row", whole).alias("_right"))
    asked = lefts.where("_key is not null and _at is not null").select("_key", "_at").distinct()
    moments = asked.withColumn("_asked", F.lit(True)).unionByName(best.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    spread = moments.groupBy("_key").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.ceil(F.count("*") / slice_rows).alias("_n"))
    sliced = moments.join(spread, "_key").withColumn("_slice", F.when(F.col("_to") > F.col("_from"), F.floor((F.col("_at") - F.col("_from")).cast("decimal(20,0)") * F.col("_n") / (F.col("_to") - F.col("_from") + 1).cast("decimal(20,0)"))).otherwise(0).cast("long")).drop("_from", "_to", "_n")
    # right before left at the same moment: what lies at the moment itself counts
    order = Window.partitionBy("_key", "_slice").orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sliced.withColumn("_last", F.last("_right", ignorenulls=True).over(order)).where("_asked")
    ends = sliced.groupBy("_key", "_slice").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_at"))).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select("_key", "_slice", "_carried")
    found = inside.join(carried, ["_key", "_slice"]).select("_key", "_at", F.coalesce("_last", "_carried").alias("right"))
    return lefts.join(found, ["_key", "_at"], "left").select(F.col("_row").alias("left"), "right")


def _levels(ranges: DataFrame) -> list[int]:
    """The sizes of cells that the ranges use: as few as the logarithm of the longest."""
    return sorted(r[0] for r in ranges.select("_level").distinct().collect())


def _ranged(ranges: DataFrame, key: str, start: str, end: str, cell: int, factor: int) -> DataFrame:
    """_key, _from, _to (not in the range), _level and _row of ranges that hold any moment; the level's cells are at least as long as the range, but for a factor."""
    rows = ranges.select(F.col(key).alias("_key"), micros(F.col(start)).alias("_from"), F.coalesce(micros(F.col(end)), F.lit(2**62)).alias("_to"), F.struct(*(F.col(c) for c in ranges.columns)).alias("_row"))
    rows = rows.where("_key is not null and _from is not null and _to > _from")
    cells = F.greatest(F.lit(1.0), (F.col("_to") - F.col("_from")) / F.lit(cell))
    return rows.withColumn("_level", F.greatest(F.lit(0), F.floor(F.log(cells) / F.log(F.lit(float(factor))))).cast("int"))


def _width(level: Column, cell: int, factor: int) -> Column:
    return (F.lit(cell) * F.pow(F.lit(float(factor)), level)).cast("long")


def within(points: DataFrame, ranges: DataFrame, key: str, time: str, start: str, end: str, cell: int = CELL, factor: int = FACTOR) -> DataFrame:
    """(point, range), as structs: each point with each range of the same key that has start <= time < end; a range without end goes on for ever. Points without
    a range aren't there; neither are rows without key, and ranges that are empty or have no start.

    A range goes to the cells of time that it meets, in cells of a size after its own length: factor + 1 of them at most however long it is. One without end, whose length
    says nothing, goes by the last point there is. A point goes to one cell of each size in use. Equality of key, size and cell joins; the exact times decide."""
    told = points.select(F.col(key).alias("_key"), micros(F.col(time)).alias("_at"), F.struct(*(F.col(c) for c in points.columns)).alias("_row")).where("_key is not null and _at is not null")
    (last,) = told.agg(F.max("_at")).first()
    rows = ranges.withColumn("_end", F.coalesce(F.col(end).cast("timestamp"), F.timestamp_micros(F.greatest(F.lit((last or 0) + 1), micros(F.col(start)) + 1))))
    rows = _ranged(rows, key, start, "_end", cell, factor).withColumn("_row", F.col("_row").dropFields("_end"))
    levels = _levels(rows)
    width = _width(F.col("_level"), cell, factor)
    cut = rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    sizes = F.array(*(F.struct(F.lit(x).alias("_level"), F.floor(F.col("_at") / F.lit(cell * factor**x)).alias("_cell")) for x in levels))
    dealt = told.select("_key", "_at", F.col("_row").alias("point"), F.inline(sizes)) if levels else told.select("_key", "_at", F.col("_row").alias("point"), F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_cell"))
    met = dealt.join(cut.select("_key", "_level", "_cell", "_from", "_to", F.col("_row").alias("range")), ["_key", "_level", "_cell"])
    return met.where("_from <= _at and _at < _to").select("point", "range")


def cells(ranges: DataFrame, key: str, start: str, end: str, cell: int = CELL, factor: int = FACTOR) -> DataFrame:
    """How within() deals ranges out: by size of cell (level), the ranges, their copies, and the most that one cell of one key gets."""
    rows = _ranged(ranges, key, start, end, cell, factor)
    width = _width(F.col("_level"), cell, factor)
    cut = rows.select("_key", "_level", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))).alias("_cell"))
    copies = cut.groupBy("_key", "_level", "_cell").agg(F.count("*").alias("n")).groupBy(F.col("_level").alias("level")).agg(F.sum("n").alias("copies"), F.max("n").alias("fullest"))
    return rows.groupBy(F.col("_level").alias("level")).agg(F.count("*").alias("ranges")).join(copies, "level")
