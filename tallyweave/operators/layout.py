"""Tables and prose out of word boxes: what a page says by where its words stand.

Words are rows (doc_id, page, x0, y0, x1, y1, text), y downwards; ruled lines are rows (doc_id, page, x0, y0, x1, y1). Everything is windows and
aggregations by page, or by what lies in a page. A page with ruled tables has these; on any other, lines of words that stand in
columns are a table if they look like one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.folders import stored
from tallyweave.operators.documents import clean_cell, is_header, is_tabular

# Least columns and rows of a table.
LEAST_COLUMNS, LEAST_ROWS = 3, 2
#: In heights of a word: how far apart the middles of two lines are, the words of two cells, and the lines of two tables.
LINE, CELL, BREAK = 0.5, 0.8, 4.0
#: Points by which a ruled line may be slanted, or two of them be one.
RULE = 1.0

_PAGE = ["doc_id", "page"]


def _so_far(by: list[str], *order, including: bool = True) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if including else -1)


def lines(words: DataFrame) -> DataFrame:
    """words with line, the number of their line on the page from the top; words without text, page or box are left out."""
    kept = words.where("doc_id is not null and page is not null and trim(text) != '' and x0 + y0 + x1 + y1 is not null")
    kept = kept.withColumns({"mid": (F.col("y0") + F.col("y1")) / 2, "high": F.col("y1") - F.col("y0")})
    by = Window.partitionBy(*_PAGE).orderBy("mid", "x0", "text")
    new = F.coalesce((F.col("mid") - F.lag("mid").over(by) > F.col("high") * LINE).cast("int"), F.lit(1))
    return kept.withColumn("new", new).withColumn("line", F.sum("new").over(_so_far(_PAGE, "mid", "x0", "text"))).drop("new")


def segments(placed: DataFrame) -> DataFrame:
    """(doc_id, page, line, x0, y0, x1, y1, high, text): the words of a line that stand together, joined."""
    line = [*_PAGE, "line"]
    end = F.max("x1").over(_so_far(line, "x0", "text", including=False))
    new = F.coalesce((F.col("x0") - end > F.col("high") * CELL).cast("int"), F.lit(1))
    rows = placed.withColumn("new", new).withColumn("segment", F.sum("new").over(_so_far(line, "x0", "text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy(*line, "segment").agg(text.alias("text"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1", "high"))).drop("segment")


def _borderless(placed: DataFrame) -> DataFrame:
    """(doc_id, page, tbl, row, col, text, x0, y0, x1, y1): cells of runs of lines with two segments or more."""
    part = F.struct("text", "x0", "y0", "x1", "y1")
    per = segments(placed).groupBy(*_PAGE, "line").agg(F.collect_list(part).alias("parts"), F.count("*").alias("n"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.max("high").alias("tall"))
    by = Window.partitionBy(*_PAGE).orderBy("line")
    near = (F.lag("n").over(by) > 1) & (F.col("top") - F.lag("bottom").over(by) <= F.col("tall") * BREAK)
    runs = per.withColumn("new", (~F.coalesce(near, F.lit(False))).cast("int")).where("n > 1")
    # a line's few segments stay beside it, so that a page is in one partition all the way
    rows = runs.withColumn("tbl", F.sum("new").over(_so_far(_PAGE, "line"))).select(*_PAGE, "line", "tbl", F.inline("parts"))
    table = [*_PAGE, "tbl"]
    # columns: a sweep over the projections of all segments on x
    end = F.max("x1").over(_so_far(table, "x0", "x1", "line", including=False))
    new = F.coalesce((F.col("x0") > end).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("col", F.sum("new").over(_so_far(table, "x0", "x1", "line")) - 1)
    return rows.select(*table, F.col("line").alias("row"), "col", "text", "x0", "y0", "x1", "y1")


def _merged(values: Column) -> Column:
    """Sorted numbers without those that repeat the one before, but for RULE."""
    step = lambda kept, x: F.when(F.coalesce(x - F.try_element_at(kept, F.lit(-1)) > RULE, F.lit(True)), F.concat(kept, F.array(x))).otherwise(kept)
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), step)


def frames(rules: DataFrame) -> DataFrame:
    """(doc_id, page, tbl, xs, ys): the columns' and rows' edges of the ruled tables of a page; upright lines that overlap in height are of one table."""
    of = rules.where("doc_id is not null and page is not null").select(*_PAGE, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    upright, level = of.where(F.abs(F.col("x1") - F.col("x0")) <= RULE), of.where(F.abs(F.col("y1") - F.col("y0")) <= RULE)
    top, bottom = F.least("y0", "y1"), F.greatest("y0", "y1")
    upright = upright.where(bottom - top > RULE).withColumns({"top": top, "bottom": bottom})
    end = F.max("bottom").over(_so_far(_PAGE, "top", "bottom", "x0", including=False))
    upright = upright.withColumn("new", F.coalesce((F.col("top") > end + RULE).cast("int"), F.lit(1)))
    upright = upright.withColumn("tbl", F.sum("new").over(_so_far(_PAGE, "top", "bottom", "x0")))
    sides = upright.groupBy(*_PAGE, "tbl").agg(_merged(F.collect_list("x0")).alias("xs"), F.min("top").alias("top"), F.max("bottom").alias("bottom")).where(F.size("xs") > LEAST_COLUMNS)
    rows = level.select(*_PAGE, F.col("y0").alias("y")).join(sides.select(*_PAGE, "tbl", "top", "bottom"), _PAGE).where(F.col("y").between(F.col("top") - RULE, F.col("bottom") + RULE))
    rows = rows.groupBy(*_PAGE, "tbl").agg(_merged(F.collect_list("y")).alias("ys"))
    return sides.join(rows, [*_PAGE, "tbl"], "left").withColumn("ys", F.coalesce("ys", F.array("top", "bottom")))


def _ruled(placed: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells as of _borderless(), of words between ruled lines; more lines of words in one cell are joined."""
    across, down = (F.col("x0") + F.col("x1")) / 2, F.col("mid")
    inside = placed.join(grids, _PAGE).where(down.between(F.col("top"), F.col("bottom")) & across.between(F.get("xs", F.lit(0)), F.try_element_at("xs", F.lit(-1))))
    before = lambda edges, at: F.size(F.filter(edges, lambda e: e <= at))
    inside = inside.withColumns({"row": before("ys", down).cast("long"), "col": (before("xs", across) - 1).cast("long")})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "text"))), lambda w: w["text"]), " ")
    return inside.groupBy(*_PAGE, "tbl", "row", "col").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _tables(cells: DataFrame) -> DataFrame:
    """(doc_id, page, tbl, rows, x0, y0, x1, y1) with the rows' cells in order; those not there are empty texts."""
    box = [*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1"))]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    rows = cells.groupBy(*_PAGE, "tbl", "row", "col").agg(joined.alias("text"), *box)
    rows = rows.groupBy(*_PAGE, "tbl", "row").agg(F.collect_list(F.struct("col", "text")).alias("there"), F.max("col").alias("last"), *box)
    wide = rows.groupBy(*_PAGE, "tbl").agg(F.array_sort(F.collect_list(F.struct("row", "there"))).alias("rows"), F.max("last").alias("last"), *box).where(F.col("last") + 1 >= LEAST_COLUMNS)
    every = F.sequence(F.lit(0).cast("long"), "last")
    filled = lambda r: F.get(F.transform(F.array(F.map_from_entries(r["there"])), lambda m: F.transform(every, lambda c: clean_cell(F.try_element_at(m, c)))), F.lit(0))
    return wide.select(*_PAGE, "tbl", F.transform("rows", filled).alias("rows"), "x0", "y0", "x1", "y1")


def tables(words: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, table_no, cells, ruled, x0, y0, x1, y1): the tables of each page from the top, cells as an array of rows.

    Ruled tables need three columns; a page that has any has no others. Without them, lines that stand in three columns or more are a table if its first row
    names columns, or amounts stand in at least two and half of its rows: what is set in columns and isn't that is prose. Words are dealt to their pages once; with rules, what is
    read more than once is written as tables."""
    placed = lines(words)
    placed = placed if rules is None else stored(placed, "lines")
    found = _tables(_borderless(placed)).where(is_tabular(F.col("rows"))).withColumn("ruled", F.lit(False))
    if rules is not None:
        drawn = stored(_tables(_ruled(placed, frames(rules))).withColumn("ruled", F.lit(True)), "tables")
        found = drawn.unionByName(found.join(drawn.select(*_PAGE).distinct(), _PAGE, "left_anti"))
    place = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("y0", "x0")).cast("int")
    return found.withColumn("table_no", place).select(*_PAGE, "table_no", F.col("rows").alias("cells"), "ruled", "x0", "y0", "x1", "y1")


def table_rows(found: DataFrame, across_pages: bool = False) -> DataFrame:
    """(doc_id, page, table_no, header, row_no, row): the rows of tables(), cells between bars, with the header of their table, else that of the last
    table before it on its page, or in its document. A table of a header alone has no rows, but hands its header on."""
    head = is_header(F.get("cells", F.lit(0)))
    rows = found.withColumn("header", F.when(head, F.array_join(F.get("cells", F.lit(0)), " | "))).withColumn("body", F.when(head, F.slice("cells", 2, F.size("cells"))).otherwise(F.col("cells")))
    by = ["doc_id"] if across_pages else _PAGE
    rows = rows.withColumn("header", F.coalesce(F.last("header", ignorenulls=True).over(_so_far(by, "page", "table_no")), F.lit("")))
    out = rows.select(*_PAGE, "table_no", "header", F.posexplode(F.filter("body", lambda r: F.exists(r, lambda c: c != ""))).alias("row_no", "r"))
    return out.select(*_PAGE, "table_no", "header", "row_no", F.array_join("r", " | ").alias("row"))


def prose(words: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page, text): the lines of each page that no table of tables() overlaps, by line; a page of tables alone has an empty text."""
    boxes = found.groupBy(*_PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    parts = lines(words).groupBy(*_PAGE, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    meets = lambda b: (F.col("x0") < b["x1"]) & (b["x0"] < F.col("x1")) & (F.col("y0") < b["y1"]) & (b["y0"] < F.col("y1"))
    out = parts.join(boxes, _PAGE, "left").withColumn("lifted", F.coalesce(F.exists("boxes", meets), F.lit(False)))
    kept = F.array_sort(F.collect_list(F.when(~F.col("lifted"), F.struct("line", "text"))))
    return out.groupBy(*_PAGE).agg(F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"))
