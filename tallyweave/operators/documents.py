"""Rows of registers and chunks of rows, out of flattened page text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Amounts in cells, words of registers and of header rows, least rows, and the length of a stray segment.
AMOUNT = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]{2}"
# Months and the ways that a row's date is written.
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
ARABIC_MONTHS = "يناير|فبراير|مارس|أبريل|ابريل|مايو|يونيو|يوليو|أغسطس|اغسطس|سبتمبر|أكتوبر|اكتوبر|نوفمبر|ديسمبر"
_D = "[0-9٠-٩]"
ROW_DATE = (
    rf"(?i)^\s*(?:{_D}{{1,4}}[/-]{_D}{{1,2}}[/-]{_D}{{2,4}}|{_D}{{1,2}}\.{_D}{{1,2}}\.{_D}{{4}}"
    rf"|{_D}{{1,2}}\s+(?:{MONTHS}|{ARABIC_MONTHS})[a-z؀-ۿ]*\.?,?\s+{_D}{{2,4}}|(?:{MONTHS})[a-z]*\.?\s+{_D}{{1,2}},?\s+{_D}{{2,4}})"
)
REGISTER_HINT = "(?i)debit|credit|balance|مدين|دائن|رصيد"
HEADER_HINT = "(?i)date|ref|txn|description|debit|credit|balance|amount|qty|quantity|rate|item|تاريخ|مرجع|بيان|مدين|دائن|رصيد|مبلغ|كمية"
LEAST_ROWS, STRAY = 3, 40
ROW_MARK = "[TABLE ROW]"
# Where prose is cut, by rank, and the least length of a chunk. Blanks are those of ASCII.
SEPARATORS = ("\n\n", "\n", ".", "،", " ")
LEAST_CHUNK = 20
BLANKS = " \t\n\r\x0b\x0c"


def has_amount(text: Column) -> Column:
    return F.rlike(text, F.lit(AMOUNT))


def looks_flattened(text: Column) -> Column:
    """At least 12 lines, 6 with an amount, and 3 in 5 of at most 45 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    n = F.size(lines)
    return (n >= 12) & (F.size(F.filter(lines, has_amount)) >= 6) & (F.size(F.filter(lines, lambda x: F.length(x) <= 45)) * 10 >= n * 6)


def clean_cell(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def join_cells(cells: Column) -> Column:
    """A row's cells between bars; an identifier that is cut after its hyphen is put together."""
    return F.replace(F.regexp_replace(F.array_join(cells, "\n"), r"-\n(?=[\p{L}\p{N}])", "-"), F.lit("\n"), F.lit(" | "))


def is_header(cells: Column) -> Column:
    """Whether a row names columns, and has no number of four digits or more itself."""
    text = F.array_join(cells, " ")
    return F.rlike(text, F.lit(HEADER_HINT)) & ~F.rlike(text, F.lit("[0-9][0-9,]{3,}"))


def is_tabular(rows: Column) -> Column:
    """Whether rows of cells are a table: two or more, with a header first, or amounts in at least two and half of them."""
    priced = F.size(F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(has_amount(c), F.lit(False)))))
    return (F.size(rows) >= 2) & (is_header(F.get(rows, F.lit(0))) | (priced >= F.greatest(F.lit(2), F.floor(F.size(rows) / 2))))


def register_prose(pages: DataFrame) -> DataFrame:
    """(page_id, prose) of the pages that register_rows() reads: what stands before the first row.

    A page is read if it has LEAST_ROWS lines with a date, and amounts in as many of the segments that these begin: strays have none, and what joins cells is no part of an
    amount. So this is decided in the page's row; page_id is a page's own."""
    lines = F.split("text", "\n")
    marks = F.transform(lines, lambda x: F.struct(F.rlike(x, F.lit(ROW_DATE)).alias("dated"), has_amount(x).alias("priced")))
    start = F.struct(F.lit(0).alias("segments"), F.lit(0).alias("priced"), F.lit(True).alias("counted"))

    def step(acc: Column, mark: Column) -> Column:
        new = mark["priced"] & (mark["dated"] | ~acc["counted"])
        return F.struct((acc["segments"] + mark["dated"].cast("int")).alias("segments"), (acc["priced"] + new.cast("int")).alias("priced"), F.when(mark["dated"], mark["priced"]).otherwise(acc["counted"] | mark["priced"]).alias("counted"))

    enough = lambda acc: (acc["segments"] >= LEAST_ROWS) & (acc["priced"] >= LEAST_ROWS)
    told = lambda m: F.when(F.aggregate(m, start, step, enough), F.array_position(F.transform(m, lambda x: x["dated"]), True).cast("int") - 1)
    # inside a lambda, so that the lines are searched once
    first = F.get(F.transform(F.array(marks), told), F.lit(0))
    read = pages.where(F.col("page_id").isNotNull() & F.rlike("text", F.lit(REGISTER_HINT))).select("page_id", lines.alias("lines"), first.alias("first")).where("first is not null")
    return read.select("page_id", F.array_join(F.slice("lines", F.lit(1), F.col("first")), "\n").alias("prose"))


def register_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row_no, row) of pages that are flattened registers: lines are gathered from one date to the next,
    short segments without amount go before the next, identifiers cut at a hyphen are joined."""
    lines = pages.where(F.rlike("text", F.lit(REGISTER_HINT))).select("page_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    by_page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("segment", F.sum(F.rlike("line", F.lit(ROW_DATE)).cast("int")).over(by_page))
    cells = lines.where("segment > 0 and trim(line) != ''").groupBy("page_id", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("cell")))).alias("cells"))
    row = join_cells(F.transform("cells", lambda c: c["cell"]))
    rows = cells.select("page_id", "segment", row.alias("row"))
    enough = rows.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).select("page_id")
    rows = rows.join(enough, "page_id", "left_semi").withColumn("stray", ~has_amount(F.col("row")) & (F.length("row") <= STRAY))
    # A stray segment belongs to the row that follows: rows are numbered by the full ones before them.
    before = Window.partitionBy("page_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("row_no", F.coalesce(F.sum((~F.col("stray")).cast("int")).over(before), F.lit(0)))
    out = rows.groupBy("page_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("segment", "row"))).alias("parts"))
    out = out.select("page_id", F.col("row_no").cast("int").alias("row_no"), F.array_join(F.transform("parts", lambda p: p["row"]), " | ").alias("row"))
    priced = out.groupBy("page_id").agg(F.count_if(has_amount(F.col("row"))).alias("n")).where(F.col("n") >= LEAST_ROWS).select("page_id")
    return out.join(priced, "page_id", "left_semi")


def chunk_rows(header: Column, rows: Column, limit: int = 800) -> Column:
    """Chunks of whole rows, each under limit characters if it can be, with the header before each."""
    prefix = F.when(F.coalesce(header, F.lit("")) != "", F.concat(F.lit(f"{ROW_MARK} columns: "), header)).otherwise(ROW_MARK)
    line = lambda r: F.concat(F.lit(f"{ROW_MARK} "), r)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def step(acc: Column, row: Column) -> Column:
        added = F.length(line(row)) + 1
        full = (acc["now"] != "") & (F.length(prefix) + acc["size"] + added > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.concat(prefix, acc["now"])))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, F.lit("")).otherwise(acc["now"]), F.lit("\n"), line(row)).alias("now"),
            (F.when(full, 0).otherwise(acc["size"]) + added).alias("size"),
        )

    return F.aggregate(rows, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(F.concat(prefix, acc["now"])))))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _pieces(text: Column, separator: str) -> Column:
    """A text cut before each separator, from the left; nothing of it goes."""
    s = re.escape(separator)
    other = f"[^{s}]" if len(separator) == 1 else rf"(?:(?!{s})[\s\S])"
    return F.regexp_extract_all(text, F.lit(f"{other}++|{s}{other}*+"), F.lit(0))


def _last(pieces: Column, room: Column) -> Column:
    """As many of the last pieces as fit into room."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), room.alias("room"))

    def take(acc: Column, piece: Column) -> Column:
        fits = F.length(piece) <= acc["room"]
        return F.struct(F.when(fits, F.concat(F.array(piece), acc["kept"])).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["room"] - F.length(piece)).otherwise(-1).alias("room"))

    return F.aggregate(F.reverse(pieces), start, take, lambda acc: acc["kept"])


def split_text(text: Column, size: int = 800, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Parts of at most size characters, in order, without blanks at their ends and without empty ones.

    A longer text is cut before each separator of the first rank. Neighbours that fit are put together; a part begins with as many of its predecessor's last pieces as
    have overlap characters at most. A piece too long by itself isn't put together with its neighbours: it is cut by the separators of the next ranks, and with none left
    into windows. Null gives null; a text of blanks, or an empty one, no parts."""
    if not separators:
        more = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / (size - overlap)).cast("int"))
        windows = F.transform(F.sequence(F.lit(0), more), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size)))
        return F.filter(F.transform(windows, stripped), lambda p: p != "")
    none = F.array().cast("array<string>")

    def closed(acc: Column) -> Column:
        part = stripped(F.array_join(acc["now"], ""))
        return F.when(part == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(part)))

    def state(done: Column, now: Column, held: Column) -> Column:
        return F.struct(done.alias("done"), now.alias("now"), held.alias("held"))

    def step(acc: Column, piece: Column) -> Column:
        n = F.length(piece)
        now = F.concat(_last(acc["now"], F.least(F.lit(overlap), size - n)), F.array(piece))
        cut = state(F.concat(closed(acc), split_text(piece, size, overlap, separators[1:])), none, F.lit(0))
        return F.when(n >= size, cut).when(acc["held"] + n > size, state(closed(acc), now, F.length(F.array_join(now, "")))).otherwise(state(acc["done"], F.concat(acc["now"], F.array(piece)), acc["held"] + n))

    short = F.filter(F.array(stripped(text)), lambda p: p != "")
    return F.when(F.length(text) <= size, short).when(text.isNotNull(), F.aggregate(_pieces(text, separators[0]), state(none, none, F.lit(0)), step, closed))


def text_chunks(pages: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """(page_id, chunk_index, text): a page's parts by split_text() that have 20 characters or more, numbered from 0. A page without such parts, or without text, has no rows."""
    parts = F.filter(split_text(F.col("text"), size, overlap), lambda p: F.length(p) >= LEAST_CHUNK)
    return pages.select("page_id", F.posexplode(parts).alias("chunk_index", "text"))
