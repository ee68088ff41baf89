"""Tables out of word boxes: the cases of a page without ruled lines, with them, and of prose."""

import pytest

from tallyweave.operators import layout as Y

HEADER = ["Date", "Ref No.", "Description", "Debit (EGP)", "Credit (EGP)", "Balance (EGP)"]
ROWS = [
    ["05/01/2025", "TXN-002", "Payment to Nile Advance", "50,000.00", "", "750,000.00"],
    ["12/01/2025", "TXN-003", "Office Rent Q1 2025", "75,000.00", "", "675,000.00"],
    ["20/01/2025", "TXN-004", "Supplier Payment Al Wadi", "", "120,000.00", "555,000.00"],
    ["31/01/2025", "TXN-005", "Payment to Nile INV M1", "68,400.00", "", "486,600.00"],
]
AT = [40, 110, 190, 380, 460, 540]
SCHEMA = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def text(doc, page, x, y, said, wide=4.0, high=8.0, wobble=0.0):
    out = []
    for k, word in enumerate(said.split()):
        out.append((doc, page, float(x), y + (wobble if k % 2 else 0.0), float(x + wide * len(word)), y + high, word))
        x += wide * (len(word) + 1)
    return out


def register(doc, page, rows, top=80.0, wobble=0.0):
    return [w for k, row in enumerate(rows) for cell, x in zip(row, AT, strict=True) for w in text(doc, page, x, top + 22 * k, cell, wobble=wobble)]


PROSE = ["This Agreement is made between Delta Trading Group and Nile Financial", "Consulting. The parties agree to the terms and conditions set out herein,", "including scope, deliverables, payment and termination provisions."]


def prose(doc, page, top):
    return [w for k, said in enumerate(PROSE) for w in text(doc, page, 50, top + 12 * k, said)]


def rows_of(frame, **more):
    return sorted((r.doc_id, r.page, r.table_no, r.row_no, r.header, r.row) for r in Y.table_rows(frame, **more).collect())


def joined(row):
    return " | ".join(row)


@pytest.mark.parametrize("wobble", [0.0, 2.5])
def test_borderless_register_between_prose(spark, wobble):
    words = spark.createDataFrame(register("a", 1, [HEADER, *ROWS], wobble=wobble) + prose("a", 1, 20.0) + prose("a", 1, 300.0), SCHEMA).repartition(3)
    found = Y.tables(words)
    assert rows_of(found) == [("a", 1, 1, k, joined(HEADER), joined(r)) for k, r in enumerate(ROWS)]
    assert [r.text for r in Y.prose(words, found).collect()] == ["\n".join(PROSE * 2)]


def test_prose_is_no_table(spark):
    words = spark.createDataFrame(prose("a", 1, 50.0), SCHEMA)
    assert Y.tables(words).count() == 0 and [r.text for r in Y.prose(words, Y.tables(words)).collect()] == ["\n".join(PROSE)]
    # set in columns, but neither names columns nor has amounts
    columns = [w for k, (a, b, c) in enumerate([("The parties", "agree", "to terms"), ("of scope", "and of", "deliverables")]) for x, t in ((40, a), (200, b), (400, c)) for w in text("a", 1, x, 80.0 + 20 * k, t)]
    assert Y.tables(spark.createDataFrame(columns, SCHEMA)).count() == 0


def test_headers_are_carried(spark):
    """A page's second table takes the first one's names; those of the page before only if asked."""
    words = register("a", 1, [HEADER, *ROWS]) + text("a", 1, 50, 210.0, "Carried forward as follows") + register("a", 1, ROWS[:2], 240.0) + register("a", 2, ROWS[2:], 80.0) + register("b", 1, ROWS[:3], 80.0)
    found = Y.tables(spark.createDataFrame(words, SCHEMA))
    heads = lambda **more: sorted({(r[0], r[1], r[2], r[4]) for r in rows_of(found, **more)})
    h = joined(HEADER)
    assert heads() == [("a", 1, 1, h), ("a", 1, 2, h), ("a", 2, 1, ""), ("b", 1, 1, "")]
    assert heads(across_pages=True) == [("a", 1, 1, h), ("a", 1, 2, h), ("a", 2, 1, h), ("b", 1, 1, "")]


def test_a_header_alone_masks_its_place_and_is_handed_on(spark):
    words = register("a", 1, [HEADER, [""] * 6]) + register("a", 1, ROWS, 300.0)
    found = Y.tables(spark.createDataFrame(words, SCHEMA))
    assert found.count() == 1  # one row is none
    words += register("a", 1, [HEADER], 102.0)
    found = Y.tables(spark.createDataFrame(words, SCHEMA))
    assert [r.table_no for r in found.orderBy("y0").collect()] == [1, 2]
    assert {(r[2], r[4]) for r in rows_of(found)} == {(1, joined(HEADER)), (2, joined(HEADER))}


def test_empty_columns_and_a_row_alone(spark):
    words = register("a", 1, [[*r[:4], "", r[5]] for r in ROWS if r[3]]) + register("b", 1, ROWS[:1])
    found = Y.tables(spark.createDataFrame(words, SCHEMA))
    assert {(r[0], r[5]) for r in rows_of(found)} == {("a", joined([*r[:4], r[5]])) for r in ROWS if r[3]}


def rule(x0, y0, x1, y1):
    return ("a", 1, float(x0), float(y0), float(x1), float(y1))


def test_ruled_lines_go_first(spark):
    """Cells without space between them, one of two lines, and an empty one: only lines part them. A page with a ruled table has no other."""
    xs, ys = [40, 80, 140, 200], [70, 90, 120, 140]
    rules = [rule(x, ys[0], x, ys[-1]) for x in xs] + [rule(xs[0], y, xs[-1], y) for y in ys]
    words = text("a", 1, 42, 76.0, "Date") + text("a", 1, 82, 76.0, "Item") + text("a", 1, 142, 76.0, "Amount")
    words += text("a", 1, 42, 94.0, "05/01/25") + text("a", 1, 82, 94.0, "Rent of the") + text("a", 1, 82, 106.0, "house") + text("a", 1, 142, 94.0, "75,000.00")
    words += text("a", 1, 42, 126.0, "06/01/25") + text("a", 1, 142, 126.0, "1.50") + register("a", 1, [HEADER, *ROWS], 200.0)
    schema = SCHEMA.rpartition(",")[0]
    found = Y.tables(spark.createDataFrame(words, SCHEMA), spark.createDataFrame(rules, schema))
    assert [(r[4], r[5]) for r in rows_of(found)] == [("Date | Item | Amount", "05/01/25 | Rent of the house | 75,000.00"), ("Date | Item | Amount", "06/01/25 |  | 1.50")]
    # two columns are too few, and then the page is read without lines
    few = Y.tables(spark.createDataFrame(words, SCHEMA), spark.createDataFrame([r for r in rules if r[2] != 80 and r[2] != 140 or r[4] != r[2]], schema))
    assert {r.ruled for r in few.collect()} == {False}


def test_odd_boxes(spark):
    words = [(None, 1, 1.0, 1.0, 2.0, 2.0, "x"), ("a", None, 1.0, 1.0, 2.0, 2.0, "x"), ("a", 1, None, 1.0, 2.0, 2.0, "x"), ("a", 1, 1.0, 1.0, 2.0, 2.0, None), ("a", 1, 1.0, 1.0, 2.0, 2.0, " ")]
    frame = spark.createDataFrame(words, SCHEMA)
    assert Y.tables(frame).count() == 0 and Y.prose(frame, Y.tables(frame)).count() == 0
    assert Y.tables(frame.limit(0), spark.createDataFrame([], SCHEMA.rpartition(",")[0])).count() == 0
    twice = spark.createDataFrame(register("a", 1, ROWS) * 2, SCHEMA)
    assert Y.tables(twice).count() == 1


def test_words_are_dealt_to_their_pages_once(spark):
    rows = [("d", 1, 40.0 + 100 * c, 20.0 * r, 80.0 + 100 * c, 20.0 * r + 8, f"{r}{c}.00") for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    found = Y.tables(spark.createDataFrame(rows, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert [x.cells for x in found.collect()] == [[["00.00", "01.00", "02.00"], ["10.00", "", "12.00"], ["20.00", "21.00", "22.00"]]]
