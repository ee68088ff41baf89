import re

from tallyweave.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        if i is not None and n:
            windows.setdefault(str(i), set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for d, t in docs:
        w = words(t)
        hit, got = set(), set()
        for i, ws in windows.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        got.add(i)
        out.append((d, len(w), len(hit), len(got), D.sha256_of(list(got)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


DOCS = [
    (1, "One two three FOUR, five!\nsix seven"),
    (2, None),
    (3, ""),
    (4, "... --- ..."),
    (5, "one two three four one two three four five É über-straße x"),
    (5, "one two three four one two three four five É über-straße x"),
    (None, "alone"),
    (7, "a b " * 3000 + "one two three four five"),
]
ITEMS = [(1, "one two three four five six"), (2, "alone"), (3, "é ÜBER straße"), (4, None), (5, ""), (10, "four one two"), (10, "four one two"), (None, "a b a b"), (9, "é")]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_words", "2 as items"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc_id")


def test_matches_brute_force(spark):
    docs, items = frames(spark)
    for block in (D.BLOCK_CHARS, 10):
        got = [tuple(r) for r in D.digest(D.scan(docs, items, 4, block)).collect()]
        assert sorted(got, key=str) == sorted(brute(DOCS, ITEMS, 4), key=str)


def test_spans_are_places_in_the_original(spark):
    docs, items = frames(spark)
    rows = {r.doc_id: r for r in D.scan(docs, items, 4).collect()}
    text = dict(DOCS)[5]
    assert [text[a:b] for a, b in rows[5].spans][0].startswith("one two three four one")
    assert text[rows[5].spans[0].first : rows[5].spans[0].last] == "one two three four one two three four five"


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert D.scan(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in D.scan(docs, items.limit(0)).collect()} == {0}


def test_query_matches_brute_force(spark, sf_dir):
    from tallyweave.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op1_decontamination"](spark, sf_dir).collect())
    want = sorted(brute(docs, items, 13))
    assert got == want
    assert any(r[5] for r in got)
