import uuid

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import money as M
from tallyweave.functions import text as T

MONEY = [
    ("5000", 5000.0), ("5,000.50", 5000.5), ("EGP 1,234.50", 1234.5), ("1,234.50 USD", 1234.5), ("١٢٣٤ جنيه", 1234.0), ("۱۲۳ EUR", 123.0),
    ("INV-2024-0837", 837.0), ("contract 12 of 34", None), ("1,000 USD and 3,000 EUR", None), ("1,000 USD and 2,000 EUR", 1000.0), ("paid in 2024 500 USD", 500.0), ("2024", 2024.0), ("year 2024", None),
    ("", None), (None, None), ("no money", None), ("ref 7, ref 7", 7.0), ("US$ 10", 10.0), ("10 LE.", 10.0),
]


@pytest.mark.parametrize(("text", "value"), MONEY)
def test_parse_amount(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(M.parse_amount(F.col("t"))).first()[0] == value


def test_currency_and_scan(spark):
    rows = spark.createDataFrame([("EGP 5", "EGP"), ("5 USD or 6 US$", "USD"), ("USD and EUR", None), ("٥ جنيه", "EGP"), ("none", None), (None, None)], "t string, c string")
    assert all(r[0] == r[1] for r in rows.select(M.currency_code(F.col("t")), "c").collect())
    scan = spark.createDataFrame([("paid 226,700.00 vs 200000 in 2024, no 12",)], "t string").select(M.scan_amounts(F.col("t"))).first()[0]
    assert scan == [226700.0, 200000.0]
    assert [r[0] for r in spark.createDataFrame([(9_949.0,), (9_950.0,), (12_500.0,), (13_500.0,)], "v double").select(M.coarse(F.col("v"))).collect()] == [9900.0, 10000.0, 12000.0, 14000.0]


def test_amounts_inside_lambdas(spark):
    rows = spark.createDataFrame([(["5 USD", "x"],)], "a array<string>")
    assert rows.select(F.transform("a", M.parse_amount)).first()[0] == [5.0, None]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.detect_language(F.lit("مرحبا"))) == "arabic"
    assert one(T.detect_language(F.lit("hello"))) == "english"
    assert one(T.detect_language(F.lit("فاتورة abcdef"))) == "mixed"
    assert one(T.detect_language(F.lit("12 !"))) == "unknown" == one(T.detect_language(F.lit(None).cast("string")))
    assert one(T.normalize_arabic(F.lit("إِلـى  مَ"))) == "الي م"
    assert one(T.identifier_core(F.lit(" CTR-2024/044 "))) == "ctr2024044"
    assert one(T.authority_of(F.lit("Chief Financial Officer"))) == "cfo"
    assert one(T.id_tokens(F.lit("See INV-2024-1, inv-1 and INV-2024-1 PLAIN C/MOH/2023"))) == ["INV-2024-1", "C/MOH/2023"]
    assert one(T.title_type(F.lit("x"), F.lit("INV_AB-2024.pdf"))) == "invoice"


def test_uuid5_is_the_standard_one(spark):
    ns = uuid.UUID("6f3a8f5a-2c1b-4d3e-8a9f-1b2c3d4e5f6a")
    keys = ["", "a", "contract_id::ctr2024044", "é عقد"] + [f"k{i}" for i in range(60)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", T.uuid5(ns.hex, F.col("k"))).collect()
    assert all(u == str(uuid.uuid5(ns, k)) for k, u in got)


def test_whole_texts_reach_language_and_normalisation(spark, sf_dir):
    from tallyweave.plans import catalog

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    languages = {(r.id, r.form): r.language for r in catalog.QUERIES["detect_language"](spark, sf_dir).collect()}
    normal = {(r.id, r.form): r.text for r in catalog.QUERIES["normalize_text"](spark, sf_dir).collect()}
    assert set(languages) == set(normal) == {(i, f) for i in texts for f in range(4)}
    assert {languages[k] for k in languages if k[1] == 1} >= {"arabic"} and {languages[k] for k in languages if k[1] == 3} == {"unknown"}
    for i, t in texts.items():
        words = t.split()
        assert normal[i, 0].split() == words and normal[i, 2].split()[-len(words) :] == words
        assert len(normal[i, 1].split()) == len(words) + 2


def test_amounts_without_decimals_are_written_one_way(spark):
    """Halves go to even, as the reference's own formatting has them, with thousands and without."""
    values = [1002.5, 1003.5, 1004.5, 2000.49]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(*(v.alias(f"f{k}") for k, v in enumerate(M.variants(F.col("v"))))).collect()
    assert [tuple(r) for r in rows] == [(f"{v:,.2f}", f"{v:,.0f}", f"{v:.2f}", f"{v:.0f}") for v in values]


def test_currencies_are_found_once_and_as_before(spark):
    texts = ["Total: usd 5", "x US$ 5 and EGP", "le", "١٠ جنيه", "5 ج.م", "ج م", "salaries", "u s d", None, "", "USDEUR", "[TABLE ROW] 1.00", "ريال USD"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", M.currency_code(F.col("t")).alias("c"))
    assert [r.c for r in frame.orderBy("i").collect()] == ["USD", None, "EGP", "EGP", "EGP", None, None, None, None, None, None, "EGP", None]
    # a text is searched once
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
