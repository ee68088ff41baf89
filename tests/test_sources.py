import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyweave.engine import Engine
from tallyweave.hooks import repaired
from tallyweave.plans import catalog
from tallyweave.sources import files, ledger


def test_uploads_and_pages(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.4 page one\x0cpage two is long enough to not be a scan, in all likelihood"), ("b.txt", b"%PDF-"), ("c.pdf", b""), ("d.pdf", b"nope"), ("e.pdf", b"%PDF-broken")):
        (tmp_path / name).write_bytes(data)
    found = files.uploads(spark, str(tmp_path))
    assert {r.filename: r.error for r in found.collect()} == {"a.pdf": None, "b.txt": "not a PDF file name", "d.pdf": "not a PDF", "e.pdf": None}
    assert files.request_error(found) == "b.txt: not a PDF file name"

    def extract(content):
        if b"broken" in content:
            raise ValueError("cannot read")
        return content.decode().split("\x0c")

    rows = {(r.filename, r.page_num): (r.is_scanned, r.error) for r in files.page_text(found, extract).collect()}
    assert rows == {("a.pdf", 1): (True, None), ("a.pdf", 2): (False, None), ("e.pdf", None): (None, "cannot read")}
    engines = [lambda content, index: " ", lambda content, index: f"read {index}"]
    read = {(r.filename, r.page_num): (r.text[:6], r.ocr_used) for r in files.page_text(found.where("filename = 'a.pdf'"), extract, engines).collect()}
    assert read == {("a.pdf", 1): ("read 0", True), ("a.pdf", 2): ("page t", False)}


def test_exports_and_scope(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi"', "a,b"), (2, "plain", None)], "id int, a string, b string")
    files.export_csv(rows.coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert part.read_text() == 'id,a,b\n1,"say ""hi""","a,b"\n2,plain,\n'
    files.export_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert [r.id for r in files.in_scope(spark.createDataFrame([("h", 7), ("k", 2)], "scope string, id int"), "k", ["k", "h"], header="h").collect()] == [7]
    scoped = spark.createDataFrame([("default", 1), ("k", 2)], "scope string, id int")
    assert [r.id for r in files.in_scope(scoped, None, []).collect()] == [1]
    assert [r.id for r in files.in_scope(scoped, "k", ["k"]).collect()] == [2]
    with pytest.raises(PermissionError):
        files.in_scope(scoped, "x", ["k"])
    kept = files.alive(spark.createDataFrame([(1, 5), (2, None), (3, 1)], "id int, expires_at int"), F.lit(3))
    assert {r.id for r in kept.collect()} == {1, 2}
    carried = files.carry_headers(spark.createDataFrame([(1, 1, "h"), (1, 2, None), (2, 1, None)], "page_id int, fragment int, header string"))
    assert [r.header for r in carried.orderBy("page_id", "fragment").collect()] == ["h", "h", None]


def test_engine(spark, sf_dir):
    engine, rows = Engine(spark), ledger.amounts(spark, sf_dir)
    assert engine.snapshot(rows).count() > 0
    assert {r.severity for r in engine.contradictions(rows).collect()} <= {"critical", "warning"}
    report = engine.report(catalog.findings(spark, sf_dir)).collect()
    assert report and all("Overall risk" in r.summary for r in report)
    chunks = spark.createDataFrame([(1, "About INV 2024 1"), (2, "other")], "doc_id long, text string")
    assert [r.doc_id for r in engine.search(chunks, "where is INV-2024-1").collect()] == [1]
    prior = spark.createDataFrame([(1, "A"), (2, "B")], "audit_id long, description string")
    fresh = spark.createDataFrame([(1, "a "), (1, "C"), (2, "C")], prior.schema)
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "audit_id long, doc_id string")
    got = engine.replan(prior, fresh, docs.limit(0).select("audit_id"), docs)
    assert {tuple(r) for r in got.collect()} == {(1, "A"), (2, "B"), (1, "C")}


def test_repair_must_keep_the_numbers(spark):
    whole, fixed = "1,000.50 x 7.00\ny 8.25", "a | 7.00\nb | 8.25\nc | 1000.50"
    rows = spark.createDataFrame([(whole, fixed), (whole, fixed.replace("8.25", "8.26")), ("1,000.50 and 7", "7 | 1000.5"), ("1 2", "1 3")], "a string, b string")
    assert [r[0] for r in rows.select(repaired(F.col("a"), F.col("b"))).collect()] == [fixed, whole, "1,000.50 and 7", "1 2"]


@pytest.mark.parametrize("gone", [["tallyweave/llm", "tests/llm"], ["tallyweave/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    """In a copy without these files the entry imports, and all other queries are there."""
    root = Path(__file__).resolve().parent.parent
    away = [root / x for x in gone]
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or Path(folder, n) in away])
    said = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run([sys.executable, "-c", said], cwd=tmp_path / "copy", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    names, oracles = map(set, json.loads(done.stdout.splitlines()[-1]))
    assert set(catalog.QUERIES) <= names and set(catalog.ORACLES) <= oracles <= names
    assert "pipeline" not in names and any(n.startswith("op1_") for n in names) == ("tallyweave/llm" not in gone)
