"""Stores that lose nothing, an index that opens few files, sketches, documents of mixed shapes, the table function, and SQL."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave import sql as Q
from tallyweave.functions import money as M
from tallyweave.functions import text as T
from tallyweave.operators import findings as V
from tallyweave.operators import pairs as P
from tallyweave.operators import retrieval as R
from tallyweave.operators import snapshot as S
from tallyweave.plans import catalog
from tallyweave.sources import ledger as L
from tallyweave.sources import postings, sketches, store, variants
from tallyweave.streaming import eventlog

CHUNK = "doc_id string, chunk_index int, text string, version int"


def test_a_second_store_adds(spark, tmp_path):
    path = str(tmp_path / "chunks")
    put = lambda *rows: store.store_chunks(spark.createDataFrame(rows, CHUNK), path)
    held = lambda ids=None: sorted((r.doc_id, r.chunk_index, r.text) for r in store.read_chunks(spark, path, ids).collect())
    put(("a", 0, "old", 1), ("a", 1, "stays", 1))
    put(("b", 0, "other", 1), ("a", 0, "new", 2))
    assert held() == [("a", 0, "new"), ("a", 1, "stays"), ("b", 0, "other")] and held(["b"]) == [("b", 0, "other")]
    put(("a", 0, "older", 0), ("b", 0, "same version, later", 1))
    assert held() == [("a", 0, "new"), ("a", 1, "stays"), ("b", 0, "same version, later")]
    store.delete_chunks(spark.createDataFrame([("a",), (None,), ("nobody",)], "doc_id string"), path)
    assert held() == [("b", 0, "same version, later")]
    put(("a", 5, "again", 1))
    assert held() == [("a", 5, "again"), ("b", 0, "same version, later")]
    store.compact_chunks(spark, path, str(tmp_path / "small"))
    rows = store.read_chunks(spark, str(tmp_path / "small")).collect()
    assert sorted(r.text for r in rows) == ["again", "same version, later"]


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    """A query that starts anew counts its batches from 0 again, and one batch may run twice."""
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(rows, "key string, status string, at long")
    write = eventlog.upsert_into(path, ["key"], F.col("at"))
    assert eventlog.read_upserted(spark, path) is None
    for epoch, row in ((0, ("1", "a", 1)), (1, ("2", "b", 2)), (0, ("3", "c", 3)), (0, ("3", "c", 3)), (1, ("4", "d", 4)), (2, ("1", "stale", 0))):
        write(frame(row), epoch)
    assert sorted(tuple(r)[:2] for r in eventlog.read_upserted(spark, path).collect()) == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]
    (tmp_path / "t" / "99").mkdir()  # a version that was never committed
    write(frame(("5", "e", 5)), 3)
    assert eventlog.read_upserted(spark, path).count() == 5


def test_index_opens_few_files(spark, tmp_path):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [(k, " ".join(r.choices(words, k=12)) + (" The common" if k % 2 else " das common")) for k in range(400)] + [(900, None), (None, "common"), (901, "")]
    chunks = spark.createDataFrame(texts, "doc_id long, text string")
    path = str(tmp_path / "index")
    postings.build(chunks, path, shard=50)
    tokens = lambda t: set(re.findall(r"\w{2,64}", (t or "").lower()))
    for query in ("common THE", "w1 common", "w1 w2", "nowhere common", "w5", "", "a"):
        want = sorted(k for k, t in texts if k is not None and tokens(query) and tokens(query) <= tokens(t))
        assert [x.key for x in postings.search(spark, path, query, 1000).collect()] == want
    whole = len(spark.read.parquet(path).inputFiles())
    plan = postings.read(spark, path, ["w1", "common"])
    opened = {x.f for x in plan.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(opened) <= 2 < whole / 10
    assert postings.search(spark, path, "common", 3).count() == 3
    asked = spark.createDataFrame([(1, "w1 common"), (2, "nowhere"), (3, None), (4, "the w7")], "query_id long, query string")
    got = {(x.query_id, x.key) for x in postings.search_many(spark.read.parquet(path), asked).collect()}
    assert got == {(q, k) for q, s in ((1, "w1 common"), (4, "the w7")) for k, t in texts if k is not None and tokens(s) <= tokens(t)}


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 11 != 0, F.col("id") % 3000).alias("user"), (F.col("id") * 7919 % 10_007).cast("double").alias("v"), F.lit("x").alias("k"))
    days = sketches.sketched(rows, ["day", "k"], "user", "v").cache()
    at_once = sketches.estimates(sketches.merged(days, ["k"]), 0.1, 0.5, 0.99).first()
    halves = sketches.merged(days.where("day > 2"), ["k"]).unionByName(sketches.merged(days.where("day <= 2"), ["k"]))
    in_two = sketches.estimates(sketches.merged(halves, ["k"]), 0.1, 0.5, 0.99).first()
    assert at_once.n == in_two.n == 20_000 and at_once.different == in_two.different
    assert abs(at_once.different - 3000) <= 3000 * sketches.DISTINCT_ERROR
    for told in (at_once, in_two):
        for rank, value in zip((0.1, 0.5, 0.99), told.quantiles, strict=True):
            assert abs(value / 10_007 - rank) <= sketches.RANK_ERROR
    nothing = sketches.sketched(spark.createDataFrame([("a", None, None)], "k string, u long, v double"), ["k"], "u", "v")
    assert [(r.n, r.different, r.quantiles) for r in sketches.estimates(nothing, 0.5).collect()] == [(1, 0, None)]


def test_documents_of_mixed_shapes(spark):
    rows = [("s1", "session", '{"status": "pending", "n": 1}', 1, None), ("s1", "session", '{"status": "done", "docs": [1, 2]}', 5, None), ("s1", "chat", "[1, {}]", 2, 10), ("s2", "session", '"text"', 3, 100), ("s2", "session", "{broken", 9, None), (None, "session", "{}", 1, None), ("s3", "session", None, 1, None), ("s4", "session", "null", 1, None), ("s5", "session", '{"status": "was there"}', 1, None), ("s5", "session", '{"status": "short"}', 4, 3)]
    entries = spark.createDataFrame(rows, "key string, kind string, document string, at long, ttl int").withColumn("written_at", F.timestamp_seconds("at")).drop("at")
    kept, apart = variants.parsed(entries)
    assert sorted((r.key, r.document) for r in apart.collect() if r.key) == [("s2", "{broken"), ("s3", None)] and apart.count() == 3
    now = lambda s: variants.current(kept, F.timestamp_seconds(F.lit(s))).select("key", "kind", variants.field("$.status", "string").alias("status"), variants.field("$.docs[1]", "int").alias("second"))
    assert sorted(map(tuple, now(6).collect()), key=str) == [("s1", "chat", None, None), ("s1", "session", "done", 2), ("s2", "session", None, None), ("s4", "session", None, None), ("s5", "session", "short", None)]
    assert {(r.key, r.kind) for r in now(200).collect()} == {("s1", "session"), ("s4", "session")}
    assert {r.kind: r.n for r in variants.shapes(kept).collect()} == {"session": 6, "chat": 1}


def told_again(rows):
    """The fold as the rules say it: each finding against all kept ones, from the first on."""
    kept = []
    for f in rows:
        at = next((k for k, p in enumerate(kept) if V.Stories.same(f, p)), None)
        if at is None:
            kept.append(f)
        elif (f.rank, f.confidence) > (kept[at].rank, kept[at].confidence):
            kept[at] = f
    return [f.finding_id for f in kept]


def test_fold_looks_where_it_must(spark):
    r = random.Random(8)
    titles = ["Bank paid more", "Invoice subtotal differs", "VAT differs", "Milestone missed", "Nothing special", "nothing special at all", "Retainer of March"]
    said = lambda: r.choice(["", "EGP 1,000", "EGP 1,000 and EGP 2,500", "EGP 2,500 of INV-2024-01", "about INV-2024-01", "CTR 2024 7"])
    rows = [(r.choice([1, 1, 2]), k, f"f{k}", r.choice(["critical", "warning", "ok", None]), r.choice([0.5, 0.9, None]), r.choice([*titles, None]), r.choice([None, said()]), r.choice(["d1", "d2", None]), r.choice(["d2", "d3", None])) for k in range(250)]
    frame = spark.createDataFrame(rows, "audit_id long, seq long, finding_id string, severity string, confidence double, title string, description string, source_doc_id string, conflicting_doc_id string")
    told = V.told(frame).orderBy("seq").collect()
    want = {a: told_again([x for x in told if x.audit_id == a]) for a in (1, 2)}
    got = V.dedupe(frame).orderBy("position").collect()
    assert {a: [x.finding_id for x in got if x.audit_id == a] for a in (1, 2)} == want and len(got) < len(rows)
    assert V.dedupe(frame.limit(0)).count() == 0


def test_sql_says_what_columns_say(spark):
    Q.register(spark)
    r = random.Random(5)
    rows = [(r.choice([None, round(r.uniform(-50, 60_000), 2)]), r.choice([None, 50.0, 149.99, 1000.0]), r.choice([None, "", " egp", "EGP", "usd"]), r.choice([None, "EGP", "USD "]), r.choice([None, "Chairman of the Board", "chief executive officer", "CFO", "Clerk", "Managing Director "]), r.choice(["ok", "critical", "warning"]), r.choice([0.3, 0.5, 0.6, 0.9]), r.choice(["llm", "graph", "detector"]), r.choice([[], ["a"], ["a", " ", "b"]])) for _ in range(200)]
    frame = spark.createDataFrame(rows, "v double, w double, a string, b string, title string, severity string, confidence double, source string, evidence array<string>")
    money = lambda c: F.col(c).cast("decimal(18,2)")
    both = {
        "tw_coarse(v)": M.coarse(F.col("v")), "tw_same_currency(a, b)": P.same_currency(F.col("a"), F.col("b")), "tw_differ(v, w)": P.materially_different(money("v"), money("w")), "tw_severity(v, w / 1000)": P.severity(F.col("v"), F.col("w") / 1000),
        "tw_authority(title)": T.authority_of(F.col("title")), "tw_verdict(severity, confidence, size(filter(evidence, e -> trim(e) <> '')), source)": V.verdict(*(F.col(c) for c in ("severity", "confidence", "evidence", "source"))),
    }
    for text, column in both.items():
        assert frame.select(F.expr(text).eqNullSafe(column).alias("same")).where("not same").count() == 0, text


@pytest.mark.parametrize("numbers", [24, R.TILE_NUMBERS])
def test_nearest_with_ties_and_odd_vectors(spark, numbers):
    r = np.random.default_rng(2)
    vectors = [(k, (r.normal(size=4) if k % 3 else np.ones(4) * (k + 1)).tolist()) for k in range(60)] + [(100, None), (101, [0.0] * 4), (102, [1.0, 2.0]), (None, [1.0] * 4), (103, [float("nan")] + [1.0] * 3)]
    asked = [(1, [1.0] * 4), (2, vectors[1][1]), (3, [0.0] * 4), (4, None), (5, [3.0, 1.0])]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id long, query array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in R.vector_top_k(q, v, 5, numbers).collect())
    want = []
    for i, a in asked:
        if a and any(a):
            near = sorted((-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12), k) for k, b in vectors if k is not None and b and len(b) == len(a) and any(b) and not np.isnan(b).any())
            want += [(i, n + 1, k) for n, (_, k) in enumerate(near[:5])]
    assert got == want


def test_snapshot_reads_its_ledger_twice(spark, sf_dir):
    frame = catalog.QUERIES["recon_snapshot"](spark, sf_dir)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.partition("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 8 and "NestedLoop" not in final and "Python" not in final


def test_identifiers_beyond_one_array(spark, monkeypatch):
    """An audit with more identifiers than stand in one array beside its lines."""
    monkeypatch.setattr(S, "CORES", 2)
    lines = spark.createDataFrame([(1, f"paid TXN-{k} for CTR-2024/{k:03d}") for k in range(9)], "audit_id long, line string")
    refs = spark.createDataFrame([(1, f"TXN-{k}") for k in range(9)], "audit_id long, txn_ref string")
    cores = S.identifier_cores(spark.createDataFrame([(1, f"ctr 2024-{k:03d}") for k in (1, 3, 4, 5, 8)], "audit_id long, identifier string"))
    assert sorted(r.txn_ref for r in S.linked_refs(lines, cores, refs).collect()) == [f"TXN-{k}" for k in (1, 3, 4, 5, 8)]


def test_levels_tell_totals_from_nulls(spark):
    rows = [("s", 1, "vat", "critical", 0.5), ("s", 1, None, "warning", 1.0), (None, 2, "vat", "critical", None)]
    out = V.levels(spark.createDataFrame(rows, "scope string, audit_id long, topic string, severity string, confidence double")).collect()
    of = lambda level: sorted(((r.scope, r.audit_id, r.topic, r.severity, r.findings, r.critical) for r in out if r.level == level), key=str)
    assert of(15) == [(None, None, None, None, 3, 2)] and of(7) == [("s", None, None, None, 2, 1), (None, None, None, None, 1, 1)]
    assert of(5) == [("s", None, "vat", None, 1, 1), ("s", None, None, None, 1, 0), (None, None, "vat", None, 1, 1)] and len(of(0)) == 3


def test_ledger_links_feed_the_library(spark, sf_dir):
    links = L.contract_links(L.table(spark, sf_dir, "orders"))
    assert S.anchor_rows(links).count() == links.select("audit_id", "anchor_id").distinct().count() > 0
