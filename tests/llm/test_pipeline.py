import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from tallyweave.llm import decontamination, encoding
from tests.llm import test_decontamination, test_jaccard, test_quality, test_suffixes


def cut(text, spans):
    """The text without these words and the white space after each run."""
    at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    for a, b in reversed(spans):
        text = text[: at[a]] + text[at[b] :]
    return text


def brute(docs, items, verdicts):
    docs = [(d, t) for d, t in docs if verdicts[d]]
    groups = {d: c for d, _, c in test_jaccard.brute(docs, P.SHINGLE, P.SIMILAR)}
    docs = [(d, t) for d, t in docs if groups[d] == d]
    cuts = test_suffixes.brute(docs, 50)
    docs = [(d, cut(t, cuts[d][1]) if d in cuts else t) for d, t in docs]
    bad = {r[0] for r in test_decontamination.brute(docs, items, 13) if r[5]}
    docs = [(d, t) for d, t in docs if d not in bad]
    encode = Tokenizer.from_file(encoding.default_path()).encode
    out = Counter()
    for d, t in docs:
        ids = np.array([*encode(t, add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            out[(d, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids))] += 1
    return out


def test_pipeline_matches_brute_force(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = test_quality.brute_verdicts([(r.doc_id, r.text, r.lang) for r in frame.collect()])
    verdicts = {d: found[i][2] for i, (d, _) in enumerate(docs)}
    rows = P.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == brute(docs, items, verdicts)


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    long = " ".join(f"wort{i % 977} und{i}" for i in range(90_000))
    odd = spark.createDataFrame([(None, "no id " * 60, None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, long, "xx", "s", len(long)), (10**9 + 3, long, "xx", "s", len(long))], frame.schema)
    docs = frame.union(frame.limit(5)).union(odd).selectExpr("*", "'x' as kept", "1 as component_id", "'a' as _id", "'b' as _cuts", "'c' as _removed", "'d' as cuts", "'e' as bucket")
    assert len(long) > 1_000_000
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and {tuple(r) for r in out.select("_id", "_cuts", "_removed", "bucket").collect()} == {("a", "b", "c", "e")}
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert None in ids and len(ids) <= docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        texts = {r.doc_id: r.text for r in rows}
        assert ids.count(10**9 + 2) == 1 and texts[10**9 + 2] == long, name
        assert texts.get(10**9 + 3, None) == {"n-gram Jaccard join": None, "suffix-array dedup": ""}.get(name, long), name
    assert {r.doc_id for r in P.quality_rules(spark, docs, sf_dir).where("doc_id >= 1000000000").collect()} == {10**9 + 2, 10**9 + 3}
    packed = P.pack_sequences(spark, docs, sf_dir)
    assert packed.where(f"doc_id = {10**9 + 2}").agg({"length": "sum"}).first()[0] == packed.where(f"doc_id = {10**9 + 2}").first().doc_tokens > 200_000
    assert P.pack_sequences(spark, docs.limit(0), sf_dir).count() == 0
    assert decontamination.WINDOW == 13


def test_tables_of_stages_go(spark, sf_dir):
    from tallyweave.llm import shared

    shared.drop_tables(spark)
    rows = P.run(spark, sf_dir)
    assert rows.count() > 0 and len(shared._tables) <= 3
    shared.drop_tables(spark)
    assert not shared._tables
