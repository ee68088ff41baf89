import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyweave.llm import encoding, lengths, packing


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(encoding.default_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_library(plain):
    e = encoding.encoder(encoding.default_path())
    chars = [chr(c) for c in [*range(0x600), *range(0x2000, 0x2070), 0x3000, 0x30A2, 0x4E2D, 0xAC00, 0x1C89, 0x1F600, 0xFEFF]]
    for c in chars:
        for t in (c, f"a{c}b", f" {c} {c}{c} x", f"1{c}'s  {c}\n\n {c}"):
            assert e.ids(t) == plain(t), repr(t)
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice(chars) for _ in range(60))
        assert e.ids(t) == plain(t)
    assert e.ids("x <|endoftext|> y") == plain("x <|endoftext|> y")
    assert e.ids(None) == e.ids("") == []


def one_by_one(histogram, size):
    """Best fit, piece by piece."""
    windows = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [i for i, c in enumerate(windows) if c >= length]
            if fits:
                windows[min(fits, key=lambda i: windows[i])] -= length
            else:
                windows.append(size - length)
    return Counter(windows)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 15), max_size=12))
def test_plan_is_best_fit_decreasing(histogram):
    size = 24
    filled = defaultdict(list)
    for p in packing.best_fit_decreasing(histogram, size):
        for r in range(p.first, p.last):
            filled[p.sequence + (r - p.first) // p.each].append((p.offset + (r - p.first) % p.each * p.length, p.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    assert Counter(n for parts in filled.values() for _, n in parts) == Counter(histogram)
    assert sorted(filled) == list(range(len(filled)))
    assert Counter(size - sum(n for _, n in parts) for parts in filled.values()) == one_by_one(histogram, size)


def docs(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "a b c " * 2000), (4, "a b c " * 2000), (None, "é\U0001f600"), (6, "hello world")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as length", "8 as bucket")


@pytest.mark.parametrize("bucket", [2, 50_000])
def test_packing_round_trip(spark, plain, bucket):
    frame = docs(spark)
    rows = packing.pack(frame, size=16, bucket_pieces=bucket).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in frame.collect()], plain, 16)
    assert packing.pack(frame.limit(0)).count() == 0


def check_packed(rows, texts, plain, size):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    want = Counter()
    for d, t in texts:
        ids = np.array([*plain(t), 0], "<u4")
        for at in range(0, len(ids), size):
            want[(d, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want


def test_packing_query(spark, sf_dir, plain):
    from tallyweave.llm.queries import QUERIES

    rows = QUERIES["op8_packing"](spark, sf_dir).collect()
    check_packed(rows, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()], plain, 1024)
    n = len({r.sequence_id for r in rows})
    assert sum(r.length for r in rows) > 0.98 * 1024 * (n - 1)


def test_histogram(spark, plain, sf_dir):
    from tallyweave.llm.queries import QUERIES

    lens = [len(plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.n_tokens: r for r in QUERIES["op9_token_counts"](spark, sf_dir).collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lens)
    for limit, r in got.items():
        assert r.docs_from == sum(x >= limit for x in lens)
        assert r.tokens_from == sum(x for x in lens if x >= limit)
        assert r.truncated_total == sum(min(x, limit) for x in lens)
        assert abs(r.share_within - sum(x <= limit for x in lens) / len(lens)) < 1e-12
    sums = lengths.suffix_sums(lengths.length_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))).cache()
    for r in lengths.at_limits(sums, [0, 100, 5000, 10**9]).collect():
        assert r.docs_over == sum(x > r.context for x in lens) and r.truncated_total == sum(min(x, r.context) for x in lens)
    assert lengths.quantile(sums, 0.5) == sorted(lens)[(len(lens) - 1) // 2]
    assert lengths.suffix_sums(lengths.length_counts(docs(spark).limit(0))).count() == 0
