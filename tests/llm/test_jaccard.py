import random
import re

import numpy as np
import pytest

from tallyweave.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, size, percent):
    sets = [shingles(t, size) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for v in by.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        o = len(sets[a] & sets[b])
        if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            label[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def family(seed, n=130):
    """Copies of copies with a few words changed, near the threshold; short ones; and what they share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=30)
    docs = []
    for base in range(3):
        start = r.choices(vocabulary, k=r.choice([12, 60, 150]))
        made = [start]
        for _ in range(n // 3):
            t = list(r.choice(made))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            made.append(t)
        docs += made
    docs += [passage + r.choices(vocabulary, k=40) for _ in range(40)] + [r.choices(vocabulary[:4], k=r.randrange(6)) for _ in range(40)]
    r.shuffle(docs)
    return [(i, " ".join(t)) for i, t in enumerate(docs)]


ODD = [(-1, None), (-2, ""), (-3, " \n\t"), (None, "a b c d e f"), (900, "A b C d e F"), (900, "a b c d e f"), (901, "x"), (902, "X"), (None, "only null"), (903, "é È"), (904, "É È")]


@pytest.mark.parametrize(("size", "percent", "local", "by_shingle"), [(3, 90, 4096, 1), (5, 80, 4096, 1), (3, 90, 6, 0), (3, 90, 6, 1e9), (3, 70, 8, 0), (3, 70, 8, 1e9)])
def test_matches_brute_force(spark, monkeypatch, size, percent, local, by_shingle):
    monkeypatch.setattr(J, "BY_SHINGLE", by_shingle)
    docs = family(size + percent) + ODD
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as k1").repartition(3)
    got = J.jaccard_components(frame, size, percent, local_sets=local)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, size, percent)


def test_frequent_shingles_keep_links(spark, monkeypatch):
    monkeypatch.setattr(J, "CAP", 3)
    monkeypatch.setattr(J, "SENT_KEYS", 0)
    docs = family(1)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in J.jaccard_components(frame, 3, 90).collect()) == sorted(brute(docs, 3, 90))


def test_compare_scan_streams_a_long_run():
    key, value = np.repeat(np.array([3, 5], np.int64), [2, 6]), np.arange(8)
    k1, token, df = J._shared_runs(key, value, np.zeros(8, np.int8), None)
    assert sorted(zip(k1, token, df, strict=True)) == [(0, 3, 2), (1, 3, 2)] + [(i, 5, 6) for i in range(2, 8)]


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    from tallyweave.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op2_ngram_jaccard"](spark, sf_dir).collect()), key=str) == brute(docs, 3, 90)
