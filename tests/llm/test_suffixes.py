import random
import re

import numpy as np
import pytest

from tallyweave.llm import suffixes as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, size):
    """Every window of size words that has two places or more; its first place is kept."""
    places = {}
    for d, t in docs:
        if d is not None:
            w = words(t)
            for i in range(len(w) - size + 1):
                places.setdefault(tuple(w[i : i + size]), set()).add((d, i))
    marks = {}
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                both = marks.setdefault(d, (set(), set()))
                both[0].add(i)
                if (d, i) != min(found):
                    both[1].add(i)
    return {d: tuple(runs(x, size) for x in both) for d, both in marks.items()}


def runs(starts, size):
    out = []
    for i in sorted(starts):
        if out and i <= out[-1][1]:
            out[-1][1] = i + size
        else:
            out.append([i, i + size])
    return [tuple(x) for x in out]


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [r.choices(vocabulary, k=n) for n in (49, 50, 51, 60, 90, 130)]
    docs = []
    for i in range(60):
        t = r.choices(vocabulary, k=r.randrange(80))
        for p in r.sample(passages, r.randrange(3)):
            a = r.randrange(max(1, len(p) - 55))
            t += p[a:] + r.choices(vocabulary, k=r.randrange(40))
        docs.append((i, " ".join(t)))
    docs += [(100 + i, docs[7][1]) for i in range(20)] + [(200, "dup " * 400), (201, "a b c " * 90), (202, "x y " * 24 + "x"), (203, " ".join(passages[3]).upper())]
    docs += [(300, None), (301, ""), (302, "\n"), (None, docs[3][1]), (5, docs[5][1]), (303, "é " * 60 + " ".join(passages[4]))]
    r.shuffle(docs)
    return docs


def found(frame):
    return {r.doc_id: tuple([tuple(x) for x in spans] for spans in (r.repeated, r.removed)) for r in frame.collect()}


@pytest.mark.parametrize(("seed", "size", "sent"), [(1, 50, 10**6), (2, 50, 0), (3, 24, 10**6), (4, 77, 10**6)])
def test_matches_brute_force(spark, seed, size, sent):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as start", "2 as key").repartition(3)
    assert found(S.repeated_passages(frame, size, sent)) == brute(docs, size)


def test_small_batches_and_hot_passages(spark, monkeypatch):
    docs = corpus(9)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for often, block, frequent, sent in ((2, 20_000, 2000, 10**6), (1000, 20_000, 2000, 10**6), (1000, 3, 2000, 10**6), (8, 20_000, 5, 10**6), (1000, 3, 2, 10**6), (8, 20_000, 5, 0)):
            monkeypatch.setattr(S, "OFTEN", often)
            monkeypatch.setattr(S, "FREQUENT", frequent)
            monkeypatch.setattr(S, "BLOCK_ROWS", block)
            assert found(S.repeated_passages(frame, sent_keys=sent)) == brute(docs, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_neighbours_are_compared_by_their_words():
    """compare() against all pairs, on suffixes whose words are few and often equal."""
    r = random.Random(3)
    size, window, reach = 8, 4, 5
    for _ in range(40):
        n = r.randrange(1, 30)
        rows = sorted(([r.choice((1, 1, 1, 2)) for _ in range(size)], [r.choice((1, 1, 2)) for _ in range(window - 1)], r.randrange(20)) for _ in range(n))
        use = np.array([[r.random() < 0.7 for _ in range(window)] for _ in range(n)])
        right, left, rank = (np.array([x[k] for x in rows]) for k in range(3))
        got = S.compare(right, left, use, rank, reach)
        for i, (a, b, place) in enumerate(rows):
            for d in range(window):
                same = [p for j, (x, y, p) in enumerate(rows) if use[j, d] and x[: size - d] == a[: size - d] and y[:d] == b[:d]]
                assert got[0][i, d] == (use[i, d] and len(set(same)) > 1), (i, d)
                assert got[1][i, d] == (use[i, d] and place > min(same)), (i, d)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        S.repeated_passages(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_cutting(spark):
    a, b = " ".join(f"a{i}" for i in range(55)), " ".join(f"b{i}" for i in range(55))
    docs = [(1, f"Start {a}\n end", "x"), (2, f"{a}\nown  words\n{b}", "y"), (3, f" {b} tail ", "z"), (4, a, None), (5, None, "n"), (None, a, "keep")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, _cuts string")
    for sent in (10**6, 0):
        got = {r.doc_id: (r.text, r._cuts) for r in S.without_repeats(frame.withColumnRenamed("_cuts", "removed"), sent_documents=sent).withColumnRenamed("removed", "_cuts").collect()}
        assert got == {1: (f"Start {a}\n end", "x"), 2: (f"own  words\n{b}", "y"), 3: (" tail ", "z"), 4: ("", None), 5: (None, "n"), None: (a, "keep")}
    assert S.repeated_passages(frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from tallyweave.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op4_suffix_dedup"](spark, sf_dir)) == brute(docs, 50)
