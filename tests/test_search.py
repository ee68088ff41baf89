"""Many questions at once, against plain Python."""

import random

import numpy as np
import pytest

from tallyweave.engine import Engine
from tallyweave.operators import retrieval as R

CHUNKS = "doc_id long, text string"
ASKED = "question_id long, question string, query array<double>"


def words(text):
    import re

    return {w for w in re.findall(r"[^\W_]+", (text or "").lower()) if 2 <= len(w) <= 64}


def plainly(questions, chunks, vectors, edges, entities, k, named, about):
    """(question, source, doc, kept) by loops; named and about give a question's identifiers and names."""
    out = []
    chunks = [(i, t) for i, t in chunks if i is not None and t is not None]
    for q, question, query in questions:
        found = []
        for token in named.get(q, []):
            hits = sorted((i, t) for i, t in chunks if words(token) and words(token) <= words(t))
            found += [(0, 0.0, i, t) for i, t in hits[: max(3, k // 2)]]
        if query is not None and question and question.strip():
            a = np.array(query)
            near = sorted((-float(a @ v / np.linalg.norm(a) / np.linalg.norm(v)), i) for i, v in vectors if any(c == i for c, _ in chunks))[:k]
            found += [(1, round(s, 4), i, t) for s, i in near for c, t in chunks if c == i]
        names = {n.strip().lower() for n in about.get(q, [])}
        reached = {e for e, _, v in entities if v is not None and v.strip().lower() in names}
        for _ in range(2):
            reached |= {b for a, b in edges if a in reached} | {a for a, b in edges if b in reached}
        docs = {d for e, d, _ in entities if e in reached}
        found += [(2, 0.0, i, t) for i, t in chunks if i in docs]
        heads = set()
        for p, s, i, t in sorted(found):
            out.append((q, ("keyword", "vector", "graph")[p], i, t[:100] not in heads))
            heads.add(t[:100])
    return sorted(out)


def test_many_questions_by_brute_force(spark):
    r = random.Random(5)
    refs = [f"INV-2024-{n}" for n in range(30)]
    # long texts with one head are one hit; a document may have several chunks
    chunks = [(i, f"{r.choice(['invoice', 'note'])} {r.choice(refs)} of part {i % 9}" + " tail" * r.choice([0, 40]) + f" {i}") for i in range(120)] + [(7, "a second chunk of INV-2024-3"), (None, "INV-2024-3"), (200, None), (201, "")]
    vectors = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(0, 140, 3)]
    firms = ["Acme", "Borrow", "Cedar", "Delta"]
    entities = [(f"e{n}", n * 11, firms[n % 4] if n < 4 else f" other{n}") for n in range(12)] + [("e0", 5, "ACME "), ("x", 1, None)]
    edges = [(f"e{r.randrange(12)}", f"e{r.randrange(12)}") for _ in range(10)]
    named, about, asked = {}, {}, []
    for q in range(12):
        mine = r.sample(refs, q % 3)
        firm = r.choice(firms)
        asked.append((q, "reconcile " + firm + " with " + " and ".join(mine), [r.gauss(0, 1) for _ in range(4)] if q % 4 else None))
        named[q], about[q] = mine, [firm]
    frame = spark.createDataFrame([*asked, asked[1], (50, None, [1.0, 0.0, 0.0, 0.0]), (51, "", None), (None, "reconcile Acme", None)], ASKED)
    tables = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(entities, "entity_id string, doc_id long, value string")
    found = R.search_many(frame, tables[0], 6, *tables[1:])
    got = sorted((x.question_id, x.source, x.doc_id, x.kept) for x in found.collect())
    assert got == plainly(asked, chunks, vectors, edges, entities, 6, named, about)
    told = {x.question_id: x for x in R.search_summaries(frame, found).collect()}
    assert set(told) == {*range(12), 50, 51}
    for q in told:
        mine = [x for x in got if x[0] == q]
        assert [told[q].keyword_count, told[q].vector_count, told[q].graph_count, told[q].total] == [*(sum(x[1] == s for x in mine) for s in ("keyword", "vector", "graph")), sum(x[3] for x in mine)]
        assert told[q].route == ("graph" if told[q].graph_count else "vector") and told[q].id_tokens == named.get(q, [])


@pytest.mark.parametrize("empty", ["questions", "chunks"])
def test_nothing_to_search(spark, empty):
    questions = spark.createDataFrame([(1, "where is INV-2024-1", [1.0])] if empty != "questions" else [], ASKED)
    chunks = spark.createDataFrame([(1, "INV-2024-1")] if empty != "chunks" else [], CHUNKS)
    kept, told = Engine(spark).search_many(questions, chunks, vectors=spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"))
    assert kept.count() == 0
    assert [(x.route, x.total) for x in told.collect()] == ([] if empty == "questions" else [("vector", 0)])


def test_a_common_word_brings_no_candidates(spark):
    """Of an identifier's words the rarest one is looked up: a word of all chunks is only tested in the row."""
    chunks = spark.createDataFrame([(i, f"INV-2024-{i}") for i in range(500)], CHUNKS)
    asked = spark.createDataFrame([(i, [f"INV-2024-{i}"]) for i in range(20, 30)], "question_id long, named array<string>")
    found = R.named_hits(asked, chunks, 3)
    assert sorted((x.question_id, x.doc_id) for x in found.collect()) == [(i, i) for i in range(20, 30)]
