import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import toxicity as X
from tallyweave.llm.chargrams import Letters
from tests.llm.test_languages import brute_grams


def test_nnpu_on_a_known_mixture():
    r = np.random.default_rng(4)
    n, prior = 3000, 0.3
    truth = r.random(n) < prior
    dense = r.random((n, 12)) < np.where(truth[:, None], 0.6, 0.1) * (np.arange(12) < 6) + 0.3 * (np.arange(12) >= 6)
    positive = truth & (r.random(n) < 0.5)  # half of the positive ones are confirmed
    rows, columns = np.nonzero(dense)
    weights, bias = X.fit_nnpu(rows, columns, n, 12, positive, prior)
    z = dense @ weights + bias
    assert np.mean((z > 0) == truth) > 0.93
    assert weights[:6].min() > weights[6:].max()


def brute_fit(matrix, positive, unlabelled, prior, epochs, rate=0.05, decay=1e-4):
    """The same estimator in plain Python, a loss and a slope at a time; also how often the negative risk was below 0."""
    n, m = len(matrix), len(matrix[0])
    w, b = [0.0] * m, math.log(prior / (1 - prior))
    first, second, below = [0.0] * (m + 1), [0.0] * (m + 1), 0
    n_p, n_u = sum(positive), sum(unlabelled)
    for step in range(1, epochs + 1):
        z = [sum(x * y for x, y in zip(row, w)) + b for row in matrix]
        s = [1 / (1 + math.exp(-max(-30, min(30, v)))) for v in z]
        loss = [max(0, v) + math.log1p(math.exp(-abs(v))) for v in z]
        risk = sum(x for x, u in zip(loss, unlabelled) if u) / n_u - prior * sum(x for x, p in zip(loss, positive) if p) / n_p
        slope = []
        for i in range(n):
            of_u, of_p = unlabelled[i] / n_u, prior * positive[i] / n_p
            slope.append(of_p * (s[i] - 1) + of_u * s[i] - of_p * s[i] if risk >= 0 else of_p * s[i] - of_u * s[i])
        below += risk < 0
        grad = [sum(slope[i] * matrix[i][j] for i in range(n)) + decay * w[j] for j in range(m)] + [sum(slope)]
        for j, g in enumerate(grad):
            first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g * g
            change = rate * (first[j] / (1 - 0.9**step)) / (math.sqrt(second[j] / (1 - 0.999**step)) + 1e-9)
            if j < m:
                w[j] -= change
            else:
                b -= change
    return w, b, below


@pytest.mark.parametrize("prior", [0.2, 0.6])
def test_fit_matches_brute_force(prior):
    r = np.random.default_rng(8)
    dense = (r.random((24, 5)) < 0.4).astype(int)
    positive, unlabelled = np.arange(24) < 8, np.arange(24) >= 4
    dense[positive, 0] = 1
    rows, columns = np.nonzero(dense)
    weights, bias = X.fit_nnpu(rows, columns, 24, 5, positive, prior, epochs=150, unlabelled=unlabelled)
    w, b, below = brute_fit(dense.tolist(), positive.tolist(), unlabelled.tolist(), prior, 150)
    assert np.allclose(weights, w, atol=1e-6) and abs(bias - b) < 1e-6
    assert (below > 0) == (prior == 0.6)  # the correction has been at work


def test_scores_match_brute_force():
    """Features are words and n-grams, by how often they occur; a score is the sigmoid of their weights' sum."""
    texts = ["Some words, some WORDS some", "", "x", "a longer text with longer words in a longer text", "é" * 9, "12 !"]
    part = Letters(texts, np.arange(len(texts)))
    owner, value = X.features(part)
    for i, t in enumerate(texts):
        words = [g[1:-1] for n in range(3, 60) for g in brute_grams(t, n) if g[0] == g[-1] == " "]
        counts = Counter(("word", x) for x in words) + Counter((n, g) for n in X.GRAMS for g in brute_grams(t, n))
        assert (owner == i).sum() == sum(n >= level for n in counts.values() for level in X.LEVELS)
    chosen = np.unique(value)[::2]
    model = X.Model(chosen, np.linspace(-1, 1, len(chosen)), 0.25)
    place = {int(c): w for c, w in zip(chosen, model.weights, strict=True)}
    for i, s in enumerate(model.scores(part)):
        z = 0.25 + sum(place.get(int(v), 0.0) for v in value[owner == i])
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-9


def test_held_out(spark, sf_dir):
    from tallyweave.llm.queries import QUERIES

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op7_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    pos, neg = [np.array([s for s, t in held if t == k]) for k in (1, 0)]
    auc = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert auc > 0.85


def test_odd_rows(spark):
    docs = [(i, f"plain words here number {i} " + ("nastyword badterm" if i % 3 == 0 else "kind terms")) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "nastyword badterm"), (102, "nastyword badterm"), (102, "nastyword badterm"), (103, "x " * 300000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as score")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(60)] + [(1, 0, None), (0, 1, 1), (None, 1, 1), (100, 0, 0)], "doc_id long, quality int, toxic int")
    model = X.learn(frame, labels)
    got = X.score(frame, model).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r.predicted for r in got}
    assert by[102] == 1 and by[None] == 1 and by[100] == by[101] == by[103] == 0 and by[1] == 0 and by[0] == 1
    nothing = X.learn(frame, labels.where("toxic = 0"))
    assert {r.predicted for r in X.score(frame, nothing).collect()} == {0}
    assert X.score(frame.limit(0), model).count() == 0


def test_documents_without_labels_are_learned_from(spark, monkeypatch):
    docs = [(i, f"plain words here number {i} " + ("nastyword badterm" if i % 5 == 0 else "kind terms")) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600, 6)], "doc_id long, toxic int")
    fitted, fit = [], X.fit_nnpu
    monkeypatch.setattr(X, "fit_nnpu", lambda *a, **k: fitted.append((a, k)) or fit(*a, **k))
    model = X.learn(frame, labels)
    (_, _, n_rows, _, positive, prior), given = fitted[0]
    assert n_rows == 600 and given["unlabelled"].sum() == 600 and positive.sum() == 20
    assert abs(prior - 0.2) < 1e-9  # of the labelled ids, not 20 / 600
    got = {r.doc_id: r.predicted for r in X.score(frame, model).collect()}
    assert all(got[i] == int(i % 5 == 0) for i in got)
    X.learn(frame, labels, max_rows=100)
    assert 60 < fitted[1][1]["unlabelled"].sum() < 140 and fitted[1][0][4].sum() == 20
    X.learn(frame, labels, prior=0.3)
    assert fitted[2][0][5] == 0.3


def test_ids_of_any_type(spark):
    docs = [(f"d{i}", "bad awful words" if i % 3 == 0 else "calm quiet words of a walk") for i in range(60)]
    labels = [(f"d{i}", int(i % 3 == 0)) for i in range(0, 60, 2)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    model = X.learn(frame(docs, "doc_id string, text string"), frame(labels, "doc_id string, toxic int"))
    scores = {r.doc_id: r.score for r in X.score(frame(docs, "doc_id string, text string"), model).collect()}
    assert min(scores[f"d{i}"] for i in range(0, 60, 3)) > max(scores[f"d{i}"] for i in range(60) if i % 3)
