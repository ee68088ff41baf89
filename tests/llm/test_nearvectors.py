import math
import random

import numpy as np
import pytest

from tallyweave.llm import nearvectors as N


def brute(rows, threshold):
    """rows of (id, vector, label): links by plain cosine, components by a walk."""
    good = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out, seen = [None] * len(rows), set()
    for a in range(len(rows)):
        if a not in seen:
            part, todo = {a}, [a]
            while todo:
                for b in links[todo.pop()] - part:
                    part.add(b)
                    todo.append(b)
            seen |= part
            least = min((rows[k][0] for k in part if rows[k][0] is not None), default=None)
            for k in part:
                out[k] = (rows[k][0], len(links[k]), least, rows[k][0] is not None and rows[k][0] == least)
    return sorted(out, key=str)


def run(spark, rows, threshold=N.THRESHOLD, kind="float", **more):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS id", "2 AS tile", "3 AS vector", "4 AS links", "5 AS component").repartition(3)
    return sorted((tuple(r) for r in N.near_links(frame, threshold, **more).collect()), key=str)


def made(seed, dim, n=120):
    """Families around a few directions, some just at the threshold, exact copies and other lengths of vectors."""
    r = np.random.default_rng(seed)
    heads = r.normal(size=(4, dim))
    rows = []
    for k in range(n):
        v = heads[k % 4] + r.normal(size=dim) * r.choice([0.02, 0.25, 0.4])
        rows.append((int(r.integers(0, 10**9)) - 5 * 10**8, (v * 10.0 ** r.integers(-3, 3)).astype(np.float32).tolist(), int(k % 3 > 0)))
    rows += [(10**9 + k, rows[0][1], rows[0][2]) for k in range(30)] + [(-(10**9), rows[1][1], None)]
    return rows


@pytest.mark.parametrize("dim, tile", [(8, 2048), (64, 16), (3, 7)])
def test_against_all_pairs(spark, dim, tile):
    rows = made(dim, dim)
    want = brute(rows, N.THRESHOLD)
    assert run(spark, rows, tile=tile) == want
    assert any(0 < r[1] < 40 for r in want) and any(r[1] >= 30 for r in want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1)]
    assert run(spark, rows) == sorted(((i, 0, i, True) for i, _, _ in rows), key=str)
    # repeated ids and rows, rows without id, -0.0, tiny and huge components
    rows += [(8, [2.0, 0.0], 1), (8, [1.0, 0.0], 1), (None, [3.0, -0.0], 1), (None, [0.0, 1e-40], 1), (11, [0.0, 1e38], 1), (None, [-1.0, 0.0], 1), (None, None, None)]
    assert run(spark, rows) == brute(rows, N.THRESHOLD)
    assert run(spark, [(1, [1e-300, 1e-301], 1), (2, [1e300, 1e299], 1)], kind="double") == [(1, 1, 1, True), (2, 1, 1, False)]
    assert run(spark, []) == []


def test_error_bound_holds_whatever_the_vectors():
    r = np.random.default_rng(4)
    for dim in (2, 64, 1500):
        v = r.normal(size=(60, dim)) ** 5 + (r.random((60, dim)) < 0.01) * 1e6
        u = N.unit(v)
        q, s, e = N.quantised(u)
        exact = q.astype(np.int64) @ q.astype(np.int64).T
        assert np.array_equal(N.products(q, q), exact)
        gap = np.abs(u @ u.T - exact * s[:, None] * s[None, :])
        assert (gap <= e[:, None] + e[None, :] + e[:, None] * e[None, :]).all()
        assert np.array_equal(N.linked((q, s, e, u), (q, s, e, u), 0.5), u @ u.T >= 0.5)


def test_few_pairs_are_computed_again(monkeypatch):
    r = np.random.default_rng(5)
    u = N.unit(r.normal(size=(400, 64)))
    a = (*N.quantised(u), u)
    again = []
    plain = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *x: (again.append(len(x[1])), plain(*x))[1])
    N.linked(a, a, 0.93)
    assert sum(again) == 400 or sum(again) == 0  # the rows themselves at most


def test_links_of_a_large_group_are_counted_not_listed(spark):
    rows = [(i, [1.0, random.Random(i).random() / 100], 1) for i in range(300)]
    assert {r[1:3] for r in run(spark, rows, tile=64)} == {(299, 0)}
