import hashlib
import random
from itertools import combinations

import pytest

from tallyweave.llm import itemsets as I


def brute(rows, least, one_in, percent=60):
    """Supports of all itemsets that some basket has, by counting every subset; closed ones with their rules."""
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    total = len(baskets)
    least = max(least, -(-total // one_in)) if total else least
    items = {i for s in baskets.values() for i in s}
    alone = {i: sum(i in s for s in baskets.values()) for i in items}
    good = sorted(i for i in items if alone[i] >= least)
    support, front = {}, [()]
    while front:
        grown = []
        for p in front:
            for i in good:
                if not p or i > p[-1]:
                    q = p + (i,)
                    n = sum(set(q) <= s for s in baskets.values())
                    if n >= least:
                        support[q] = n
                        grown.append(q)
        front = grown
    closed = {q: n for q, n in support.items() if not any(support.get(tuple(sorted((*q, i)))) == n for i in good if i not in q)}
    out = []
    for q, n in closed.items():
        rules = []
        for c in q:
            rest = tuple(i for i in q if i != c)
            if rest and 100 * n >= percent * support[rest] and n * total > support[rest] * alone[c]:
                rules.append((c, support[rest], alone[c]))
        best = min(((a, c) for c, a, _ in rules), default=(None, None))[1]
        text = ";".join(f"{c}:{a}:{s}" for c, a, s in sorted(rules))
        out.append((",".join(map(str, q)), len(q), n, len(rules), best, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, least=I.LEAST, one_in=I.ONE_IN):
    frame = spark.createDataFrame(rows, "sale_id long, item_id long").selectExpr("*", "'x' AS b", "'y' AS i", "'z' AS c", "1 AS items", "2 AS support", "3 AS n").repartition(3)
    return sorted(tuple(r) for r in I.digest(*I.closed_itemsets(frame, least=least, one_in=one_in)).collect())


def made(seed, n=60, everywhere=False):
    """Baskets of a few items out of families that stand together, one very large basket, repeated and broken rows."""
    r = random.Random(seed)
    rows = []
    for b in range(n):
        family = r.choice([(1, 2, 3), (2, 3, 4, 9), (10, 7), (5,), (6, 11, 3)])
        for i in {*family, *r.sample(range(1, 13), r.choice([0, 1, 2]))} - ({r.choice(family)} if r.random() < 0.2 else set()):
            rows += [(b, i)] * r.choice([1, 1, 2])
        if everywhere:
            rows.append((b, 50))
    rows += [(1000, i) for i in range(1, 40)] + [(1001, i) for i in (1, 2, 3, 7, 10)]
    rows += [(1000, 50), (1001, 50)] if everywhere else []
    rows += [(None, 1), (3, None), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, everywhere", [(1, False), (2, True)])
def test_against_all_subsets(spark, seed, everywhere):
    rows = made(seed, everywhere=everywhere)
    want = brute(rows, 5, 20_000)
    assert run(spark, rows) == want and any(n > 2 for _, n, *_ in want) and any(k for *_, k, _, _ in want)


def test_share_of_all_baskets_and_large_baskets(spark):
    rows = made(3, 40)
    assert run(spark, rows, 3, 5) == brute(rows, 3, 5)  # 42 baskets: 9 at least, up to 4 large ones are set apart
    assert run(spark, rows, 2, 20_000) == brute(rows, 2, 20_000)


def test_identical_baskets_are_one_itemset(spark):
    rows = [(b, i) for b in range(6) for i in (-4, 7, 9, 20)]
    assert run(spark, rows) == brute(rows, 5, 20_000) and len(run(spark, rows)) == 1
    rows += [(9, i) for i in (7, 30)]
    assert [r[:3] for r in run(spark, rows)] == [("-4,7,9,20", 4, 6), ("7", 1, 7)]


def test_odd_tables(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1), (1, None)]) == []
    assert run(spark, [(b, 1) for b in range(4)]) == []
    assert [r[:4] for r in run(spark, [(b, 1) for b in range(5)] * 3)] == [("1", 1, 5, 0)]


def test_threshold_of_large_baskets(spark):
    pairs = spark.createDataFrame([(b, i) for b, n in ((1, 300), (2, 70), (3, 9), (4, 8), (5, 1)) for i in range(n)], "b long, i long")
    assert [I._large(pairs, k) for k in (0, 1, 2, 3, 4, 5)] == [512, 128, 16, 16, 2, 1]


def test_subsets_of_two(spark):
    """Every two items of a closed itemset stand together in at least as many baskets."""
    rows = made(5)
    got = run(spark, rows)
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    for items, _, n, *_ in got:
        for a, c in combinations(map(int, items.split(",")), 2):
            assert sum({a, c} <= s for s in baskets.values()) >= n
