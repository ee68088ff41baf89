import random
import re
from collections import Counter, defaultdict

import pytest

from tallyweave.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least=3, top=200):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = TERM.findall(lower(text or ""))
        groups.add((lang, source))
        count[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in seen[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        counts = {s: {w: count[lang, s][w] for w in kept} for s in sources}
        whole = {w: sum(counts[s][w] for s in sources) for w in kept}
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        ps, q = {s: p(counts[s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(ps[s][w], ps[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, f(ps[s][w], q[w])) for w in kept if counts[s][w] > 0 and ps[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def run(spark, docs, **more):
    frame = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS k", "4 AS words", "5 AS item", "6 AS zero").repartition(3)
    return sorted(tuple(r) for r in D.audit(frame, **more).collect())


def made(seed, n=150):
    r = random.Random(seed)
    words = ["The", "the", "größe", "ÉTÉ", "été", "x1y", "can't", "日本", "naïve", *(f"w{chr(97 + i)}" for i in range(20))]
    docs = []
    for _ in range(n):
        source = r.choice(["a", "a", "a", "b", "c", None, "Z"])
        own = words[:5] if source == "a" else words[5:]
        docs.append((r.choice([" ", "\n", ", ", "7", "\x7f"]).join(r.choices(words, k=r.choice([0, 1, 5, 40])) + r.choices(own, k=r.choice([0, 3]))), r.choice(["en", "de", None]), source))
    return docs + [(None, "en", "a"), ("", "fr", "only"), ("one two", "it", "p"), ("one two", "it", "q"), (None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed, monkeypatch):
    docs = made(seed)
    want = brute(docs)
    assert run(spark, docs) == want and {r[2] for r in want} == {"pair", "term"}
    monkeypatch.setattr(D, "CHUNK_BYTES", 50)
    assert run(spark, docs) == want


def test_few_terms_and_every_document_counts(spark):
    docs = made(4, 60)
    assert run(spark, docs, terms=2, least_docs=1) == brute(docs, 1, 2)
    assert run(spark, docs * 2) == brute(docs * 2)


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)]) == []
    assert run(spark, [("!", "en", "a"), ("", "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    long = " ".join(f"word{chr(97 + i % 26)}" for i in range(300_000))
    docs = [(long, "en", "a"), ("worda wordb " * 5, "en", "b"), ("worda", "en", "a"), ("worda wordz", "en", "b"), ("x" * 1_000_000, "en", "c")]
    assert run(spark, docs) == brute(docs)


def test_large_counts_stay_exact(spark):
    n, total, words = 3 * 10**12, 10**13, 10**6
    (row,) = spark.createDataFrame([(n, total, words)], "n long, t long, w long").select(D._p(*(D.F.col(c) for c in "ntw")).alias("p")).collect()
    assert row.p == 1 + 10**9 * (n + 1) // (total + words)
