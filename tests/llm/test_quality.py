import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)


def char_class(c):
    """The class of a character, by its place in the list at the head of the module."""
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f\r", "\n", ",;:-()'\"/", ".?", "!", "#*$%&|<>"]
    found = [i for i, g in enumerate(groups) if c in g]
    return found[0] if found else {1: 9, 2: 0, 3: 10, 4: 11}[len(c.encode())]


def bin_of(word, known={}):  # noqa: B006  a cache
    """The hash is the operator's own; all else is done again here."""
    if word not in known:
        (w,) = Q.word_chunks(pa.array([word]), Q.SPACED_EXACT)
        known[word] = int(Q._bins(pa.array([word]), w)[0])
    return known[word]


def histograms(text):
    classes = Counter(map(char_class, text))
    return classes, Counter(bin_of(w) for w in WORD.findall(text))


def js(p, q):
    keys = {*p, *q}
    half = lambda a, b: sum(a[k] * math.log2(a[k] / ((a.get(k, 0) + b.get(k, 0)) / 2)) for k in keys if a.get(k, 0) > 0)
    return math.sqrt(min(1, max(0, (half(p, q) + half(q, p)) / 2)))


def brute_verdicts(docs):
    """{place: (class distance, word distance, kept)} of (doc_id, text, lang), in plain Python."""
    base = [brute(t) for _, t, _ in docs]
    made = [histograms(t or "") for _, t, _ in docs]
    refs = []
    for lang in sorted({x for _, _, x in docs if x is not None}):
        mine = [i for i, d in enumerate(docs) if d[2] == lang and d[1] is not None and not base[i][5]]
        if len(mine) < Q.MIN_DOCS:
            continue
        classes, words = Counter(), Counter()
        for i in mine:
            for k, n in made[i][0].items():
                classes[k] += n * Q.UNIT // made[i][0].total()
            for k, n in made[i][1].items():
                words[k] += n * (Q.WORD_UNIT // base[i][0])
        common = sorted(words, key=lambda k: (-words[k], k))[: Q.COMMON]
        shares = {k: words[k] / (len(mine) * Q.WORD_UNIT) for k in common}
        refs.append((lang, len(mine), {k: n / classes.total() for k, n in classes.items()}, shares, max(0.0, 1 - sum(shares.values()))))
    out = {}
    for i, (_, text, lang) in enumerate(docs):
        classes, words = made[i]
        best = (math.inf, 0.0, 0.0)
        for _, n, of_classes, shares, rest in refs:
            own = {k: words[k] / max(1, base[i][0]) for k in shares} | {-1: sum(m for k, m in words.items() if k not in shares) / max(1, base[i][0])}
            d = [max(0, x - Q.REFERENCE_ALLOWANCE / math.sqrt(n)) for x in (js({k: m / max(1, classes.total()) for k, m in classes.items()}, of_classes), js(own, shares | {-1: rest}))]
            if sum(d) < best[0]:
                best = (sum(d), *d)
        size = len((text or "").encode())
        strange = size >= Q.MIN_CHARS and best[1] > Q.MAX_CLASS_JS + Q.CLASS_ALLOWANCE / math.sqrt(size)
        strange |= base[i][0] >= Q.MIN_WORDS and best[2] > Q.MAX_WORD_JS + Q.WORD_ALLOWANCE / math.sqrt(base[i][0])
        out[i] = (best[1], best[2], not base[i][5] and not (strange and lang in {r[0] for r in refs}))
    return out


def test_verdicts_match_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    docs += [(10**6 + i, "#$% 77 <> || " * 30 + " ".join(f"{i}x{k}" for k in range(70)), "en") for i in range(3)] + [(10**7, None, "en"), (10**7 + 1, "", "de"), (10**7 + 2, "Ünï " * 60, None)]
    frame = spark.createDataFrame([(i, t, x) for i, (_, t, x) in enumerate(docs)], "doc_id long, text string, lang string")
    want = brute_verdicts(docs)
    rows = Q.assess(frame).collect()
    assert len(rows) == len(docs) and not all(r.kept or r.base_failed for r in rows)
    for r in rows:
        assert r.kept == want[r.doc_id][2], r
        if docs[r.doc_id][1]:
            assert (r.class_js, r.word_js) == pytest.approx(want[r.doc_id][:2], abs=1e-6)


def test_base_measures_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, None, None), (-2, "", "en"), (None, "  \n\t\n", "en"), (-3, "a b c a b c a b c\n\n x\n x\nx\x0b\x1cx y z \U0001f600#*", None), (-3, "dup " * 70000, "xx")], "doc_id long, text string, lang string"
    )
    rows = docs.select("doc_id", "text", "lang").union(odd)
    got = Q.assess(rows.selectExpr("*", "1 as kept", "2 as n_words")).collect()
    want = sorted((tuple([r.doc_id]) + brute(r.text) for r in rows.collect()), key=str)
    assert sorted((tuple(r)[:7] for r in got), key=str) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_divergence_tells_junk_from_prose(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = Q.assess(rows).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    good = [r.kept for r in got if r.quality == 1]
    junk = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(junk) < 0.2


def test_query_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = {tuple(r) for r in Q.assess(docs).collect()}
    b = {tuple(r) for r in Q.assess(docs.repartition(7)).collect()}
    assert a == b


def test_js_distance():
    assert abs(Q.js_distance(np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]]))[0] - 1) < 1e-12
    assert Q.js_distance(np.array([[0.5, 0.5]]), np.array([[0.5, 0.5]]))[0] == 0


def test_no_documents_and_no_references(spark):
    docs = spark.createDataFrame([(1, "word " * 60, None)], "doc_id long, text string, lang string")
    assert Q.assess(docs.limit(0)).count() == 0
    assert Q.assess(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), None)], docs.schema)).first().kept


def prose(lang, n, r):
    """n words of a language of 300 words."""
    return " ".join(f"{lang}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in r.zipf(1.3, n) % 300)


def test_rare_languages_are_not_judged_by_others(spark):
    r = np.random.default_rng(5)
    docs = [(i, prose("ab", 400, r), "en") for i in range(40)] + [(100 + i, prose("xy", 400, r), "xx" if i < 3 else None) for i in range(4)]
    docs += [(200, prose("xy", 400, r), "en"), (201, "xyx " * 400, "xx")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in Q.assess(frame).collect()}
    assert all(got[i].kept for i in (*range(40), 100, 101, 102, 103))
    assert got[100].word_js > 0.4 and not got[200].kept and not got[201].kept


def test_every_language_with_enough_documents_has_a_reference(spark):
    r = np.random.default_rng(6)
    docs = [(k * 5 + i, prose(f"q{k}", 60, r), f"l{k:03d}") for k in range(300) for i in range(5)]
    docs += [(2000 + i, prose("zz", 60, r), "few") for i in range(4)]
    refs = Q.references(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    fine = {lang for lang, n in Counter(d[2] for d in docs if not brute(d[1])[5]).items() if n >= 5}
    assert len(fine) > 256 and {x["lang"] for x in refs} == fine


def test_very_long_documents_have_the_same_weight(spark):
    for n in (600_000, 1_200_000):
        text = " ".join(f"{a}{b}{c}" for a, b, c in zip(*(np.array(list("abcdefgh"))[np.random.default_rng(7).integers(0, 8, (3, n))]), strict=True))
        text = " ".join(f"{w} {i}" for i, w in enumerate(text.split()[: n // 2]))  # numbers keep triples of words from repeating
        (ref,) = Q.references(spark.createDataFrame([(k, text, "en") for k in range(5)], "doc_id long, text string, lang string"))
        words = Counter(text.split())
        most = sum(sorted(words.values())[-Q.COMMON :]) / words.total()
        assert ref["docs"] == 5 and ref["shares"].sum() >= 0.99 * most
