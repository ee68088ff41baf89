import random
import zlib

import numpy as np

from tallyweave.llm import languages as L
from tallyweave.llm.chargrams import Letters


def brute_grams(text, n):
    words, now = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            now += c
        elif now:
            words.append(f" {now} ")
            now = ""
    return [w[i : i + n] for w in words for i in range(len(w) - n + 1)]


def test_grams_and_words():
    texts = ["", "Ab c, déf!", "1 2", "x", "ÉÀ ß\nİı z9z", "a" * 30]
    part = Letters(texts, np.arange(len(texts)))
    for n in (1, 2, 3, 4, 6):
        owner, value = part.grams(n)
        want = [(i, g) for i, t in enumerate(texts) for g in brute_grams(t, n) if n > 1 or g != " "]
        assert list(owner) == [i for i, _ in want]
        names = {}
        assert all(names.setdefault(g, v) == v for (_, g), v in zip(want, value, strict=True)) and len(set(names.values())) == len(names)
    owner, value = part.words()
    assert len(owner) == 11 and len(set(value)) == 10


def test_filters_have_no_false_negatives_and_know_their_false_positives():
    r = np.random.default_rng(3)
    grams = {f"l{i:03}": r.integers(0, 1 << 63, 500, dtype=np.uint64) for i in range(70)}
    f = L.Filters(grams, {})
    for i, lang in enumerate(f.langs):
        assert (f.languages_of(grams[lang])[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    other = f.languages_of(r.integers(0, 1 << 63, 200_000, dtype=np.uint64))
    rate = np.mean(other[:, 1] >> np.uint64(5) & np.uint64(1))
    assert abs(rate - f.false[69]) < 0.003


def test_held_out_accuracy(spark, sf_dir):
    from tallyweave.llm.queries import QUERIES

    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.9


def exact_shares(train, texts):
    """Each text's share of grams in each language's own set, with sets instead of filters."""
    grams = lambda t: brute_grams(t, 4) + [g for g in brute_grams(t, 3) if len(g) == 3 and g[0] == g[2] == " "]
    counts = {}
    for t, lang in train:
        for g in grams(t):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    best = {}
    for r in rates.values():
        for g, x in r.items():
            best[g] = max(best.get(g, 0), x if x >= L.LEAST_SHARE else 0)
    sets = {lang: {g for g, x in r.items() if x >= L.LEAST_SHARE and x >= L.LEAST_RATIO * best[g]} for lang, r in rates.items()}
    out = []
    for t in texts:
        own = grams(t or "")
        out.append({lang: sum(g in s for g in own) / max(1, len(own)) for lang, s in sets.items()})
    return out


def test_predictions_match_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    train = [(t, lang) for i, t, lang in docs if i % 3 and t and lang]
    filters = L.learn(spark.createDataFrame(train, "text string, lang string"))
    rows = {r.doc_id: r for r in L.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), filters).collect()}
    part = Letters([t or "" for _, t, _ in docs], np.arange(len(docs)))
    scores = filters.scores(part)
    clear = 0
    for k, ((i, t, _), want) in enumerate(zip(docs, exact_shares(train, [t for _, t, _ in docs]), strict=True)):
        assert all(abs(scores[k, filters.langs.index(lang)] - x) < 0.02 for lang, x in want.items())
        first, second = sorted(want.values(), reverse=True)[:2]
        if first - second > 0.04:
            clear += 1
            assert rows[i].lang_pred == max(want, key=want.get)
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert clear > 0.9 * len(docs)


def test_odd_rows(spark):
    r = random.Random(1)
    rows = [(i, " ".join("".join(r.choices(a, k=4)) for _ in range(30)), lang) for i, (lang, a) in enumerate([("xx", "abcd"), ("yy", "uvwé")] * 10)]
    train = spark.createDataFrame([*rows, (90, None, "xx"), (91, "abcd", None)], "doc_id long, text string, lang string").selectExpr("*", "1 as gram", "2 as score")
    f = L.learn(train)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "abcd bcda"), (5, "UVWÉ uvwé"), (5, "UVWÉ uvwé"), (6, "uvwé " * 400000)], "doc_id long, text string")
    got = sorted([(r.doc_id or 0, r.lang_pred) for r in L.identify(docs, f).collect()])
    assert got == [(0, "xx"), (1, "und"), (2, "und"), (3, "und"), (5, "yy"), (5, "yy"), (6, "yy")]
    nothing = L.learn(train.limit(0))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0), f).count() == 0
