"""Every operator on one odd table: null ids and texts, empty and very long texts, repeated rows, and columns of clashing names."""

import re

import pytest

from tallyweave.llm import decontamination, jaccard, languages, lengths, licenses, packing, quality, shared, suffixes, toxicity

LONG = " ".join(f"word{i % 1009} number{i}" for i in range(80_000)) + " released under the mit license"
ROWS = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, " \n\t"), (None, "a b c d e"), (None, None), (5, LONG), (6, LONG), (7, "!" * 1_200_000), (8, "x" * 1_200_000)]
CLASH = "_id _cuts _removed cuts found norm base kept key k1 n cluster block token bucket length rank deal start doc at item words label score langs gram n_words lang_pred toxic unlabelled features".split()


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "CASE WHEN doc_id IS NULL THEN NULL ELSE 'en' END AS lang", *(f"'{c}' AS {c}" for c in CLASH))
    return frame.repartition(3)


def one_row_each(frame, text_of, nothing):
    """One row for each of ROWS; texts that come to nothing give what is stated for them."""
    rows = frame.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in ROWS), key=str)
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert text_of(r) == nothing, r


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "number5 word6 number6"), (2, None), (None, "a b c"), (3, "a b c d e"), (3, "a b c d e")], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as block", "3 as item")
    for block in (decontamination.BLOCK_CHARS, 8):
        one_row_each(decontamination.digest(decontamination.scan(odd, items, 3, block)), lambda r: (r.n_words, r.n_hit, r.n_items, r.contaminated), (0, 0, 0, False))
    rows = {r.doc_id: r for r in decontamination.scan(odd, items, 3).collect()}
    assert (rows[5].n_hit, rows[5].items, rows[1].n_hit, rows[8].n_words) == (3, ["1"], 5, 1)
    assert decontamination.scan(odd.limit(0), items).count() == 0 and {r.n_hit for r in decontamination.scan(odd, items.limit(0)).collect()} == {0}


def test_jaccard(odd):
    one_row_each(jaccard.jaccard_components(odd, 3, 90), lambda r: (r.n_shingles, r.component_id == r.doc_id), (0, True))
    rows = [tuple(r) for r in jaccard.jaccard_components(odd, 3, 90).collect()]
    assert rows.count((1, 3, 1)) == 2 and (None, 3, 1) in rows and (None, 0, None) in rows
    assert {(r[0], r[2]) for r in rows if r[0] in (5, 6, 7, 8)} == {(5, 5), (6, 5), (7, 7), (8, 8)}


def test_licenses(odd):
    one_row_each(licenses.scan(odd), lambda r: (r.n_words, r.n_base, r.first_word, r.labels, r.score), (0, 0, None, "", 0.0))
    rows = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert (rows[5].labels, rows[5].first_word, rows[5].n_words) == ("mit", 160_001, 160_005) and rows[7].n_words == 0 and rows[8].n_words == 1
    assert licenses.scan(odd.limit(0)).count() == 0


def test_suffixes(odd):
    got = {r.doc_id: r for r in suffixes.repeated_passages(odd).collect()}
    assert set(got) == {5, 6} and [tuple(x) for x in got[6].removed] == [(0, 160_005)] and got[5].removed == []
    assert suffixes.repeated_passages(odd.limit(0)).count() == 0
    cut = suffixes.without_repeats(odd)
    assert cut.columns == odd.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[5] == LONG and texts[6] == "" and texts[2] is None and texts[7] == "!" * 1_200_000


def test_quality(odd):
    one_row_each(quality.assess(odd), lambda r: (r.n_words, r.word_chars, r.base_failed, r.kept), (0, 0, True, False))
    rows = {r.doc_id: r for r in quality.assess(odd).collect()}
    assert rows[5].n_words == 160_005 and rows[7].word_chars == 1_200_000 and rows[5].kept
    assert quality.assess(odd.limit(0)).count() == 0


def test_languages(odd):
    filters = languages.learn(odd)
    one_row_each(languages.identify(odd, filters), lambda r: (r.lang_pred, r.score), ("und", 0.0))
    rows = {r.doc_id: r.lang_pred for r in languages.identify(odd, filters).collect()}
    assert rows[5] == "en" and rows[7] == "und"
    assert languages.identify(odd.limit(0), filters).count() == 0


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 0), (None, 1), (99, 1), (4, None)], "doc_id long, toxic int").selectExpr("*", "1 as text", "2 as _id")
    model = toxicity.learn(odd, labels)
    bias = {round(r.score, 9) for r in toxicity.score(odd, model).where("doc_id in (2, 3, 4)").collect()}
    one_row_each(toxicity.score(odd, model), lambda r: round(r.score, 9) in bias, True)
    assert len(bias) == 1 and toxicity.score(odd.limit(0), model).count() == 0


def test_packing(odd):
    rows = packing.pack(odd).collect()
    assert sorted((r.doc_id for r in rows if r.start == 0), key=str) == sorted((i for i, _ in ROWS), key=str)
    assert {(r.length, r.doc_tokens) for r in rows if r.doc_id in (2, 3)} == {(1, 1)} and max(r.length for r in rows) == 1024
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 1024
    assert sorted(held) == list(range(len(held))) and packing.pack(odd.limit(0)).count() == 0


def test_lengths(odd):
    rows = lengths.suffix_sums(lengths.length_counts(odd)).orderBy("n_tokens").collect()
    assert (rows[0].n_tokens, rows[0].n_docs, rows[0].docs_from) == (0, 3, len(ROWS)) and rows[-1].n_docs in (1, 2) and rows[-1].n_tokens > 100_000
    assert lengths.suffix_sums(lengths.length_counts(odd.limit(0))).count() == 0


def test_folder_of_a_cluster_must_be_named(spark, monkeypatch):
    class Context:
        master = "spark://h:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda name, other=None: other)

    with pytest.raises(RuntimeError, match=re.escape("spark.checkpoint.dir")):
        shared.shared_folder(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared.shared_folder(Session)
