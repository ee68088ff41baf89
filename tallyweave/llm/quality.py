"""Quality rules: distribution divergence from language references.

Each document's character-class histogram and common-word histogram are compared
with references, one per language, by Jensen-Shannon distance. The references are
summed over all documents with a language that pass the base rules, every document
with the same weight, in integers: the result is the same however the rows are dealt.
Words are counted in hashed bins, of which each reference keeps its most frequent
ones and the mass of the rest, so that what reaches the driver has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.shared import drop_written, written
from tallyweave.llm.wordarrays import SPACED, SPACED_EXACT, Words, _ranges, _table, mix, word_chunks

WORD_BINS = 1 << 14
COMMON = 48
#: A document's weight in a reference, as integers, for classes and for words. A word's part of it is rounded down, to a loss of
#: at most n_words / WORD_UNIT of the weight; sums fit 64 bits up to 900,000,000 documents a language.
UNIT, WORD_UNIT = 1_000_000, 10_000_000_000
#: Documents that a language must have for a reference; those of other languages are judged by the base rules alone.
MIN_DOCS = 5
#: Guards: a histogram of fewer characters or words says too little.
MIN_CHARS, MIN_WORDS = 150, 50
#: Largest distances of kept documents, and what sampling may add: over sqrt(bytes) for classes, over sqrt(words) for words.
MAX_CLASS_JS, CLASS_ALLOWANCE = 0.14, 2.5
MAX_WORD_JS, WORD_ALLOWANCE = 0.22, 2.0
#: What a small reference may add to either, over the square root of its documents.
REFERENCE_ALLOWANCE = 0.25

_LINES = _table(~_ranges((10, 10)), fold=False)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: lower, upper, digit, space, end of line, separators, marks of sentences, exclamation, symbols, other ASCII, non-ASCII by length
_CLASS = np.full(256, 9, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10] = 0, 1, 2, 3, 4
_CLASS[[9, 11, 12, 13]] = 3
_CLASS[[ord(c) for c in ",;:-()'\"/"]] = 5
_CLASS[[ord(c) for c in ".?"]] = 6
_CLASS[ord("!")] = 7
_CLASS[_SYMBOLS] = 8
_CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 0, 10, 11
_CLASS[0x80:0xC0] = -1
CLASSES = 12


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, value): whether it occurs twice or more, and whether it has occurred before."""
    key = mix(value + owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


def base_measures(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each document."""
    data, offsets, n = w.data, w.offsets, len(w.rows)
    counts = w.counts
    in_word = SPACED_EXACT[0][data]
    out = {"n_words": counts.astype(np.int64), "word_chars": _per_document(in_word & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_document(_SYMBOLS[data], offsets)}
    lines = Words(data, offsets, w.rows, _LINES)
    worded = np.searchsorted(w.first, lines.last) > np.searchsorted(w.first, lines.first)
    owner = lines.owners()[worded]
    _, again = _repeats(owner, lines.value[worded])
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)
    at, value = w.windows(3)
    owner = np.searchsorted(w.bounds, at, side="right") - 1
    twice, _ = _repeats(owner, value)
    marked = np.zeros(len(w.value) + 1, bool)
    for k in range(3):
        marked[at[twice] + k] = True
    out["n_repeat_words"] = _per_document(marked[:-1], w.bounds)
    out["base_failed"] = (counts < 50) | (100 * out["n_repeat_words"] > 50 * counts)
    return out


def _class_histogram(w: Words) -> np.ndarray:
    cls = _CLASS[w.data]
    owner = np.repeat(np.arange(len(w.rows)), np.diff(w.offsets))
    keep = cls >= 0
    return np.bincount(owner[keep] * CLASSES + cls[keep], minlength=len(w.rows) * CLASSES).reshape(-1, CLASSES)


def _bins(column: pa.Array, w: Words) -> np.ndarray:
    """The hashed bin of each word, A-Z lower-cased."""
    folded = Words(w.data, w.offsets, w.rows, SPACED)
    return (folded.value % np.uint64(WORD_BINS)).astype(np.int64)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of p to q; 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def references(docs: DataFrame) -> list[dict]:
    """One for each language: lang, docs, classes (shares), bins and shares of common words."""
    sums = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text")).where("lang is not null and text is not null").mapInArrow(_count, "lang string, bin int, total long, docs long")
    sums = written(sums.groupBy("lang", "bin").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")))
    by_size = Window.partitionBy("lang", F.col("bin") < 0).orderBy(F.desc("total"), "bin")
    rows = sums.withColumn("rank", F.row_number().over(by_size)).where((F.col("bin") < 0) | (F.col("rank") <= COMMON))
    enough = sums.where("bin = -1").where(f"docs >= {MIN_DOCS}").select("lang")
    found: dict[str, dict] = {}
    kept = rows.join(enough, "lang").orderBy("lang", "rank").collect()
    drop_written(sums)
    for lang, bin_, total, n, _ in kept:
        ref = found.setdefault(lang, {"lang": lang, "docs": 0, "classes": np.zeros(CLASSES), "bins": [], "shares": []})
        if bin_ < 0:
            ref["classes"][-1 - bin_], ref["docs"] = total, max(ref["docs"], n)
        else:
            ref["bins"].append(bin_)
            ref["shares"].append(total)
    for ref in found.values():
        ref["classes"] = ref["classes"] / max(1.0, ref["classes"].sum())
        order = np.argsort(ref["bins"])
        ref["bins"] = np.array(ref["bins"], np.int64)[order]
        ref["shares"] = np.array(ref["shares"], float)[order] / (ref["docs"] * WORD_UNIT)
    return [found[x] for x in sorted(found)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for w in word_chunks(batch.column("text"), SPACED_EXACT):
            fine = ~base_measures(w)["base_failed"]
            chunk = langs[w.rows]
            classes, bins, owners, counts = _class_histogram(w), _bins(batch.column("text"), w), w.owners(), w.counts
            scaled = classes * UNIT // np.maximum(1, classes.sum(1, keepdims=True))
            for lang in set(chunk[fine]):
                mine = fine & (chunk == lang)
                total = sums.setdefault(lang, [np.zeros(CLASSES, np.int64), np.zeros(WORD_BINS, np.int64), np.zeros(1, np.int64)])
                total[0] += scaled[mine].sum(0)
                weight = (WORD_UNIT // np.maximum(1, counts)) * mine
                mine_words = mine[owners]
                total[1] += np.bincount(bins[mine_words], weight[owners[mine_words]].astype(float), WORD_BINS).astype(np.int64)
                total[2] += mine.sum()
    for lang, (classes, words, n) in sums.items():
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (CLASSES + len(used)), pa.string()),
                pa.array(np.concatenate((-1 - np.arange(CLASSES), used)).astype(np.int32)),
                pa.array(np.concatenate((classes, words[used]))),
                pa.array(np.full(CLASSES + len(used), n[0])),
            ],
            ["lang", "bin", "total", "docs"],
        )


def distances(w: Words, column: pa.Array, refs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Each document's class distance and word distance to the reference that it is
    closest to by their sum, less what the size of that reference may add."""
    n = len(w.rows)
    best = [np.full(n, np.inf), np.zeros(n), np.zeros(n)]
    classes = _class_histogram(w)
    classes = classes / np.maximum(1, classes.sum(1, keepdims=True))
    bins, owners, counts = _bins(column, w), w.owners(), np.maximum(1, w.counts)
    for ref in refs:
        place = np.full(WORD_BINS, len(ref["bins"]), np.int64)
        place[ref["bins"]] = np.arange(len(ref["bins"]))
        k = len(ref["bins"]) + 1
        shares = np.bincount(owners * k + place[bins], minlength=n * k).reshape(n, k) / counts[:, None]
        d_class = js_distance(classes, ref["classes"][None, :])
        d_word = js_distance(shares, np.append(ref["shares"], max(0.0, 1 - ref["shares"].sum()))[None, :])
        d_class, d_word = (np.maximum(0, d - REFERENCE_ALLOWANCE / np.sqrt(ref["docs"])) for d in (d_class, d_word))
        closer = d_class + d_word < best[0]
        for have, new in zip(best, (d_class + d_word, d_class, d_word), strict=True):
            have[closer] = new[closer]
    return best[1], best[2]


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_js double, word_js double, kept boolean"


def assess(docs: DataFrame, refs: list[dict] | None = None) -> DataFrame:
    """Base measures, distances and verdict of each row of docs, which needs doc_id, text and lang.

    refs: from references(docs) where not given. Null and empty texts have no words:
    base_failed, not kept. Documents below the guards are judged by the base rules
    alone, and so are those whose language has no reference or is null: their distances
    are to the closest reference of another language, and count for nothing. Other columns are not read; repeated rows give repeated rows.
    """
    refs = references(docs) if refs is None else refs
    sent = docs.sparkSession.sparkContext.broadcast((refs, {r["lang"] for r in refs}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, known = sent.value
        for batch in batches:
            own = np.array([x in known for x in batch.column("lang").to_pylist()], bool)
            for w in word_chunks(batch.column("text"), SPACED_EXACT):
                m = base_measures(w)
                d_class, d_word = distances(w, batch.column("text"), refs)
                chars = np.diff(w.offsets)
                strange = (chars >= MIN_CHARS) & (d_class > MAX_CLASS_JS + CLASS_ALLOWANCE / np.sqrt(np.maximum(1, chars)))
                strange |= (m["n_words"] >= MIN_WORDS) & (d_word > MAX_WORD_JS + WORD_ALLOWANCE / np.sqrt(np.maximum(1, m["n_words"])))
                m |= {"class_js": d_class, "word_js": d_word, "kept": ~m["base_failed"] & ~(strange & own[w.rows])}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.rows[0], len(w.rows)), *(pa.array(x) for x in m.values())], ["doc_id", *m])

    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")
