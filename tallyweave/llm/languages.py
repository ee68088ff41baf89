"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter of its frequent letter 4-grams. The filters are bit-sliced:
a slot holds one bit for each language, so that a lookup returns all languages that contain
an n-gram as the conjunction of a few slots. A document's score for a language is
the share of its n-grams found there, corrected for the filter's false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.chargrams import Letters, letter_chunks
from tallyweave.llm.shared import drop_written, written
from tallyweave.llm.wordarrays import mix

#: Least share of a language's n-grams that one in its filter has: at most 1 / LEAST_SHARE of them.
LEAST_SHARE = 5e-5
#: Least share that it has of its rate in the language where it is most frequent; keeps stray texts of other languages out.
LEAST_RATIO = 0.05
HASHES = 3
#: Slots for each n-gram of the largest language.
SLOTS = 16
#: n-grams that a task counts before it sends its counts on.
HELD = 2_000_000


class Filters:
    """Bit-sliced Bloom filters: slots[i] holds a bit for each language, 64 in a word."""

    def __init__(self, grams: dict[str, np.ndarray], docs: dict[str, int]) -> None:
        self.langs = sorted(grams, key=lambda x: (-docs.get(x, 0), x))
        largest = max((len(x) for x in grams.values()), default=1)
        self.size = 1 << max(10, int(SLOTS * largest - 1).bit_length())
        self.slots = np.zeros((self.size, max(1, -(-len(self.langs) // 64))), np.uint64)
        for i, lang in enumerate(self.langs):
            for at in self._places(grams[lang]):
                self.slots[at, i // 64] |= np.uint64(1 << i % 64)
        filled = np.array([np.count_nonzero(self.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.langs))]) / self.size
        self.false = filled**HASHES

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        second = mix(grams ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        for k in range(HASHES):
            yield ((grams + np.uint64(k) * second) % np.uint64(self.size)).astype(np.int64)

    def languages_of(self, grams: np.ndarray) -> np.ndarray:
        """The bits of all languages that contain each n-gram, or seem to."""
        out = None
        for at in self._places(grams):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def scores(self, part: Letters) -> np.ndarray:
        """(documents, languages): shares found, corrected for false positives."""
        owner, grams = part.grams(4)
        short_owner, short = _one_letter_words(part)
        owner, grams = np.concatenate((owner, short_owner)), np.concatenate((grams, short))
        n = np.bincount(owner, minlength=len(part.rows))
        bits = self.languages_of(grams)
        out = np.zeros((len(part.rows), len(self.langs)))
        for i in range(len(self.langs)):
            hit = (bits[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
            out[:, i] = np.bincount(owner[hit], minlength=len(part.rows))
        share = out / np.maximum(1, n)[:, None]
        return np.clip((share - self.false) / np.maximum(1e-9, 1 - self.false), 0, 1)


def _one_letter_words(part: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Words of one letter between blanks are too short for a 4-gram, and count as themselves."""
    owner, grams = part.grams(3)
    blank = part.codes == 0
    size = len(part.codes) - 2
    if size <= 0:
        return owner, grams
    ok = (part.owner[:size] == part.owner[2:]) & ~blank[1 : 1 + size]
    both = (blank[:size] & blank[2:])[ok]
    return owner[both], grams[both]


def learn(training: DataFrame) -> Filters:
    """Filters from text and lang of training; rows without either are left out. Counts cover all rows;
    what reaches the driver is bounded by 1 / LEAST_SHARE n-grams a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (grams, counts, docs) in held.items():
                value, back = np.unique(np.concatenate(grams), return_inverse=True)
                total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(value) + 1), pa.string()), pa.array(np.r_[value.view(np.int64), 0]), pa.array(np.r_[total, 0]), pa.array(np.r_[np.zeros(len(value), np.int64), docs])], ["lang", "gram", "n", "docs"]
                )
            held.clear()

        n_held = 0
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                for part in letter_chunks(batch.column("text"), np.flatnonzero(langs == lang)):
                    grams = np.concatenate((part.grams(4)[1], _one_letter_words(part)[1]))
                    value, count = np.unique(grams, return_counts=True)
                    mine = held.setdefault(lang, [[], [], 0])
                    mine[0].append(value)
                    mine[1].append(count)
                    mine[2] += len(part.rows)
                    n_held += len(value)
                    if n_held > HELD:
                        yield from flush()
                        n_held = 0
        yield from flush()

    rows = training.select(F.col("text").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(run, "lang string, gram long, n long, docs long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("docs").alias("of"))
    rates = counts.where("n > 0").join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).where(f"rate >= {LEAST_SHARE}")
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    chosen = rates.join(best, "gram").where(f"rate >= {LEAST_RATIO} * best").select("lang", "gram").toArrow()
    langs, grams = chosen.column(0).to_numpy(), chosen.column(1).to_numpy().view(np.uint64)
    docs = {r.lang: r.of for r in totals.collect()}
    drop_written(counts)
    return Filters({lang: np.sort(grams[langs == lang]) for lang in docs}, docs)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of each row; docs needs doc_id and text.

    lang_pred is und, with score 0, if the text is null or has no letter, or nothing was learned.
    Of equal scores the language with more documents wins, then the first by name. score: its part of
    the sum of all languages' scores. Other columns are not read; repeated rows give repeated rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in letter_chunks(batch.column("text")):
                f = sent.value
                if f.langs:
                    scores = f.scores(part)
                    best, sums = scores.argmax(1), scores.sum(1)
                    known = part.n_letters > 0
                    langs = [f.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
                    score = np.where(known & (sums > 0), scores.max(1) / np.maximum(1e-12, sums), 0.0)
                else:
                    langs, score = ["und"] * len(part.rows), np.zeros(len(part.rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.rows[0], len(part.rows)), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
