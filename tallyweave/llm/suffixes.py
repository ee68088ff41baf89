"""Suffix-array dedup with a sparse suffix array.

1. Suffixes are kept only at minimisers: the least of WINDOW consecutive k-grams of words,
   the first of equals. Any passage of MIN_WORDS words holds one among its first
   WINDOW words, the same one wherever the passage stands, with REACH words to its right.
2. A count of the fingerprints of their first REACH words tells which suffixes may have an equal
   neighbour. It leaves suffixes out and nothing more: what is equal is told by words.
3. The others carry their words, MIN_WORDS to the right and WINDOW - 1 to the left. They are
   dealt by those fingerprints and sorted by their words; neighbours are compared word by word,
   so that for every length it is known which suffixes begin with the same words.
4. Each match is extended to the left, word by word, as far as the minimiser is the passage's
   own: a passage of MIN_WORDS words that begins d words before a suffix occurs again where the d
   words before and the MIN_WORDS - d words from there are equal.
   The union of equal passages is each maximal match.

The first occurrence, by doc_id and place, is kept; the words of the others are cut.
Where a suffix occurs often in one run of documents the same comparison is made there, and only
first places go on. A suffix that is frequent in the corpus is not dealt as a whole, but once for each passage
around it, by that passage: the ends of a frequent passage, where the words around differ, go to as many tasks as there are
words around. A long run of equal suffixes is compared in blocks, of which first places are carried on. So memory is bounded
whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import fresh, passing, written
from tallyweave.llm.wordarrays import SPACED, Words, mix, word_chunks

MIN_WORDS, WINDOW, GRAM = 50, 16, 5
#: Repeated suffixes that are sent to every executor (8 bytes each); beyond that they are joined by a shuffle.
SENT_KEYS = 4_000_000
#: Documents whose cuts are sent to every executor; beyond that the join is shuffled.
SENT_DOCUMENTS = 100_000
#: Occurrences of a suffix in one run of documents from which they are compared there; and in the corpus, from which it is
#: dealt by passages, and compared in any run of documents.
OFTEN, FREQUENT = 8, 2000
#: Suffixes compared at once.
BLOCK_ROWS = 20_000

_SPANS = "array<struct<first:long,last:long>>"
_SUFFIXES = "key long, right string, left string, doc_id long, at long, own int, repeated int, again int"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _spaced(w: Words) -> tuple[bytes, np.ndarray]:
    """The words in lower case, each followed by one space, and where each begins."""
    at = np.concatenate(([0], np.cumsum(w.last - w.first + 1)))
    out = np.full(at[-1], 32, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = _FOLD[w.data[SPACED[0][w.data]]]
    return out.tobytes(), at


def _cut(text: tuple[bytes, np.ndarray], first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Words first to last (exclusive) of each."""
    data, place = text
    return pa.array([data[a:b] for a, b in zip(place[first], place[last], strict=True)], pa.string())


def _matrix(texts: pa.Array, width: int, backwards: bool) -> np.ndarray:
    """A row of word numbers for each text, from its first word on, or from its last one back; -1 beyond its
    end. Equal numbers are equal words, and the other way round."""
    words = pc.split_pattern(texts, " ")
    offsets = words.offsets.to_numpy()
    ids = words.flatten().dictionary_encode().indices.to_numpy()
    n = np.diff(offsets) - 1  # each text ends in a space
    step = np.arange(width)
    at = (offsets[:-1] + n - 1)[:, None] - step if backwards else offsets[:-1][:, None] + step
    return np.where(step < n[:, None], ids[np.clip(at, 0, max(0, len(ids) - 1))], -1) if len(ids) else np.full((len(n), width), -1)


def compare(right: np.ndarray, left: np.ndarray, use: np.ndarray, rank: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which passages around suffixes occur again.

    right: the words of suffixes that are sorted by them; left: those before, the nearest first; use[i, d]: whether the
    passage that begins d words before suffix i takes part; rank: the order of the suffixes' places. Returns two
    matrices like use: passages with another place, and passages that are not the first of theirs."""
    n, size = right.shape
    repeated, again = np.zeros_like(use), np.zeros_like(use)
    common = np.zeros(n, np.int64)  # words in common with the neighbour before
    common[1:] = np.logical_and.accumulate(right[1:] == right[:-1], axis=1).sum(1)
    run = np.cumsum(common < reach)
    rows = np.flatnonzero(np.bincount(run)[run] > 1)
    if not len(rows):
        return repeated, again
    classes, radix = np.zeros(len(rows), np.int64), int(left.max(initial=0)) + 2
    for d in range(use.shape[1]):
        if d:
            classes = np.unique(classes * radix + left[rows, d - 1] + 1, return_inverse=True)[1]
        equal = np.cumsum(common < size - d)[rows] * len(rows) + classes
        mine = np.flatnonzero(use[rows, d])
        if len(mine) < 2:
            continue
        mine = mine[np.lexsort((rank[rows[mine]], equal[mine]))]
        place, group = rank[rows[mine]], equal[mine]
        head = np.r_[True, group[1:] != group[:-1]]
        later = place != place[head][np.cumsum(head) - 1]
        again[rows[mine], d] = later
        repeated[rows[mine], d] = np.logical_or.reduceat(later, np.flatnonzero(head))[np.cumsum(head) - 1]
    return repeated, again


def _bits(masks: np.ndarray, width: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(width) & 1).astype(bool)


def _mask(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.int32) << np.arange(bits.shape[1], dtype=np.int32)).sum(1, dtype=np.int32)


class Dedup:
    def __init__(self, min_words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM, sent_keys: int = SENT_KEYS) -> None:
        if window & (window - 1) or window > 16 or min_words < window + gram:
            raise ValueError("window must be a power of two to 16, and a passage longer than window + gram words")
        self.min_words, self.window, self.gram, self.sent_keys = min_words, window, gram, sent_keys
        self.reach = min_words - window + 1
        self.often, self.block_rows = OFTEN, BLOCK_ROWS

    def _anchors(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, anchors, keys): the passages' first words, each one's minimiser, and the
        fingerprint of the REACH words from there."""
        at, value = w.windows(self.gram)
        n = len(w.value)
        order = np.full(n + self.window, ~np.uint64(0))
        order[at] = mix(value)
        best = np.arange(n + self.window)
        step = 1
        while step < self.window:
            right = best[step:]
            left = best[: len(right)]
            best = np.where(order[right] < order[left], right, left)
            step *= 2
        starts, _ = w.windows(self.min_words)
        anchors = best[starts]
        places, keys = w.windows(self.reach)
        return starts, anchors, keys[np.searchsorted(places, anchors)].view(np.int64)

    def repeated_keys(self, docs: DataFrame) -> DataFrame:
        """(key, frequent): fingerprints that two suffixes or more share, and whether FREQUENT or more do."""

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in word_chunks(batch.column("text"), SPACED):
                    _, anchors, keys = self._anchors(w)
                    _, once = np.unique(anchors, return_index=True)
                    key, count = np.unique(keys[once], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count.astype(np.int32))], ["key", "n"])

        counts = docs.select("text").mapInArrow(emit, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
        return counts.where("n > 1").select("key", (F.col("n") >= FREQUENT).alias("frequent"))

    def suffixes(self, docs: DataFrame, keys: DataFrame) -> DataFrame:
        """The suffixes with one of these keys: their words, doc_id, place, and masks of passages by the words that they
        begin before the suffix: those to compare, and those found to be repeated, and to be no first place, in
        their run of documents. Suffixes with nothing left to compare have no words, and a key of their own."""
        if keys.count() <= self.sent_keys:
            table = keys.toArrow().sort_by("key")
            sent = docs.sparkSession.sparkContext.broadcast((table.column("key").to_numpy(), table.column("frequent").to_numpy()))
            rows = docs.select("doc_id", "text")
        else:
            sent = None
            places = docs.select("doc_id", "text").mapInArrow(self._emit_places, "key long, doc_id long, at long").join(keys, "key")
            places = places.groupBy("doc_id").agg(F.collect_set("at").alias("anchors"), F.collect_set(F.when(F.col("frequent"), F.col("at"))).alias("frequent"))
            rows = docs.select("doc_id", "text").join(places, "doc_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for w in word_chunks(batch.column("text"), SPACED):
                    starts, anchors, key = self._anchors(w)
                    at, first, n_own = np.unique(anchors, return_index=True, return_counts=True)
                    key, most = key[first], at - starts[first]
                    if sent is not None:
                        known, of_known = sent.value
                        if not len(at) or not len(known):
                            continue
                        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                        use = known[place] == key
                        frequent = of_known[place] & use
                    else:
                        lists = [batch.column(c).slice(w.rows[0], len(w.rows)).to_pylist() for c in ("anchors", "frequent")]
                        use, frequent = (np.isin(at, np.concatenate([w.bounds[i] + np.array(x or [], np.int64) for i, x in enumerate(y)])) for y in lists)
                    if not use.any():
                        continue
                    at, key, most, n_own, frequent = at[use], key[use], most[use], n_own[use], frequent[use]
                    owner = np.searchsorted(w.bounds, at, side="right") - 1
                    text = _spaced(w)
                    right = _cut(text, at, np.minimum(w.bounds[owner + 1], at + self.min_words))
                    left = _cut(text, np.maximum(w.bounds[owner], at - self.window + 1), at)
                    own = (((1 << n_own) - 1) << (most - n_own + 1)).astype(np.int32)
                    none = np.zeros(len(at), np.int32)
                    columns = [key, right, left, ids[w.rows[owner]].astype(np.int64), (at - w.bounds[owner]).astype(np.int64), own, none, none]
                    table = pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=_NAMES)
                    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
                    often = (count[back] >= self.often) | (frequent & (count[back] > 1))
                    table = table.append_column("suffix", pa.array(at)).append_column("frequent", pa.array(frequent))
                    if often.any():
                        crowd = table.filter(pa.array(often))
                        crowd = crowd.take(pc.sort_indices(crowd.column("right")))
                        settled = _settled(self.resolve(crowd.select(_NAMES)))
                        crowd = pa.table([*settled.columns, crowd.column("suffix"), crowd.column("frequent")], names=crowd.column_names)
                        table = pa.concat_tables([table.filter(pa.array(~often)), crowd])
                    if frequent.any():
                        split = pc.and_(table.column("frequent"), pc.not_equal(table.column("own"), 0))
                        table = pa.concat_tables([table.filter(pc.invert(split)).select(_NAMES), self._by_passage(table.filter(split), w, text, starts)])
                    yield from table.select(_NAMES).combine_chunks().to_batches()

        return rows.mapInArrow(run, _SUFFIXES)

    def _by_passage(self, table: pa.Table, w: Words, text: tuple[bytes, np.ndarray], starts: np.ndarray) -> pa.Table:
        """A row for each passage that is left to compare around these suffixes, dealt by the passage, with its words alone."""
        row, back = np.nonzero(_bits(table.column("own").to_numpy(), self.window))
        at = table.column("suffix").to_numpy()[row]
        _, passages = w.windows(self.min_words)
        key = passages[np.searchsorted(starts, at - back)].view(np.int64)
        rest = table.select(["doc_id", "at"]).take(pa.array(row))
        masks = [pa.array((1 << back).astype(np.int32)), *(table.column(c).take(pa.array(row)) for c in ("repeated", "again"))]
        return pa.table([pa.array(key), _cut(text, at, at - back + self.min_words), _cut(text, at - back, at), *rest.columns, *masks], names=_NAMES)

    def _emit_places(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_chunks(batch.column("text"), SPACED):
                _, anchors, keys = self._anchors(w)
                anchors, first = np.unique(anchors, return_index=True)
                owner = np.searchsorted(w.bounds, anchors, side="right") - 1
                doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[w.rows[owner]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(doc), pa.array(anchors - w.bounds[owner])], ["key", "doc_id", "at"])

    def resolve(self, table: pa.Table) -> pa.Table:
        """Suffixes in the order of their words with what their comparison adds to the masks; own loses what is no first place."""
        texts = [table.column(c).combine_chunks() for c in ("right", "left")]
        doc, at, own, repeated, again = (table.column(c).to_numpy() for c in _NAMES[3:])
        order = np.lexsort((at, doc))
        new = np.r_[False, (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])]
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.cumsum(new)
        found = compare(_matrix(texts[0], self.min_words, False), _matrix(texts[1], self.window - 1, True), _bits(own, self.window), rank, self.reach)
        repeated, again = repeated | _mask(found[0]), again | _mask(found[1])
        masks = [pa.array(x.astype(np.int32)) for x in (own & ~again, repeated, again)]
        return pa.table([*table.columns[:5], *masks], names=_NAMES)

    def matches(self, suffixes: DataFrame) -> DataFrame:
        """(doc_id, at, repeated, again): suffixes with repeated passages around them, some of them twice."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n_held, least = [], 0, self.block_rows
            for batch in _ended(batches):
                if batch is not None:
                    words = batch.column("right").is_valid()
                    yield from _told(pa.Table.from_batches([batch]).filter(pc.invert(words)))
                    held.append(pa.Table.from_batches([batch]).filter(words))
                    n_held += len(held[-1])
                    if n_held < least:
                        continue
                if not n_held:
                    continue
                table = pa.concat_tables(held).combine_chunks()
                key = table.column("key").to_numpy()
                cut = n_held if batch is None else int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
                rest = table.slice(cut)
                done = self.resolve(table.slice(0, cut) if cut else table)
                yield from _told(done)
                if not cut:  # one run of equal suffixes: its first places are carried on
                    rest = done.filter(pc.not_equal(done.column("own"), 0))
                held, n_held = [rest], len(rest)
                least = max(self.block_rows, 2 * n_held)

        rows = suffixes.repartition("key").sortWithinPartitions("key", "right", "doc_id", "at")
        return rows.mapInArrow(run, "doc_id long, at long, repeated int, again int")

    def spans(self, matches: DataFrame) -> DataFrame:
        """(doc_id, repeated, removed): maximal runs of words (the last exclusive) in repeated passages, and in
        passages that have occurred before."""

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            for batch in _ended(batches):
                if batch is not None:
                    held.append(pa.Table.from_batches([batch]))
                    if sum(map(len, held)) < self.block_rows:
                        continue
                if not held:
                    continue
                table = pa.concat_tables(held).combine_chunks()
                doc = table.column("doc_id").to_numpy()
                cut = len(doc) if batch is None else int(np.searchsorted(doc, doc[-1]))
                held = [table.slice(cut)]
                if cut:
                    ids = np.unique(doc[:cut])
                    lists = [self._runs(*(table.column(c).to_numpy()[:cut] for c in ("doc_id", "at", mask)), ids) for mask in ("repeated", "again")]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["doc_id", "repeated", "removed"])

        return matches.repartition("doc_id").sortWithinPartitions("doc_id", "at").mapInArrow(merge, f"doc_id long, repeated {_SPANS}, removed {_SPANS}")

    def _runs(self, doc: np.ndarray, at: np.ndarray, masks: np.ndarray, ids: np.ndarray) -> pa.ListArray:
        """For each of the ids the union of the passages of these masks."""
        row, back = np.nonzero(_bits(masks, self.window))
        doc, start = doc[row], at[row] - back
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        head = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + self.min_words)] if len(doc) else np.zeros(0, bool)
        tail = np.r_[head[1:], True] if len(doc) else head
        spans = pa.StructArray.from_arrays([pa.array(start[head]), pa.array(start[tail] + self.min_words)], ["first", "last"])
        offsets = np.searchsorted(doc[head], np.r_[ids, ids[-1:] + 1])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans)

    def find(self, docs: DataFrame) -> DataFrame:
        docs = _checked(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and text is not null")
        with passing(docs.sparkSession) as keep:
            keys = written(self.repeated_keys(docs))
            found = keep(written(self.matches(self.suffixes(docs, keys))))
        return self.spans(found)


_NAMES = [x.split()[0] for x in _SUFFIXES.split(", ")]


def _ended(batches):
    yield from batches
    yield None


def _checked(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be an integer, which orders the occurrences of a passage; it is {kind}")
    return docs


def _settled(table: pa.Table) -> pa.Table:
    """The suffixes with nothing left to compare lose their words, and get a key of their own."""
    done = table.column("own").to_numpy() == 0
    doc, at = (table.column(c).to_numpy().view(np.uint64) for c in ("doc_id", "at"))
    key = np.where(done, mix(doc * np.uint64(31) + at).view(np.int64), table.column("key").to_numpy())
    texts = [pc.if_else(pa.array(done), pa.scalar(None, pa.string()), table.column(c)) for c in ("right", "left")]
    return pa.table([pa.array(key), *texts, *table.columns[3:]], names=_NAMES)


def _told(table: pa.Table) -> Iterator[pa.RecordBatch]:
    found = table.filter(pc.not_equal(table.column("repeated"), 0)).select(["doc_id", "at", "repeated", "again"])
    yield from found.combine_chunks().to_batches()


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, sent_keys: int = SENT_KEYS) -> DataFrame:
    """Documents with passages of min_words words or more that occur twice or more.

    docs needs an integer doc_id (else TypeError) and text. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased.
    Returns doc_id, repeated and removed: arrays of first and last word (exclusive) of
    maximal runs; removed leaves out the first occurrence by doc_id and place. Rows
    with equal doc_id are one document: a row repeated is no repeat of its words, two texts
    of one doc_id share its places. Null doc_ids and null, empty or shorter texts have
    none, an empty table gives no rows. Texts are read whole however long; one row's words are
    in memory at once. Other columns are not read.
    """
    return Dedup(min_words, sent_keys=sent_keys).find(docs)


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these runs of words and the white space that follows each."""
    data = text.encode()
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.zeros(1, np.int64), SPACED)
    parts, at = [], 0
    for a, b in spans:
        if a >= len(w.first):
            break
        parts.append(data[at : w.first[a]])
        at = int(w.first[b]) if b < len(w.first) else len(data)
    parts.append(data[at:])
    return b"".join(parts).decode()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, sent_documents: int = SENT_DOCUMENTS) -> DataFrame:
    """docs, all columns, with the repeated passages cut from text but for their first occurrence.
    A text with nothing to cut stays as it is, to the byte; one of nothing else becomes empty. Null texts, and
    rows without doc_id, stay. Columns may have any other names."""
    id_name, cuts_name = fresh(docs, "_id"), fresh(docs, "_cuts")
    with passing(docs.sparkSession) as keep:
        cuts = keep(written(repeated_passages(docs, min_words).where("size(removed) > 0").select(F.col("doc_id").alias(id_name), F.col("removed").alias(cuts_name))))
    small = cuts.count() <= sent_documents
    joined = docs.join(F.broadcast(cuts) if small else cuts, docs["doc_id"].cast("long") == cuts[id_name], "left").drop(id_name)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, texts = batch.column(batch.num_columns - 1).to_pylist(), batch.column(place)
            columns = batch.columns[:-1]
            if any(cuts):
                new = [cut_text(t, [(x["first"], x["last"]) for x in c]) if c and t is not None else t for t, c in zip(texts.to_pylist(), cuts, strict=True)]
                columns[place] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = docs.columns
    return joined.mapInArrow(run, docs.schema)
