"""Benchmark decontamination: one Aho-Corasick automaton over all test windows.

Every window of ``window`` consecutive words of each item, normalised, is a string in which each word of the
benchmark has a code of a few letters, all of one length; other words have one that no window holds. A document is normalised and
encoded the same way and scanned once; each match gives words of the document, and their places in the
original text. Benchmarks are small beside a corpus, yet nothing relies on it: one of more than BLOCK_CHARS characters is dealt
to several automata of that size, and the documents pass through them one after the other, without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.shared import drop_written, written
from tallyweave.llm.wordarrays import ALNUM, string_bytes

#: Characters of items in one automaton: about 4 nodes each, of 40 bytes, in each worker.
BLOCK_CHARS = 1_000_000
WINDOW = 13

_KEEP = ALNUM[0]
_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if _KEEP[b] else 32 for b in range(256))

MATCHES = "array<struct<item:string,first:long,words:long>>"


def _words(text: bytes) -> list[bytes]:
    """The text's words in lower case."""
    return text.translate(_NORMAL).split()


def item_windows(text: str | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    """The item's windows; the whole item if it has fewer words; none without words."""
    words = _words((text or "").encode())
    n = min(window, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Scanner:
    """The automaton, and the codes of its words: as many digits to the base of 64 as their number asks for, each
    place with letters of its own, so that a match can begin at a word only and no node has many children."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in item_windows(text, window):
                owners.setdefault(w, set()).add(item)
        words = sorted({x for w in owners for x in w})
        self.width = 1
        while 64**self.width < len(words):
            self.width += 1
        self.codes = {x: "".join(chr(1 + 64 * k + (i >> 6 * k & 63)) for k in range(self.width)) for i, x in enumerate(words)}
        self.other = "\0" * self.width
        self.automaton = ahocorasick.Automaton()
        for w, who in owners.items():
            self.automaton.add_word("".join(self.codes[x] for x in w), (len(w), sorted(who)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(item, first word, words) of each occurrence of a window in a text's words."""
        if not self.codes or not words:
            return []
        text = "".join(map(self.codes.get, words, repeat(self.other)))
        return [(item, end // self.width - n + 1, n) for end, (n, who) in self.automaton.iter(text) for item in who]


#: The scanners that a worker has built, one for each scan's block.
_scanners: dict[str, Scanner] = {}


def _scanner(sent, name: str, window: int) -> Scanner:
    if name not in _scanners:
        if len(_scanners) >= 2:
            _scanners.clear()
        _scanners[name] = Scanner(sent.value, window)
    return _scanners[name]


def _merged(pairs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _char_spans(text: bytes, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Code point offsets in the text of runs of words."""
    data = np.frombuffer(text, np.uint8)
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = _KEEP[data]
    first, last = np.flatnonzero(mask[1:] & ~mask[:-1]), np.flatnonzero(mask[:-1] & ~mask[1:])
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(chars[first[a]]), int(chars[last[b - 1]])) for a, b in runs]


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Where windows of the items occur in the documents.

    docs needs doc_id and text, items item_id and text; other columns are not read.
    Returns, for each row of docs, doc_id, n_words, n_hit (words in an occurrence),
    items (sorted distinct item_ids as strings), and spans (first and last code
    point offset, the last exclusive, of each run of hit words in the original text).
    Null and empty texts have no words and no hits. Items with a null item_id
    or without words match nothing; repeated items count once, and items of one id together. Repeated documents
    give repeated rows; a text is scanned whole however long. Without items nothing is hit, and without documents there
    are no rows.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("item is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    if n_blocks > 1:
        items = written(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))))
    out = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    id_field = out.schema["doc_id"]
    for block in range(n_blocks):
        mine = items if n_blocks == 1 else items.where(F.col("block") == block).select("item", "text")
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in mine.collect()])
        out = out.mapInArrow(_block(sent, window, block > 0, block == n_blocks - 1), _schema(id_field, block == n_blocks - 1))
    if n_blocks > 1:
        drop_written(items)
    return out


def _schema(id_field: T.StructField, last: bool) -> str:
    kind = id_field.dataType.simpleString()
    return f"doc_id {kind}, " + ("n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>" if last else f"text string, matches {MATCHES}")


def _block(sent, window: int, later: bool, last: bool):
    match_type = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(sent, name, window)
        for batch in batches:
            data, off = string_bytes(batch.column("text"))
            texts = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            words = [_words(t) for t in texts]
            found = [scanner.scan(w) for w in words]
            if later:
                found = [[(m["item"], m["first"], m["words"]) for m in old] + new for old, new in zip(batch.column("matches").to_pylist(), found, strict=True)]
            if not last:
                matches = pa.array([[{"item": i, "first": f, "words": n} for i, f, n in x] for x in found], match_type)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), matches], ["doc_id", "text", "matches"])
                continue
            runs = [_merged([(f, f + n) for _, f, n in x]) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([sum(b - a for a, b in x) for x in runs], pa.int64()),
                    pa.array([sorted({i for i, _, _ in x}) for x in found], pa.list_(pa.string())),
                    pa.array([[{"first": a, "last": b} for a, b in _char_spans(t, x)] if x else [] for t, x in zip(texts, runs, strict=True)], span_type),
                ],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return run


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The contamination rule: some word is hit, and at least one in twenty."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of scan()'s rows."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
