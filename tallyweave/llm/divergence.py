"""How the sources of a language differ in their words: divergences of every two, and the words that mark a source.

Words are counted by language and source. Each word of a language's vocabulary becomes one row with an array of its counts,
indexed by source. From that row, functions of arrays give what the word adds to the divergence of every two sources, and
partial sums go over the shuffle: as many rows a task as there are pairs of sources. A word that neither of two
sources has adds the same for all such words; it is counted by the size of the vocabulary, and only differences from it are made.

All figures are integers. A probability is p = 1 + floor(10**9 * (count + 1) / (N + V)), and a divergence adds
floor((p - q)**2 / q).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.shared import passing, written

#: Documents of a language that a word of its vocabulary is in, at least.
LEAST_DOCS = 3
#: Words reported for a source.
TERMS = 200
SCALE = 1_000_000_000
#: Bytes of text that a task counts at once, unless one document has more.
CHUNK_BYTES = 8 << 20

#: Letters, with A-Z lower-cased, and the bytes of other characters; all else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COLUMNS = ["lang", "source", "term", "n", "d"]


def _chunk(texts: list[bytes], groups: list[tuple[str, str]]) -> pa.RecordBatch:
    """(lang, source, term, n, d) of some documents: occurrences and documents of each word, and a row with term '' for each group."""
    number = {g: k for k, g in enumerate(dict.fromkeys(groups))}
    of_doc = np.array([number[g] for g in groups], np.int64)
    letters = np.frombuffer(b" ".join(texts).translate(_FOLD), np.uint8)
    word = letters != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[word].tobytes())]).dictionary_encode()
    size = max(1, len(words.dictionary))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    pairs, times = np.unique(doc * size + words.indices.to_numpy(), return_counts=True)
    keys, place = np.unique(of_doc[pairs // size] * size + pairs % size, return_inverse=True)
    n, d = np.bincount(place, times, len(keys)).astype(np.int64), np.bincount(place, minlength=len(keys))
    group = np.concatenate((keys // size, np.arange(len(number))))
    names, zeros = list(number), np.zeros(len(number), np.int64)
    term = pa.concat_arrays([words.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array([""] * len(number), pa.string())])
    columns = [pa.array([g[i] for g in names], pa.string()).take(pa.array(group)) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, term, pa.array(np.concatenate((n, zeros))), pa.array(np.concatenate((d, zeros)).astype(np.int64))], _COLUMNS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, groups, held = [], [], 0
    for batch in batches:
        for text, *group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            texts.append(text.encode())
            groups.append(tuple(group))
            held += len(texts[-1])
            if held > CHUNK_BYTES:
                yield _chunk(texts, groups)
                texts, groups, held = [], [], 0
    if texts:
        yield _chunk(texts, groups)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) of documents (text, lang, source, ...), nulls read as ''; term is '' for the group itself."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = read.mapInArrow(_counts, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _p(count: Column, total: Column, words: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + words)), exact for counts of any size."""
    return F.lit(1).cast("long") + F.call_function("div", (F.lit(SCALE).cast("decimal(11,0)") * (count + 1).cast("decimal(20,0)")), (total + words).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _dense(entries: Column, size: Column, empty: Column) -> Column:
    """An array of `size` out of sorted entries (k, p), with the values of `empty` where there is none."""
    before = lambda i: F.when(i == 0, -1).otherwise(F.get(entries, i - 1)["k"])
    last = F.coalesce(F.element_at(entries, -1)["k"], F.lit(-1))
    parts = F.transform(entries, lambda x, i: F.concat(F.slice(empty, before(i) + 2, x["k"] - before(i) - 1), F.array(x["p"])))
    return F.concat(F.flatten(parts), F.slice(empty, last + 2, size - last - 1))


def _vectors(counts: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(lang, term, total, entries): the vocabulary, with the counts (k, n) of each word by number of source, in order."""
    rows = counts.where("term != ''").join(groups, ["lang", "source"])
    out = rows.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("k", "n"))).alias("entries"))
    return out.where(F.col("docs") >= least).drop("docs")


def _languages(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row for each language: words (V), all (N), and arrays by number of source: sources, totals, and p of a word not there."""
    sums = vectors.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.k").alias("k")).agg(F.sum("e.n").alias("total"))
    words = vectors.groupBy("lang").agg(F.count("*").alias("words"), F.sum("total").alias("all"))
    each = groups.join(sums, ["lang", "k"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "source", F.coalesce("total", F.lit(0)).alias("total")))).alias("g"))
    out = each.join(words, "lang", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    p = F.when(F.col("words") > 0, F.transform("g", lambda g: _p(F.lit(0).cast("long"), g["total"], F.col("words"))))
    return out.select("lang", "words", "all", F.transform("g", lambda g: g["source"]).alias("sources"), F.transform("g", lambda g: g["total"]).alias("totals"), p.alias("zero"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source, ...), of which nulls are read as ''.

    Part `pair`: the divergence of a source from each other one of its language. Part `term`: the words that are more frequent
    in a source than in its language, by what they add to its divergence from the language, `terms` of them at most.
    Every group of a language and source has its pairs, also without any words; a language without vocabulary has pairs of value 0.
    Equal values are ranked by item. A text is counted whole however long; repeated rows count again; no documents give no rows;
    other columns aren't read, whatever their names.
    """
    with passing(docs.sparkSession) as keep:
        counts = written(term_counts(docs))
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        groups = written(counts.where("term = ''").select("lang", "source").distinct().withColumn("k", number))
        vectors = written(_vectors(counts, groups, least_docs))
        languages = keep(written(_languages(groups, vectors)))
        words = F.col("words")
        given = F.transform("entries", lambda e: F.struct(e["k"].alias("k"), _p(e["n"], F.get("totals", e["k"]), words).alias("p")))
        wide = vectors.join(languages, "lang").select("lang", "term", "zero", "sources", given.alias("given"), _p(F.col("total"), F.col("all"), words).alias("q"))
        # written, as else every entry would compute its whole array again
        wide = keep(written(wide.select("lang", "term", "q", "given", _dense(F.col("given"), F.size("sources"), F.col("zero")).alias("p"))))
    rows = wide.join(languages.select("lang", "zero", "sources", F.size("sources").alias("size")), "lang")

    # pairs: what a word adds beyond a word that neither source has, of each source i that has it; and to those of sources without it
    one = rows.select("lang", "zero", "size", "p", F.inline(F.filter("given", lambda g: g["p"] != F.get("zero", g["k"]))).alias("i", "pi")).withColumn("zi", F.get("zero", F.col("i")))
    pi, zi = F.col("pi"), F.col("zi")
    out = F.zip_with("p", "zero", lambda p, z: _f(pi, p) - _f(zi, z))
    into = F.zip_with("p", "zero", lambda p, z: F.when(p == z, _f(p, pi) - _f(z, zi)))
    each = one.select("lang", "i", "size", F.posexplode(F.concat(out, into)).alias("at", "f")).where("f is not null")
    there = F.col("at") < F.col("size")
    j = F.col("at") % F.col("size")
    sums = each.groupBy("lang", F.when(there, F.col("i")).otherwise(j).alias("i"), F.when(there, j).otherwise(F.col("i")).alias("j")).agg(F.sum("f").alias("f"))
    at = lambda a, i: F.get(F.col(a), i)
    every = languages.select("lang", "words", "zero", "sources", F.posexplode("sources").alias("i", "source")).select("*", F.posexplode("sources").alias("j", "item")).where("i != j")
    every = every.select("lang", "source", "item", "i", "j", F.when(F.col("words") > 0, F.col("words") * _f(at("zero", F.col("i")), at("zero", F.col("j")))).otherwise(0).alias("base"))
    pairs = every.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("f", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    more = F.transform(F.filter("given", lambda g: g["p"] > F.col("q")), lambda g: F.struct(at("sources", g["k"]).alias("source"), _f(g["p"], F.col("q")).alias("value")))
    marks = rows.select("lang", F.col("term").alias("item"), F.inline(more))
    marks = marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms)
    return pairs.unionByName(marks.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
