"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier is trained from confirmed toxic documents and unlabelled ones, with
the risk estimator that is corrected for the class prior and kept from going negative
(Kiryo et al., 2017). Features are words and letter n-grams in words, present once, twice or
four times and more; those that tell the two sets apart are chosen from counts over both.
Training takes bounded samples of the confirmed documents and of all documents, labelled or
not; scoring takes every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyweave.llm.chargrams import Letters, letter_chunks
from tallyweave.llm.shared import drop_written, written
from tallyweave.llm.wordarrays import mix

#: Confirmed documents that a classifier is fitted on at most, those with the smallest hashes of their ids,
#: and unlabelled ones, a sample of about so many by the hashes of ids and texts.
MAX_ROWS = 30_000
#: Hashed feature space, features chosen at most, and toxic documents that one needs at least.
SPACE, FEATURES, LEAST = 1 << 22, 3000, 4
#: Lengths of n-grams with the blanks around a word.
GRAMS = (5, 7)
LEVELS = (1, 2, 4)


def features(part: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(owners, features): distinct hashed features of each document."""
    parts = [part.words(), *(part.grams(n) for n in GRAMS)]
    owner = np.concatenate([p[0] for p in parts])
    value = np.concatenate([mix(p[1] + np.uint64(k)) for k, p in enumerate(parts)]) % np.uint64(SPACE // len(LEVELS))
    both, count = np.unique(owner.astype(np.uint64) * np.uint64(SPACE) + value, return_counts=True)
    owner, value = (both // np.uint64(SPACE)).astype(np.int64), (both % np.uint64(SPACE)).astype(np.int64)
    out = [(owner[count >= n], value[count >= n] + k * (SPACE // len(LEVELS))) for k, n in enumerate(LEVELS)]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


class Model:
    """places: column of each feature in the space, -1 if it isn't used."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def columns(self, part: Letters) -> tuple[np.ndarray, np.ndarray]:
        owner, value = features(part)
        at = np.minimum(np.searchsorted(self.chosen, value), max(0, len(self.chosen) - 1))
        use = self.chosen[at] == value if len(self.chosen) else np.zeros(len(value), bool)
        return owner[use], at[use]

    def scores(self, part: Letters) -> np.ndarray:
        owner, at = self.columns(part)
        z = self.bias + np.bincount(owner, self.weights[at], len(part.rows)) if len(self.weights) else np.full(len(part.rows), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int, positive: np.ndarray, prior: float, epochs: int = 400, rate: float = 0.05, decay: float = 1e-4, unlabelled: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic loss, by Adam over all rows.

    rows, columns: the ones of a sparse 0/1 matrix. positive: its rows that are confirmed.
    unlabelled: those that stand for all documents, every row where not given. When the estimate of the negative risk falls below 0,
    the step goes against it, as the estimator's authors propose."""
    weights = np.zeros(n_columns + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    n_positive = positive.sum()
    of_p = positive / n_positive
    of_u = np.full(n_rows, 1 / n_rows) if unlabelled is None else unlabelled / unlabelled.sum()
    for step in range(1, epochs + 1):
        z = np.bincount(rows, weights[columns], n_rows) + weights[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_negative = np.logaddexp(0, z)
        negative = (of_u * as_negative).sum() - prior * (of_p * as_negative).sum()
        if negative >= 0:
            slope = prior * of_p * (s - 1) + of_u * s - prior * of_p * s
        else:
            slope = -(of_u * s - prior * of_p * s)
        grad = np.r_[np.bincount(columns, slope[rows], n_columns), slope.sum()]
        grad[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return weights[:-1], float(weights[-1])


def _bitmap(features: DataFrame) -> np.ndarray:
    """The features of a table as a bit each, SPACE in all: what reaches the driver and goes to the workers has a fixed size."""
    width = 1 << 15
    rows = features.groupBy(F.floor(F.col("feature") / width).alias("k")).agg(F.bitmap_construct_agg(F.col("feature") % width).alias("bits")).collect()
    out = np.zeros((SPACE // width, width // 8), np.uint8)
    for r in rows:
        out[r.k] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, prior: float | None = None) -> Model:
    """A classifier from docs (doc_id, text), whose rows are all unlabelled ones, and labels (doc_id, toxic).
    Documents with toxic 1 are the confirmed ones, at most max_rows. Of docs, a sample of about max_rows is taken
    by a hash, whether a row has a label or not. Labels 0 are used for nothing but the class prior: where it isn't
    given, it is the toxic share of the labelled ids, which holds if what was labelled was not picked by toxicity.
    Without confirmed documents the model scores 0. Null and empty texts have no features, a long one all of its own; repeated
    rows count each. What reaches the driver is bounded by max_rows documents of at most FEATURES chosen features."""
    kind = "long" if all(isinstance(d.schema["doc_id"].dataType, IntegralType) for d in (docs, labels)) else "string"  # ids of other types are compared as text
    picked = labels.select(F.col("doc_id").cast(kind).alias("_id"), F.col("toxic").alias("toxic")).where("_id is not null and toxic is not null")
    picked = picked.groupBy("_id").agg((F.max("toxic") == 1).alias("toxic"))
    if prior is None:
        labelled, confirmed = picked.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
        if confirmed and confirmed == labelled:
            raise ValueError("labels without toxic 0 say nothing about the class prior: it must be given")
        prior = (confirmed or 0) / max(1, labelled)
    picked = picked.where("toxic").orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    docs = docs.select(F.col("doc_id").cast(kind).alias("_id"), F.col("text").alias("text"))
    share = min(1.0, max_rows / max(1, docs.count()))
    sampled = F.shiftrightunsigned(F.xxhash64("_id", "text"), 11) < int(share * (1 << 53))
    texts = docs.join(F.broadcast(picked), "_id", "left").select("text", F.coalesce("toxic", F.lit(False)).alias("toxic"), sampled.alias("unlabelled"))
    texts = written(texts.where("toxic or unlabelled"))
    total, n_positive = texts.agg(F.sum(F.col("unlabelled").cast("long")), F.sum(F.col("toxic").cast("long"))).first()
    if not n_positive or not total:
        drop_written(texts)
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    prior = min(0.99, max(1e-4, prior))

    def count(positive_only: bool, known: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(SPACE, np.int32)
            for batch in batches:
                mine = batch.column("toxic" if positive_only else "unlabelled").to_numpy(zero_copy_only=False)
                for part in letter_chunks(batch.column("text"), np.flatnonzero(mine)):
                    sums += np.bincount(features(part)[1], minlength=SPACE).astype(np.int32)
            used = np.flatnonzero(sums if known is None else sums * np.unpackbits(known, count=SPACE, bitorder="little"))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used].astype(np.int64))], ["feature", "n"])

        return texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    in_p = written(count(True, None).where(F.col("n") >= LEAST).withColumnRenamed("n", "p"))
    in_u = count(False, _bitmap(in_p)).withColumnRenamed("n", "u")
    counts = in_p.join(in_u, "feature").withColumns({"share": F.col("p") / n_positive, "pooled": F.col("u") / total})
    rest = F.greatest(F.col("pooled") - prior * F.col("share"), F.lit(0.0)) / (1 - prior)
    deviation = F.sqrt(F.greatest(F.lit(1e-12), F.col("pooled") * (1 - F.col("pooled"))) * (1 / n_positive + 1 / total))
    z = (F.col("share") - rest) / F.greatest(F.lit(1e-6), deviation)
    best = counts.select("feature", z.alias("z")).where("z > 3").orderBy(F.desc("z"), "feature").limit(FEATURES)
    model = Model(np.sort(np.array([r[0] for r in best.collect()], np.int64)), np.zeros(0), 0.0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("toxic", "unlabelled")]
            for part in letter_chunks(batch.column("text")):
                owner, at = model.columns(part)
                order = np.lexsort((at, owner))
                offsets = np.searchsorted(owner[order], np.arange(len(part.rows) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[part.rows]) for x in flags), lists], ["toxic", "unlabelled", "features"])

    table = texts.mapInArrow(encode, "toxic boolean, unlabelled boolean, features array<int>").toArrow()
    toxic, unlabelled, lists = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).combine_chunks()
    columns, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    # The rows arrive in any order, and sums depend on it in their last digits: they are put in one order here.
    order = sorted(range(len(toxic)), key=lambda i: (toxic[i], unlabelled[i], columns[offsets[i] : offsets[i + 1]].tobytes()))
    rows = np.repeat(np.argsort(order), np.diff(offsets))
    toxic, unlabelled = toxic[order], unlabelled[order]
    by_row = np.lexsort((columns, rows))
    rows, columns = rows[by_row], columns[by_row]
    drop_written(in_p)
    drop_written(texts)
    model.weights, model.bias = fit_nnpu(rows, columns, len(toxic), len(model.chosen), toxic.astype(bool), prior, unlabelled=unlabelled.astype(bool))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) of each row of docs, which needs doc_id and text. Null and
    empty texts have no features, and score by the bias; a text is read whole however long. No documents give no rows. Other
    columns are not read; repeated rows give repeated rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in letter_chunks(batch.column("text")):
                s = sent.value.scores(part)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.rows[0], len(part.rows)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
