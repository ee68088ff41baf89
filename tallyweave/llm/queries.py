"""The opN_<name> queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontamination, divergence, itemsets, jaccard, languages, lengths, licenses, mainpath, nearvectors, oracles, packing, quality, suffixes, toxicity
from tallyweave.llm.shared import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_js", "word_js")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = languages.learn(docs.where(F.coalesce(languages.fold(F.col("doc_id"), 3) != 1, F.lit(False))))
    held_out = F.coalesce(languages.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return languages.identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(languages.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.learn(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.length_counts(_table(spark, sf_dir, "documents")))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpath.main_text(_table(spark, sf_dir, "pages"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvectors.near_links(_table(spark, sf_dir, "embeddings"))


def op12_basket_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.digest(*itemsets.closed_itemsets(_table(spark, sf_dir, "sale_lines")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_ngram_jaccard, op3_licenses, op4_suffix_dedup, op5_quality, op6_language_id, op7_toxicity, op8_packing, op9_token_counts, op10_main_text, op11_embedding_dedup, op12_basket_itemsets, op13_source_divergence)}
#: The others can't be expressed in SQL; their tests compare with brute force.
ORACLES: dict[str, str] = {"op1_decontamination": oracles.OP1, "op2_ngram_jaccard": oracles.OP2, "op3_licenses": oracles.op3(), "op11_embedding_dedup": oracles.OP11, "op12_basket_itemsets": oracles.OP12, "op13_source_divergence": oracles.OP13}
