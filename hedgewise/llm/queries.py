"""One registered query per operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hedgewise.llm import (
    decontamination, filter_audit, fingerprints, language_id, lm_scoring, mixing, near_dedup, ngram_join, periodic_runs, sharding, token_counts, token_files, toxicity,
)
from hedgewise.llm.common import held_out, table

TOKEN_LIMIT = 4096
SHARDS = 24
END_ID = 1


def vocabulary(name: str) -> str:
    """A file of the vocabulary package, which only the two queries over tokens need."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), TOKEN_LIMIT)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(7, 2)
    counts = lm_scoring.word_counts(docs, ~apart)
    scored = lm_scoring.score(docs, lm_scoring.fit(docs, ~apart, counts), counts)
    return scored.select("doc_id", apart.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(4, 2)
    found = language_id.predict(docs, language_id.fit(docs, ~apart))
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(5, 0)
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~apart)
    return toxicity.score(docs, machine).select("doc_id", apart.alias("held_out"), "score", "predicted")


def fitted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> mixing.Mix:
    """Equal shares of the languages and a tenth of low quality; the classifier learns from the labelled documents."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    classifier = mixing.fit_classifier(documents, mixing.quality_domains(documents, labels))
    return mixing.fit(docs, classifier, mixing.balanced_weights(classifier.domains))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.apply(docs, fitted_mix(spark, docs, sf_dir))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(planted))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_language_id": op5_language_id,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_token_files": op7_token_files,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op11_filter_interaction_audit": filter_audit.ORACLE_SQL,
}
