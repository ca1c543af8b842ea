"""The registered queries of the training-data operators, on their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from . import ann, bpe, chosen_path, langid, line_dedup, mixing, quality_classifier, quality_rules, ranked_search, simhash, token_files, toxicity, whitening
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), stable=True))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    return langid.identify(docs, docs.where("NOT held_out"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(token_files.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark, table(spark, sf_dir, "embeddings"))


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_bpe, op2_language_id, op3_importance_resampling, op4_tokeniser_fertility, op5_token_files, op6_mixing, op7_simhash, op8_toxicity, op9_line_dedup, op10_nearest, op11_whitening, op12_chosen_path, op13_ranked_search, pipeline]
    return {f.__name__: f for f in made}
