"""The thirteen operators as queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, labelled, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, token_counts, toxicity, url_filter, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _judged(scored: DataFrame, folds: int, held: int) -> DataFrame:
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id, F.coalesce(labelled.fold(doc_id, folds) == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality_classifier.train(docs, labels, labelled.fold(F.col("id"), 4) != 2)
    return _judged(quality_classifier.score(docs, weights), 4, 2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, labelled.fold(F.col("id"), 3) != 1)
    return _judged(toxicity.score(docs, model), 3, 1)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(_documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op5_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def op6_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_documents(spark, sf_dir))


def op7_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(_documents(spark, sf_dir).select("doc_id", "source", "text"), keep=["doc_id"])
    placed = mixed.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.get("mix.positions", F.lit(0)).alias("first_position"), F.get("mix.positions", F.lit(1)).alias("second_position"))
    return placed.orderBy(F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def op8_dynamic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return packing.pack(docs, [docs["doc_id"]])


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS rules(host, path, verdict)")
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.without_repeated_passages(_documents(spark, sf_dir).select("doc_id", "text"))
    return clean.select("row.doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"), "n_removed_sentences", F.md5("passages_text").alias("passages_md5"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(_documents(spark, sf_dir)))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])
    each = rows.select("row.vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.get("explained", "at").alias("explained"), "identity_error")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf_dir)).select("lang", "source", "part", "item", "value", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_toxicity, op3_quality_rules, op4_minhash_near_dedup, op5_collision_counting_ann, op6_offset_token_counts, op7_curriculum_mixing, op8_dynamic_packing, op9_url_filters, op10_line_dedup, op11_byte_bpe, op12_embedding_whitening, op13_source_divergence)
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op4_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op7_curriculum_mixing": mixing.ORACLE_SQL,
    "op9_url_filters": url_filter.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
