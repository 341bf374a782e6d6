"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm import chat, decontaminate, exact_dedup, language, license_scan, mixing, secrets, simhash, spelling, token_shards, toxicity, url_filter, vector_codes
from cairn.plans.durable import Scratch
from cairn.sources.tables import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.planted(table(spark, sf_dir, "conversations"))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out(F.col("doc_id"))
    machine = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score_documents(docs, machine)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialise(token_shards.training_order(table(spark, sf_dir, "documents")), Scratch(spark, "token-shards"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_chat_format, op3_toxicity, op4_url_filter, op5_decontaminate, op6_simhash_dedup, op7_language_id, op8_token_shards, op9_exact_dedup, op10_mixing, op11_vector_codes, op12_spelling_variants, op13_secret_scan)}
SQL = {
    "op2_chat_format": chat.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_mixing": mixing.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_spelling_variants": spelling.SQL,
}
