"""The registered queries of the training-data operators, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollscope.llm import chat, decontam, licenses, manifest, mixing, neighbours, pii, repeats, secrets, simhash, spelling, toxicity, urls
from rollscope.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat.with_fixture(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.prefix_target_examples(conversations))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_first=False, with_text=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(embeddings, embeddings.filter("vec_id % 20 = 0"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rules_table(spark))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(manifest.dataset_manifest(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_pii": op2_pii,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_decontam": op5_decontam,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_licenses": op8_licenses,
    "op9_ann": op9_ann,
    "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling,
    "op12_url_filter": op12_url_filter,
    "op13_manifest": op13_manifest,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op12_url_filter": urls.ORACLE,
    "op13_manifest": manifest.ORACLE,
}
