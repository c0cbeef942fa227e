"""The corpus queries: thin digests of the operators of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import chat, langid, licenses, mixing, packing, periodic, personal, quality, repair, topk, vamana, warc
from pointloom.llm.common import read_table, scratch_path
from pointloom.llm.licenses import license_digest, scan_licenses
from pointloom.llm.simhash import simhash_components


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(read_table(spark, sf_dir, "documents")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(rows))


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    warc.write_archives(read_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).drop("url")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.embedding_links(read_table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.in_held_out_fold(F.col("doc_id"))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_digest(personal.find_personal_data(read_table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(read_table(spark, sf_dir, "documents"))
    return periodic.run_digest(periodic.periodic_runs(docs))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digest(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_quality_resampling": op2_quality_resampling,
    "op3_license_scan": op3_license_scan,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_warc_archives": op5_warc_archives,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_source_mixing": op9_source_mixing,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_personal_data": op11_personal_data,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": licenses.ORACLE_SQL,
    "op4_chat_formatting": chat.ORACLE_SQL,
    "op5_warc_archives": warc.ORACLE_SQL,
    "op6_embedding_near_dedup": vamana.ORACLE_SQL,
    "op9_source_mixing": mixing.ORACLE_SQL,
    "op10_exact_top_k": topk.ORACLE_SQL,
}
