"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import langid, mixing, packing, quality
from pointloom.llm.common import discard, materialise, placed, read_table, rows_with, scratch_path, temporary_tables, word_count
from pointloom.llm.simhash import drop_near_copies

#: A document whose language is predicted with less probability than this is rejected.
LEAST_LANGUAGE_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts are such) or without a language of some probability go; a null lang is filled in.

    Repeated rows share their fate; other columns stay, whatever their names; an empty table stays empty.
    """
    columns = docs.columns
    model = langid.train(docs.where(~langid.in_held_out_fold(F.col("doc_id"))))
    rows = docs.select(F.struct(*(c for c in columns if c != "text")).alias("row"), "text")
    found = langid.identify(rows, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    own = {"text": F.col("text"), "lang": F.coalesce("row.lang", "lang_pred").alias("lang")}
    return found.select(*(own.get(c, F.col("row")[c].alias(c)) for c in columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go.

    Nulls, ties, repeated rows and empty tables are as in ``quality.resample``; other columns stay, whatever their names.
    """
    rows = placed(docs, stored=True)
    thin = rows.select("file", "at", "row.doc_id", "row.text")
    kept = quality.resample(thin, read_table(spark, sf_dir, "labels"), keep=("file", "at")).where("kept")
    return rows_with(rows, kept.select("file", "at")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document of the smallest doc_id stays; see ``drop_near_copies``."""
    return drop_near_copies(docs, stored=True)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it; those that it takes no copy of go.

    A null source is a source of its own, null texts have size 0; repeated rows each have their copies; an empty table stays empty.
    """
    rows = placed(docs, stored=True)
    thin = materialise(rows.select("file", "at", "row.doc_id", "row.source", word_count(F.col("row.text")).alias("size")), "document-sizes")
    taken = mixing.copies_taken(thin).where("copies > 0").select("file", "at", "copies")
    rows = rows_with(rows, taken, times=3)
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Learned models and graph components aren't SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"stage-{name}")
        with temporary_tables(spark):  # what a stage writes for itself goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        docs.written_to = path
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
