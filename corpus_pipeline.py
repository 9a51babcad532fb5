"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metergrid.llm import decontaminate, langid, mixing, neardup, secrets
from metergrid.llm.common import held_out, read, written



def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those that resemble none of the languages as texts of their length do."""
    learn = docs.where(~held_out())
    model = langid.fit_languages(learn)
    found = langid.predict_language(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ~langid.below_floor(langid.score_floors(learn, model))).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that five-word shingles with a similarity of 0.8 link, the one with the smallest id stays."""
    kept = neardup.near_duplicates(docs, words=5, percent=80, shallow=3).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    unnamed = docs.where("doc_id IS NULL")
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return named.select(*docs.columns).union(unnamed)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by [secret]; the documents stay."""
    clean = secrets.redact(secrets.find_secrets(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is drawn, with its epoch and block of the training stream."""
    draws = mixing.mix(docs).select(F.col("doc_id").alias("drawn_id"), "n_tokens", "epoch", "block")
    return docs.join(draws, docs["doc_id"].eqNullSafe(draws["drawn_id"])).select(*docs.columns, "n_tokens", "epoch", "block")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", no_benchmark),
    ("secrets", no_secrets),
    ("mixing", mixed_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID and near-duplicates by signature can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
