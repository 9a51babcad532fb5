"""The queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metergrid.llm import chat, decontaminate, fim, hamming, importance, langid, lm, mixing, neardup, pages, quality, secrets, suffix_dedup
from metergrid.llm.common import held_out, read


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, words=3, percent=85, shallow=4)


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_languages(docs.where(~held_out()))
    found = langid.predict_language(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.render(chat.maximal(read(spark, sf_dir, "conversations")))
    return found.select(F.col("conv").alias("conv_id"), "n_turns", "chat")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming.nearest(rows, "vec_id", "embedding", lambda i: i % 50 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    model = quality.fit_quality(docs.join(labels, "doc_id"))
    found = quality.score_quality(docs, model, carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "size_difference")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.expr("aggregate(removed, 0L, (n, x) -> n + x.last - x.first)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id",
        *[count(k) for k in secrets.BASE],
        F.sha2(secrets.written_spans(base).cast("binary"), 256).alias("base_sha256"),
        secrets.written_spans(F.col("secrets")).alias("spans"),
    )


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)))
    model = lm.fit(docs.where("NOT held_out"))
    measured = lm.measure(docs, model, carry=["doc_id", "held_out"])
    return lm.score(measured, model, lm.fit_masses(measured.where("NOT held_out"), model))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.restored(fim.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"]))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance.draw(docs, read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_neardup, op2_pages, op3_language, op4_chat, op5_neighbours, op6_quality, op7_mixing, op8_suffix, op9_decontaminate, op10_secrets,
        op11_lm, op12_fim, op13_importance,
    )
    return {f.__name__: f for f in every}
