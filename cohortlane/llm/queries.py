"""The registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.llm import (
    chat,
    decontaminate,
    jaccard,
    licenses,
    lm_score,
    packing,
    pii,
    quality_crf,
    quality_rules,
    resample,
    secrets,
    spelling,
    toxicity,
)
from cohortlane.llm.frames import read_table, ship
from cohortlane.llm.oracle import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    columns = ["conv_id", "turn", "role", "text"]
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.read_back(read_table(spark, sf_dir, "conversations").select(*columns).unionByName(probe))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = quality_crf.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_crf.score_documents(docs, model)
    return scored.select(
        "doc_id",
        quality_crf.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_lines",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    counts = [secrets.count_kind(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.benchmark_hits(docs, read_table(spark, sf_dir, "benchmark"), drop=("text",))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.link_documents(read_table(spark, sf_dir, "documents"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.clean_lines(docs).drop("text", "cleaned")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.concat_ws(" ", "sentences").alias("sentences"),
        F.concat_ws(",", "licenses").alias("licenses"),
        "open",
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_score.held_out(F.col("doc_id"))
    model, counts = lm_score.fit(docs.where(~out))
    scored = lm_score.score_documents(docs, model, counts)
    return scored.select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    # of the base spans, as their digest
    counts = [secrets.count_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.joined(F.col("base"), pii.KINDS), 256).alias("base_sha256"),
        secrets.joined(F.col("spans"), pii.KINDS).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_disguised"),
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spelling.group_variants(read_table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    tagger = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, tagger).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_words",
        F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"]))).alias("spans"),
    )


QUERIES: dict[str, Query] = {
    "op1_chat": op1_chat,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard": op6_jaccard,
    "op7_line_rules": op7_line_rules,
    "op8_licenses": op8_licenses,
    "op9_lm": op9_lm,
    "op10_pii": op10_pii,
    "op11_resample": op11_resample,
    "op12_spelling": op12_spelling,
    "op13_toxicity": op13_toxicity,
}


def llm_queries() -> dict[str, Query]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}
