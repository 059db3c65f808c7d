"""From raw documents to packed training sequences.

Documents of bad quality go, one of each group of near-duplicates stays, what
a benchmark contaminates goes, secrets are marked out, and the rest is packed.
A clean document passes all stages unchanged. Every stage but the last returns
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.llm import decontaminate, jaccard, packing, quality_crf, secrets
from cohortlane.llm.frames import read_table, ship
from cohortlane.llm.queries import tokenizer_path
from cohortlane.sources.sinks import stage

#: Documents with a smaller score are rejected.
QUALITY = 0.3
#: Near-duplicates share 80 % of their shingles of five words; op6's contract has values of its own.
NEAR = jaccard.Join(size=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose lines are mostly bad.

    NULL and empty texts are judged as one empty line, repeated rows alike; rows
    without id are judged like others; an empty table stays empty.
    """
    ship(spark)
    model = quality_crf.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_crf.keep_good(docs, model, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group.

    NULL and empty texts and rows without id are in no group and stay; rows that
    repeat an id stay or go together; an empty table stays empty.
    """
    ship(spark)
    return jaccard.one_of_each(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold passages of the benchmark.

    NULL and empty texts have no words and stay; each row is judged on its own
    text, so repeated rows go together; an empty table or benchmark is allowed.
    """
    ship(spark)
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark; ``n_chars`` follows the text.

    All rows stay. NULL texts stay NULL, with a NULL ``n_chars``; texts without
    secrets are unchanged; repeated rows change alike; an empty table stays empty.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: a row per piece.

    NULL and empty texts are one piece of one token; every row is packed, also
    where rows or ids repeat; a NULL id stays NULL; an empty table gives no rows.
    """
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit", best_fit),
]

#: The random field, the randomness tests and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
