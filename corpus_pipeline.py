"""The corpus pipeline: language, near copies, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the
columns of ``documents``; the last adds what the mixture decided.  A stage's result is
written as Parquet and read back as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classlake.llm import decontaminate, language_id, minhash_forest, mixture, secret_scan
from classlake.llm.queries import MIX_EPOCHS, MIX_SHARE, MIX_WEIGHTS, mix_domain, table
from classlake.llm.shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go; a null language takes the predicted one."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group stays."""
    return minhash_forest.keep_one_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, with their domain and the number of epochs that hold them."""
    out = mixture.mix(docs, mix_domain(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)
    return out.select("row.*", F.col("domain").alias("mix_domain"), F.col("n_tokens").alias("mix_tokens"),
                      F.col("times").cast("long").alias("mix_times"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("mixture", mixed),
]

#: Fitted models and token counts have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
