"""A training corpus from raw documents: language, near copies, repeated passages, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the last return
the columns of documents. Null texts are rejected by the first stage; null ids, sources and languages pass through;
repeated rows are near copies of each other, so one stays; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm import decontamination, language_id, mixing, simhash_dedup, substring_dedup
from kinspan.llm.common import drop, shielded, staged

#: A language is taken as found from this probability on.
CERTAIN = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that no language fits with the probability CERTAIN."""
    docs, back = shielded(docs)
    found = language_id.predict(docs, language_id.fit(docs), keep=docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= CERTAIN)).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by SimHash."""
    return simhash_dedup.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of passages that occur elsewhere; n_chars follows the text, documents left empty stay as such."""
    docs, back = shielded(docs)
    found = substring_dedup.deduplicate(docs, keep=docs.columns)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*back)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, numbered by mix_copy, with its source's target in words."""
    docs, back = shielded(docs)
    found = mixing.mix_sources(docs, keep=[c for c in docs.columns if c != "doc_id"]).where("copies > 0")
    return found.select(*back, F.col("target").alias("mix_target"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("mix_copy"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: Hashes, learnt models and links have no SQL here; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            drop(before)  # its successor is written
    return STAGES[-1][1](spark, docs, sf_dir)
