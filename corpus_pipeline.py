"""Preparing a corpus in stages; each is written as Parquet and read by the next.

Every stage but the last returns the columns of ``documents``, and any others that it gets,
whatever their names. An empty table stays empty. Equal rows share their fate; texts of any
length are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelforge.llm import decontamination, language_id, line_dedup, mixing, near_dedup, sieve
from funnelforge.session import scratch_path, scratch_scope, stored

#: Least share of a text's letters that its main language must have.
MIN_SHARE = 0.3

#: Percent of their shingles that near duplicates share.
ALIKE = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, without letters, or split among so many
    languages that none has three in ten of them. Ids may be null or repeat. If there is
    nothing to learn from, no text has a language."""
    learn = docs.where(~language_id.held_out("doc_id")).select("text", "lang").where("text is not null and lang is not null")
    row = docs.select(F.struct("*").alias("row"), "text")
    found = language_id.identify(row, language_id.fit(learn))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_SHARE)).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines and of single long lines; texts of which
    nothing is left go. Null texts and rows without an id stay as they are; of an id's
    different texts each is a document of its own."""
    found = line_dedup.dedup_lines(docs, alone=line_dedup.LONG)
    left = found.withColumn("row", F.when(F.col("runs").isNull(), F.col("row")).otherwise(F.col("row").withField("text", F.col("kept"))))
    empty = F.col("runs").isNotNull() & (F.length(F.trim("kept")) == 0)
    out = left.where(~empty).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component. Null and blank texts and
    rows without an id stay; rows that repeat an id stay if one of them does."""
    found = near_dedup.near_duplicates(docs, percent=ALIKE).where("doc_id is not null")
    gone = stored(found.groupBy(F.col("doc_id").alias("id")).agg(F.max("kept").alias("kept")).where("not kept").select("id"), "near-gone")
    # Only documents that may go meet the list of those that do.
    marked = sieve.sieved(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id")), sieve.sieve(gone), F.col("id"))
    maybe = marked.where("met").join(gone, "id", "left_anti")
    return marked.where("not met").select("row").unionByName(maybe.select("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark; null and empty texts stay."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left; see ``mixing.mix_sources``."""
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL can't express the first, third and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
