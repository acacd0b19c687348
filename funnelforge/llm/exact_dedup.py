"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

DataFrame functions only. One scan writes a narrow table with the length, the hash
of a prefix and the digest of each normalised text; no text is shuffled. Rows of a
length that no other row has leave first, then those whose prefix is alone in its
length; only what is left is grouped by the full digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.session import stored


def normalised(text: Column) -> Column:
    """Each run of white space is one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    The group's smallest id stays. Null texts are empty texts and so copies of each
    other. A null id sorts after all others and is kept only in a group without ids.
    Rows that repeat an id count in group_size and are all kept or all dropped.
    An empty table gives no rows; other columns of ``docs`` are not read.
    """
    text = normalised(F.col(text_col))
    rows = stored(
        docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
            "id",
            F.octet_length("t").alias("bytes"),
            F.xxhash64(F.substring("t", 1, prefix)).alias("prefix_hash"),
            F.unhex(F.sha2("t", 256)).alias("sha"),
        ),
        "exact-rows",
    )
    # Each level's keys are a table of their own: a join with a key that a third of all
    # rows have is then one that Spark can split.
    several = F.col("n") > 1
    lengths = stored(rows.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).where(several).select("bytes"), "exact-lengths")
    by_prefix = rows.join(lengths, "bytes", "left_semi")
    prefixes = stored(by_prefix.groupBy("bytes", "prefix_hash").agg(F.count(F.lit(1)).alias("n")).where(several).drop("n"), "exact-prefixes")
    rest = by_prefix.join(prefixes, ["bytes", "prefix_hash"], "left_semi")
    groups = rest.groupBy("bytes", "prefix_hash", "sha").agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("keep_id"))
    groups = stored(groups.where(F.col("group_size") > 1), "exact-groups")
    found = rows.join(groups, ["bytes", "prefix_hash", "sha"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no row with a smaller id has, all columns kept,
    whatever their names."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"))
    return rows.join(kept, F.col("own").eqNullSafe(F.col("id")), "left_semi").select("row.*")
