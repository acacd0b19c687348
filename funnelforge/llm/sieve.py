"""A filter of fixed size over keys, so that rows without a partner need no shuffle.

Each key sets one of 2**25 bits; a row whose bit is not set surely has no partner, and
stays where it is. The bits are 4 MB whatever the number of keys, so they are broadcast.
Where keys are so many that most bits are set, most rows are moved as without a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.session import stored

BITS = 1 << 25


def _slot(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def sieve(keys: DataFrame) -> DataFrame:
    """(bucket, bits): the bits that the rows of ``keys`` set."""
    slots = keys.select(_slot([keys[c] for c in keys.columns]).alias("slot")).distinct()
    # Dealt by bucket first, so that each bitmap is made in one task and none is shuffled.
    dealt = slots.select(F.bitmap_bucket_number("slot").alias("bucket"), F.bitmap_bit_position("slot").alias("at")).repartition("bucket")
    return stored(dealt.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "sieve")


def sieved(df: DataFrame, held: DataFrame, *keys: Column, name: str = "met") -> DataFrame:
    """``df`` with the boolean column ``name``: false where the sieve ``held`` surely lacks
    the row's keys, which are in the order of its columns."""
    bits = F.broadcast(held.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))  # 1024 rows of 4 KB at most
    rows = df.withColumn("_slot", _slot(list(keys)))
    found = rows.join(bits, F.bitmap_bucket_number("_slot") == F.col("_bucket"), "left")
    at = F.bitmap_bit_position("_slot").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn(name, F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop("_slot", "_bucket", "_bits")


def told_apart(docs: DataFrame, id_col: str, text_col: str, name: str = "h") -> DataFrame:
    """``docs`` with a number that tells rows of one id but different texts apart: a hash of
    the text for ids that may repeat, 0 for all others."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    held = sieve(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    found = sieved(docs, held, F.col(id_col), name="_again")
    return found.withColumn(name, F.when(F.col("_again"), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))).drop("_again")
