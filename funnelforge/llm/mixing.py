"""Mixing sources to target weights by entropy balancing.

Each document gets the rate r = min(cap, exp(lambda * size / scale)) of its source:
the exponential tilt that stays closest in entropy to taking every document once
while the source's words meet its target. The dual of each source is convex in its
lambda; Newton steps inside a shrinking bracket solve all sources at once, each step
one aggregation over (source, size) counts. Rates then become whole copies by error
diffusion along the sorted rows of small hash buckets of a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.session import stored

#: The weights that sources take in turn.
TURNS = (1.0, 2.0, 3.0)

#: Parts into which a source's documents are dealt where they meet its rate.
SALTS = 32


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    The sum of all sizes is shared by weight. A source's target stops at ``cap`` times
    its size; the excess is shared again by weight until none is above. The level at
    which the sharing ends is found by rounds of one small aggregation each: a source
    at its cap stays there, because the share per weight of the others only grows.
    """
    top = F.col("source_size") * cap
    totals = sources.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, before = 0.0, -1
    while True:
        full = F.col("weight") * level >= top
        got = sources.agg(
            F.sum(F.when(full, top)).alias("at_cap"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not got["free"] or got["n"] == before:
            break
        level, before = (totals - (got["at_cap"] or 0.0)) / got["free"], got["n"]
    return sources.withColumn("target", F.least(F.col("weight") * level, top).cast("double"))


def turn_weights(sources: DataFrame, source_col: str = "source") -> DataFrame:
    """Adds ``weight``: TURNS in turn over the sources by code point, null last.

    The rank is a count of smaller sources: sources are range-partitioned, numbered
    within a partition, and shifted by the sizes of the partitions before.
    """
    ordered = stored(
        sources.repartitionByRange(F.col(source_col).asc_nulls_last())
        .sortWithinPartitions(F.col(source_col).asc_nulls_last())
        .withColumn("_row", F.monotonically_increasing_id()),
        "mix-order",
    ).withColumns({"_part": F.shiftright("_row", 33), "_in": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = (
        parts.alias("a")
        .join(F.broadcast(parts.alias("b")), F.col("b._part") < F.col("a._part"), "left")  # one row per partition
        .groupBy(F.col("a._part").alias("_part"))
        .agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("_before"))
    )
    turn = (F.col("_before") + F.col("_in")) % len(TURNS)
    weight = reduce(lambda c, i: c.when(turn == i, TURNS[i]), range(1, len(TURNS)), F.when(turn == 0, TURNS[0]))
    return ordered.join(F.broadcast(before), "_part").withColumn("weight", weight).drop("_row", "_part", "_in", "_before")


def _exact_sum(c: Column) -> Column:
    """The sum in millionths, which no order of addition changes: reruns agree to the bit."""
    return F.sum(F.round(c * 1e6).cast("decimal(28,0)")).cast("double") / 1e6


def solve_tilts(sizes: DataFrame, sources: DataFrame, cap: float, steps: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """``sources`` with ``tilt``: null where every document is taken ``cap`` times.

    ``sizes``: (source, size, n) with size > 0. ``sources``: (source, source_size,
    target, scale). A source ends when its words are within ``tolerance`` of the
    target; the bracket halves whenever a Newton step would leave it. Raises if that
    takes more than ``steps`` rounds.
    """
    widest = math.log(cap) + 1.0
    state = sources.select(
        "source",
        F.col("target").cast("double").alias("target"),
        "scale",
        F.lit(0.0).alias("tilt"),
        (-F.lit(745.0) * F.col("scale") / F.col("smallest")).alias("low"),
        (F.lit(widest) * F.col("scale") / F.col("smallest")).alias("high"),
        (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full"),
        F.lit(False).alias("done"),
    )
    for _ in range(steps):
        state = stored(state, "mix-dual")
        open_ = state.where("not done and not full")
        if open_.isEmpty():
            break
        x = F.col("size") / F.col("scale")
        power = F.least(F.col("tilt") * x, F.lit(math.log(cap)))
        rate = F.exp(power)
        at = (
            sizes.join(open_, "source")
            .groupBy("source")
            .agg(
                _exact_sum(F.col("n") * F.col("size") * rate).alias("words"),
                _exact_sum(F.when(power < math.log(cap), F.col("n") * F.col("size") * x * rate)).alias("slope"),
            )
        )
        over = F.col("words") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(F.col("words") - F.col("target"), F.col("slope"))
        near = F.abs(F.col("words") - F.col("target")) <= tolerance * F.col("target")
        moved = state.join(at, "source", "left")
        idle = F.col("words").isNull()
        state = moved.select(
            "source",
            "target",
            "scale",
            F.when(idle | near, F.col("tilt"))
            .when((newton > low) & (newton < high), newton)
            .otherwise((low + high) / 2)
            .alias("tilt"),
            F.when(idle, F.col("low")).otherwise(low).alias("low"),
            F.when(idle, F.col("high")).otherwise(high).alias("high"),
            "full",
            (F.col("done") | F.coalesce(near, F.lit(False))).alias("done"),
        )
    else:
        raise ArithmeticError(f"sources are not at their targets after {steps} steps")
    return state.select("source", F.when(~F.col("full"), F.col("tilt")).alias("tilt"), "scale")


def _copies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``taken`` to rows sorted by (bucket, falling size): whole copies whose words follow
    the rates' words. What a row is owed is carried to the next one of its bucket."""
    now, owed = None, 0.0
    for b in rows:
        taken = []
        for bucket, size, rate, cap in zip(*(b.column(c).to_pylist() for c in ("bucket", "size", "rate", "cap")), strict=True):
            if bucket != now:
                now, owed = bucket, 0.0
            owed += rate * size
            copies = min(cap, max(0, math.floor(owed / size + 0.5))) if size else 0
            owed -= copies * size
            taken.append(copies * size)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(taken, pa.int64())], [*b.schema.names, "taken"])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, bucket: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, rate, taken.

    ``taken`` counts the words that the mix takes, repeats included, at most ``cap``
    times the size. Null sources are one source, the last; null and blank texts have
    size 0 and are taken 0 times. A source without words has target 0. Rows that repeat
    an id are documents of their own, ordered by a hash of their text; equal rows get what
    any order of them gives. An empty table gives no rows; texts of any length count whole;
    other columns are not read. ``bucket`` is the mean number of documents whose rates are
    rounded together; a hot source only has more buckets.
    """
    rows = stored(
        docs.select(
            F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("name"), n_words(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit("mix"), id_col, text_col).alias("order"),
        ),
        "mix-rows",
    )
    named = rows.withColumn("source", F.struct(F.col("name").isNull().alias("none"), F.coalesce("name", F.lit("")).alias("name")))
    named = named.withColumn("source", F.concat(F.when(F.col("source.none"), "~").otherwise("-"), F.col("source.name")))
    sources = turn_weights(
        named.groupBy("source", "name").agg(
            F.sum("size").alias("source_size"),
            F.count(F.lit(1)).alias("docs"),
            F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"),
            F.max("size").alias("scale"),
        ),
        "name",
    )
    sources = stored(capped_targets(sources, cap), "mix-sources")
    sizes = stored(named.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    tilts = solve_tilts(sizes, sources.where("source_size > 0"), float(cap))
    # A row per source and salt: a hot source's documents are dealt to all salts.
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = sources.join(tilts.drop("scale"), "source", "left").select("source", "source_size", "target", "docs", "scale", "tilt", salt)
    known = stored(known, "mix-known")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), float(cap)).otherwise(
        F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(math.log(cap))))
    )
    salted = named.withColumn("salt", F.pmod("order", F.lit(SALTS)).cast("int"))
    at = F.pmod(F.shiftrightunsigned("order", 8), F.ceil(F.col("docs") / bucket))
    rated = salted.join(known, ["source", "salt"]).select("id", "name", "size", "order", rate.alias("rate"), F.lit(cap).alias("cap"), F.xxhash64("source", at).alias("bucket"), "source_size", "target")
    dealt = rated.repartition("bucket").sortWithinPartitions("bucket", F.desc("size"), "order", "id")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    done = dealt.mapInArrow(_copies, f"{kind}, taken long")
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("name").alias(source_col), "size", "source_size", "target", "rate", "taken")
