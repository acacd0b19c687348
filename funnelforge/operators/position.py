"""Positions and running sums over any order, without one task that holds all rows.

Rows are range-partitioned by group and order; each partition sums on its own, and the
totals of the partitions before it in the same group are added. A group of any size is
spread over many partitions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelforge.session import stored


def ranged(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` written range by range, with ``_pid`` growing along the order."""
    return stored(df.repartitionByRange(*map(F.col, group), *order).withColumn("_pid", F.spark_partition_id()), "ranged")


def cumulative(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds each of ``sums``: the sum of its column over the rows before, in ``order``
    within ``group``. The order must be total, or equal rows get any order."""
    names = list(sums)
    rows = ranged(df.withColumns({f"_v_{n}": c for n, c in sums.items()}), group, order)
    inside = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and partition.
    totals = rows.groupBy(*group, "_pid").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_pid").alias("_p"), *(F.coalesce(F.sum(f"_t_{n}").over(before), zero).alias(f"_o_{n}") for n in names))
    local = rows.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), zero) for n in names})
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group), F.col("_pid") == F.col("_p"))
    met = local.join(offsets, same)
    return met.select(*df.columns, *((F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names))


def ordered_position(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Adds the row's position from 1 in ``order`` within ``group``."""
    return cumulative(df, group, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)


def matched(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``other``, joined on ``keys``; null keys are equal."""
    named = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return df.join(named, same, how).drop(*(f"_k_{k}" for k in keys))


def top_per(df: DataFrame, group: list[str], order: list[Column], n: int, key: str, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank, in two rounds: first per salt of
    ``key``, so that no task sees more of a large group than its share."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    first = Window.partitionBy(*group, "_salt").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    few = salted.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n)
    return few.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= n).drop("_salt")


def quantiles(values: DataFrame, group: list[str], value: str, n: str, points: tuple[float, ...]) -> DataFrame:
    """(group, point, quantile) of a (group, value, n) table, linear between neighbours."""
    placed = cumulative(values, group, [F.col(value)], {"_before": F.col(n)})
    total = values.groupBy(*group).agg(F.sum(n).alias("_total"))
    met = matched(placed, total, group) if group else placed.crossJoin(F.broadcast(total))  # one row
    inside = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col(n))
    where = F.array(*(F.struct(F.lit(p).alias("point"), (F.lit(p) * (F.col("_total") - 1)).alias("at")) for p in points))
    # A value is taken to the points that fall on it, mostly none.
    own = F.filter(where, lambda w: inside(F.floor(w["at"])) | inside(F.ceil(w["at"])))
    hits = met.withColumn("w", F.explode(own)).select(*group, value, "w.point", F.col("w.at").alias("at"), inside(F.floor("w.at")).alias("_low"), inside(F.ceil("w.at")).alias("_high"))
    ends = hits.groupBy(*group, "point", "at").agg(F.max(F.when(F.col("_low"), F.col(value))).alias("lo"), F.max(F.when(F.col("_high"), F.col(value))).alias("hi"))
    return ends.select(*group, "point", (F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo"))).alias("quantile"))
