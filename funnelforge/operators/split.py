"""Train/test splits that depend only on a row's id, and what is reported of them.

Rows are ordered by md5 of seed and id, so a split does not depend on partitioning.
A split is a table (row_id, side); ids must be unique and not null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelforge.functions.scalars import timestamp
from funnelforge.operators.position import ordered_position
from funnelforge.session import stored
from funnelforge.sources.bucketed import load_bucketed, save_bucketed

RARE, MISSING = "__RARE__", "<missing>"
SHIFT = 0.30


def shuffle_key(row_id: str | Column, seed: int) -> Column:
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws("|", F.lit(str(seed)), c.cast("string")))


def check_ids(df: DataFrame, id_col: str) -> DataFrame:
    """One row of n, n_null, n_repeated."""
    per = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("k"))
    null = F.col(id_col).isNull()
    return per.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(null, F.col("k"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(~null & (F.col("k") > 1), F.col("k") - 1)), F.lit(0)).alias("n_repeated"),
    )


def _sides(df: DataFrame, id_col: str, test: Column) -> DataFrame:
    return df.select(F.col(id_col).alias("row_id"), F.when(test, "test").otherwise("train").alias("side"))


def random_split(df: DataFrame, id_col: str, size: float = 0.2, seed: int = 42) -> DataFrame:
    """The first round(n * size) rows by hash are the test side."""
    placed = ordered_position(df.select(id_col).withColumn("_h", shuffle_key(id_col, seed)), [], [F.col("_h"), F.col(id_col)], "_p")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    take = F.least(F.greatest(F.bround(F.col("_n") * size), F.lit(0)), F.col("_n"))
    return _sides(placed.crossJoin(F.broadcast(n)), id_col, F.col("_p") <= take)  # one row


def stratified_split(df: DataFrame, id_col: str, strata: list[str], size: float = 0.2, seed: int = 42) -> DataFrame:
    """X1 within each joint key; keys of one row are one stratum; a stratum keeps a row
    on each side, and a single row is for training."""
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in strata))
    rows = df.select(F.col(id_col), key.alias("_key"))
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_k"))
    sizes = sizes.withColumn("_s", F.when(F.col("_k") < 2, RARE).otherwise(F.col("_key")))
    n = sizes.groupBy("_s").agg(F.sum("_k").alias("_n"))
    known = sizes.join(n, "_s").select("_key", "_s", "_n")
    named = rows.join(known, "_key").withColumn("_h", shuffle_key(id_col, seed))
    placed = ordered_position(named, ["_s"], [F.col("_h"), F.col(id_col)], "_p")
    take = F.when(F.col("_n") < 2, 0).otherwise(F.least(F.greatest(F.bround(F.col("_n") * size), F.lit(1)), F.col("_n") - 1))
    return _sides(placed, id_col, F.col("_p") <= take)


def temporal_split(df: DataFrame, id_col: str, ts_col: str, cutoff: str, day_first: bool = True) -> DataFrame:
    """At or after the cutoff is test; null is train; a text that is no date raises."""
    c = F.col(ts_col)
    if dict(df.dtypes)[ts_col] == "string":
        parsed = timestamp(c, day_first)
        c = F.when(c.isNull(), F.lit(None).cast("timestamp")).when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("no date: "), c)).cast("timestamp"))
    return _sides(df, id_col, F.coalesce(c >= F.lit(cutoff).cast("timestamp"), F.lit(False)))


def period_split(df: DataFrame, id_col: str, period_col: str, periods: list) -> DataFrame:
    """Rows of the listed periods are test."""
    return _sides(df, id_col, F.coalesce(F.col(period_col).isin(periods), F.lit(False)))


def grouped_split(df: DataFrame, id_col: str, group_col: str, size: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups go to one side; one group is all training; a null group raises."""
    g = F.coalesce(F.col(group_col).cast("string"), F.raise_error(F.lit(f"{group_col} is null")))
    rows = df.select(F.col(id_col), g.alias("_g"))
    groups = rows.select("_g").distinct()
    n = groups.agg(F.count(F.lit(1)).alias("_n"))
    placed = ordered_position(groups.withColumn("_h", shuffle_key("_g", seed)), [], [F.col("_h"), F.col("_g")], "_p").crossJoin(F.broadcast(n))  # one row
    take = F.when(F.col("_n") < 2, 0).otherwise(F.least(F.greatest(F.bround(F.col("_n") * size), F.lit(1)), F.col("_n") - 1))
    test = placed.where(F.col("_p") <= take).select("_g", F.lit(True).alias("_t"))
    return _sides(rows.join(test, "_g", "left"), id_col, F.coalesce("_t", F.lit(False)))


def composition(df: DataFrame, split: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(col, value, train_n, test_n, train_pct, test_pct); null is ``<missing>``."""
    sided = df.join(split, df[id_col] == split["row_id"]).select(*(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns), "side")
    counts = sided.unpivot(["side"], columns, "col", "value").groupBy("col", "value").agg(
        F.count(F.when(F.col("side") == "train", 1)).alias("train_n"), F.count(F.when(F.col("side") == "test", 1)).alias("test_n")
    )
    n = split.agg(F.count(F.when(F.col("side") == "train", 1)).alias("a"), F.count(F.when(F.col("side") == "test", 1)).alias("b"))
    met = counts.crossJoin(F.broadcast(n))  # one row
    pct = lambda k, of: F.coalesce(F.round(F.try_divide(100.0 * F.col(k), F.col(of)), 2), F.lit(0.0))
    return met.select("col", "value", "train_n", "test_n", pct("train_n", "a").alias("train_pct"), pct("test_n", "b").alias("test_pct"))


def base_rate_shift(df: DataFrame, split: DataFrame, id_col: str, target: Column) -> DataFrame:
    """(train_rate, test_rate, change, shifted): relative change above 30 %; where the
    training rate is 0, any positive rate is a shift."""
    sided = df.select(F.col(id_col).alias("row_id"), target.cast("double").alias("y")).join(split, "row_id")
    rates = sided.agg(F.avg(F.when(F.col("side") == "train", F.col("y"))).alias("train_rate"), F.avg(F.when(F.col("side") == "test", F.col("y"))).alias("test_rate"))
    change = F.try_divide(F.abs(F.col("test_rate") - F.col("train_rate")), F.col("train_rate"))
    moved = F.when(F.col("train_rate") == 0, F.col("test_rate") > 0).otherwise(change > SHIFT)
    return rates.select("train_rate", "test_rate", change.alias("change"), F.coalesce(moved, F.lit(False)).alias("shifted"))


def apply_split(df: DataFrame, split: DataFrame, id_col: str, side: str) -> DataFrame:
    """The rows of one side."""
    return df.join(split.where(F.col("side") == side).select(F.col("row_id").alias(id_col)), id_col, "left_semi")


def missing_ids(df: DataFrame, split: DataFrame, id_col: str) -> DataFrame:
    """Split ids that the data does not have; must be empty."""
    return split.join(df.select(F.col(id_col).alias("row_id")), "row_id", "left_anti").select("row_id", "side")


def split_check(df: DataFrame, split: DataFrame, id_col: str) -> DataFrame:
    """One row of overlap (ids on both sides) and uncovered (ids on none)."""
    sides = split.groupBy("row_id").agg(F.countDistinct("side").alias("k"))
    met = df.select(F.col(id_col).alias("row_id")).join(sides, "row_id", "left")
    return met.agg(F.count(F.when(F.col("k") > 1, 1)).alias("overlap"), F.count(F.when(F.col("k").isNull(), 1)).alias("uncovered"))


#: Strategies of ``split_dataset`` and what each needs.
STRATEGIES = {"random": (), "stratified": ("strata",), "temporal": ("ts_col", "cutoff"), "period": ("period_col", "periods"), "grouped": ("group_col",)}


@dataclass
class Split:
    """A split with what is reported of it."""

    ids: DataFrame
    strategy: str
    rows: dict[str, int]
    composition: DataFrame | None
    warnings: list[str]


def split_dataset(df: DataFrame, id_col: str, strategy: str = "random", size: float = 0.2, seed: int = 42, target: Column | None = None, columns: list[str] | None = None, **how) -> Split:
    """Checks, splits by ``strategy``, and reports composition and warnings in one call.

    ``how`` holds what the strategy needs (see STRATEGIES). Raises for an unknown strategy,
    a size outside (0, 1), missing settings or columns, an empty table, and ids that are
    null or repeat. ``target`` is a 0/1 column whose rate is compared between the sides;
    ``columns`` (by default the strata) are those whose values are counted per side.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    if not 0 < size < 1:
        raise ValueError(f"size must lie between 0 and 1, not {size}")
    lacking = [k for k in STRATEGIES[strategy] if not how.get(k)]
    if lacking:
        raise ValueError(f"{strategy} needs {', '.join(lacking)}")
    wanted = [id_col, *how.get("strata", []), *(how[k] for k in ("ts_col", "period_col", "group_col") if k in how), *(columns or [])]
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    ids = check_ids(df, id_col).first()
    if not ids["n"]:
        raise ValueError("nothing to split")
    if ids["n_null"] or ids["n_repeated"]:
        raise ValueError(f"{ids['n_null']} ids are null and {ids['n_repeated']} repeat")
    kinds = {"random": random_split, "stratified": stratified_split, "temporal": temporal_split, "period": period_split, "grouped": grouped_split}
    more = {} if strategy in ("temporal", "period") else {"size": size, "seed": seed}
    split = stored(kinds[strategy](df, id_col, **how, **more), "split")
    rows = {"train": 0, "test": 0} | {r["side"]: r["count"] for r in split.groupBy("side").count().collect()}
    warnings = [f"{side} is empty" for side, n in rows.items() if not n]
    if target is not None:
        shift = base_rate_shift(df, split, id_col, target).first()
        if shift["shifted"]:
            warnings.append(f"base rate {shift['train_rate']:.4f} in training and {shift['test_rate']:.4f} in test")
    if strategy == "stratified":
        keys = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in how["strata"]]
        rare = df.groupBy(*(k.alias(f"k{i}") for i, k in enumerate(keys))).count().where("count < 2").count()
        if rare:
            warnings.append(f"{rare} strata of one row are one stratum")
    shown = columns if columns is not None else how.get("strata", [])
    return Split(split, strategy, rows, composition(df, split, id_col, shown) if shown else None, warnings)


def save_split(split: Split, path: str, buckets: int | None = None) -> None:
    """Writes the ids of both sides, which are what makes a split repeatable, and its
    summary; a path that exists raises. With ``buckets``, ids are dealt to so many by
    row_id: applied to a dataset that is dealt so by the same type of id, no row moves."""
    spark = split.ids.sparkSession
    if buckets:
        save_bucketed(split.ids, f"{path}/ids", "row_id", buckets)
    else:
        split.ids.write.mode("errorifexists").parquet(f"{path}/ids")
    summary = json.dumps({"strategy": split.strategy, "rows": split.rows, "warnings": split.warnings, "buckets": buckets})
    spark.createDataFrame([(summary,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/summary")


def load_split(spark: SparkSession, path: str) -> Split:
    """What ``save_split`` wrote; the composition is not kept."""
    found = json.loads(spark.read.text(f"{path}/summary").first()["value"])
    ids = load_bucketed(spark, f"{path}/ids") if found.get("buckets") else spark.read.parquet(f"{path}/ids")
    return Split(ids, found["strategy"], found["rows"], None, found["warnings"])
