"""Categories of any number of levels as one number each: how often rows of a level went on.

A level's code is its rate, drawn towards the rate of all rows by as much as a prior of some
rows weighs. A row that a model is trained on gets the code of the other folds, so that its
own label is in none of its features; a row to be scored gets the code of all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.functions.scalars import is_blank
from funnelforge.session import stored

#: Folds, rows that the prior weighs, and the fewest rows of a level of its own.
FOLDS, PRIOR, LEAST = 5, 20.0, 50
RARE, MISSING = "__RARE__", "<missing>"

TABLE = "col string, level string, n long, code double, outs array<double>"


def fold_of(row_id: Column, folds: int = FOLDS) -> Column:
    """The fold that a row's id belongs to."""
    return (F.conv(F.substring(F.md5(row_id.cast("string")), 1, 6), 16, 10).cast("int") % folds).cast("int")


def level_of(c: str) -> Column:
    """A cell's level; blank cells are one."""
    v = F.col(c).cast("string")
    return F.when(is_blank(v), MISSING).otherwise(v)


@dataclass
class Levels:
    """The coded columns and their pinned table; unseen levels share the code of rare ones."""

    columns: list[str]
    table: DataFrame
    rare: dict[str, float]
    rare_outs: dict[str, list[float]]

    def coded(self, df: DataFrame, fold: Column | None = None) -> DataFrame:
        """Adds ``<column>__rate``: the code, or with ``fold`` the one of the other folds. Levels
        are joined a column at a time, as many as they are; Spark picks how."""
        out = df if fold is None else df.withColumn("_fold", fold)
        for c in self.columns:
            own = self.table.where(F.col("col") == c).select(F.col("level").alias("_level"), F.col("code").alias("_code"), F.col("outs").alias("_outs"))
            out = out.join(own, level_of(c) == F.col("_level"), "left")
            if fold is None:
                rate = F.coalesce("_code", F.lit(self.rare[c]))
            else:
                outs = F.coalesce("_outs", F.array(*map(F.lit, self.rare_outs[c])))
                rate = F.get(outs, F.col("_fold"))
            out = out.withColumn(f"{c}__rate", rate).drop("_level", "_code", "_outs")
        return out if fold is None else out.drop("_fold")


def statistics(rows: DataFrame, columns: list[str], fold: Column, folds: int = FOLDS, prior: float = PRIOR, least: int = LEAST) -> DataFrame:
    """M1: (col, level, n, code, outs): the smoothed rate of ``y`` for each level, of all rows and
    without each fold's. Levels of fewer than ``least`` rows are one, which is always there.

    Rows are first added up by level and fold; what is shuffled after that is of the size of
    the levels.
    """
    long = rows.select(fold.alias("fold"), F.col("y").cast("long").alias("y"), *(level_of(c).alias(c) for c in columns)).unpivot(["fold", "y"], columns, "col", "level")
    cells = stored(long.groupBy("col", "level", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")), "level-cells")
    sizes = cells.groupBy("col", "level").agg((F.sum("n") < least).alias("few"))
    none = cells.sparkSession.createDataFrame([(c, RARE, 0, 0, 0) for c in columns], "col string, level string, fold int, n long, p long")
    named = cells.join(sizes, ["col", "level"]).select("col", F.when(F.col("few"), RARE).otherwise(F.col("level")).alias("level"), "fold", "n", "p").unionByName(none)
    by_fold = named.groupBy("col", "level", "fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    levels = by_fold.groupBy("col", "level").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.collect_list(F.struct("fold", "n", "p")).alias("own"))  # a struct a fold
    whole = cells.groupBy("col", "fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    whole = whole.groupBy("col").agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"), F.collect_list(F.struct("fold", "n", "p")).alias("all_own"))
    met = levels.join(F.broadcast(whole), "col", "left")  # a row a column

    def held(own: Column, k: Column, part: str) -> Column:
        return F.aggregate(F.filter(own, lambda s: s["fold"] == k), F.lit(0).cast("long"), lambda a, s: a + s[part])

    def code(n: Column, p: Column, all_n: Column, all_p: Column) -> Column:
        base = F.coalesce(F.try_divide(all_p, all_n), F.lit(0.5))
        return (p + prior * base) / (n + prior)

    outs = F.transform(
        F.sequence(F.lit(0), F.lit(folds - 1)),
        lambda k: code(
            F.col("n") - held(F.col("own"), k, "n"), F.col("p") - held(F.col("own"), k, "p"),
            F.coalesce(F.col("all_n"), F.lit(0)) - F.coalesce(held(F.col("all_own"), k, "n"), F.lit(0)), F.coalesce(F.col("all_p"), F.lit(0)) - F.coalesce(held(F.col("all_own"), k, "p"), F.lit(0)),
        ),
    )
    return met.select("col", "level", "n", code(F.col("n"), F.col("p"), F.col("all_n"), F.col("all_p")).alias("code"), outs.alias("outs"))


def pinned(table: DataFrame, columns: list[str]) -> Levels:
    """The levels of a table of ``statistics``."""
    own = {r["col"]: r for r in table.where(F.col("level") == RARE).collect()}  # a row a column
    return Levels(columns, table, {c: own[c]["code"] for c in columns}, {c: list(own[c]["outs"]) for c in columns})


def fit_levels(rows: DataFrame, columns: list[str], id_col: str, **how) -> Levels:
    """M1: the levels of a training table with ``y``."""
    return pinned(stored(statistics(rows, columns, fold_of(F.col(id_col)), **how), "levels"), columns)
