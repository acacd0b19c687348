"""Features derived from single columns, and reports over funnels and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.functions.scalars import duration_band, duration_months, is_blank, slug, timestamp, trimmed
from funnelforge.operators.position import quantiles
from funnelforge.operators.profile import components_of

#: Edges of days since creation.
DAY_BINS = (0, 7, 14, 30, 60, 90)


def temporal_features(df: DataFrame, column: str, day_first: bool = True) -> DataFrame:
    """Month, day of week (Monday 0), hour, weekend, day and week of month; null where
    the text is no date."""
    c = F.col(column)
    t = timestamp(c, day_first) if dict(df.dtypes)[column] == "string" else c
    p = f"{column}_"
    rows = df.withColumn("_t", t)
    t = F.col("_t")
    day = F.dayofmonth(t)
    return rows.withColumns(
        {
            p + "month": F.month(t), p + "day_of_week": F.weekday(t), p + "hour": F.hour(t),
            p + "is_weekend": (F.weekday(t) >= 5).cast("int"), p + "day_of_month": day, p + "week_of_month": (F.floor((day - 1) / 7) + 1).cast("int"),
        }
    ).drop("_t")


def parse_report(df: DataFrame, column: str, parsed: Column) -> DataFrame:
    """One row of parsed and unparsed counts over solid values."""
    full = ~is_blank(F.col(column).cast("string"))
    return df.agg(F.count(F.when(full & parsed.isNotNull(), 1)).alias("parsed"), F.count(F.when(full & parsed.isNull(), 1)).alias("unparsed"))


def level_of(column: str, order: list[str], mapping: dict[str, str] | None = None) -> Column:
    """The position in ``order`` of a value's stage; null for blanks and unmapped values."""
    v = trimmed(F.col(column))
    pairs = (mapping or {s: s for s in order}).items()
    chain = reduce(lambda w, p: w.when(v == p[0], order.index(p[1])), pairs, F.when(F.lit(False), 0))
    return chain.cast("int")


def funnel_stages(df: DataFrame, column: str, order: list[str], mapping: dict[str, str] | None = None) -> DataFrame:
    """The stage and K-1 cumulative flags reached_<stage>, null for unmapped values."""
    level = level_of(column, order, mapping)
    rows = df.withColumn("_level", level)
    stage = F.element_at(F.array(*map(F.lit, order)), F.col("_level") + 1)
    flags = {f"reached_{slug(s)}": F.when(F.col("_level").isNotNull(), (F.col("_level") >= k).cast("double")) for k, s in enumerate(order) if k}
    return rows.withColumns({f"{column}_stage": F.when(F.col("_level").isNotNull(), stage), **flags}).drop("_level")


def funnel_report(df: DataFrame, column: str, order: list[str], mapping: dict[str, str] | None = None) -> DataFrame:
    """(kind, value, n): rows per stage, and unmapped values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(~is_blank(F.col(column))).withColumn("_level", level_of(column, order, mapping))
    stage = F.when(F.col("_level").isNotNull(), F.element_at(F.array(*map(F.lit, order)), F.col("_level") + 1))
    named = counts.select(F.when(stage.isNotNull(), "stage").otherwise("unmapped").alias("kind"), F.coalesce(stage, trimmed(F.col(column))).alias("value"), "n")
    return named.groupBy("kind", "value").agg(F.sum("n").alias("n"))


def funnel_summary(df: DataFrame, column: str, order: list[str], mapping: dict[str, str] | None = None) -> DataFrame:
    """(level, stage, reached, pass_through, degenerate); unmapped rows are left out."""
    levels = df.select(level_of(column, order, mapping).alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    one = levels.agg(*(F.coalesce(F.sum(F.when(F.col("k") >= k, F.col("n"))), F.lit(0)).alias(f"s{k}") for k in range(len(order))))
    stages = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(s).alias("stage"), F.col(f"s{k}").alias("reached"), (F.col(f"s{k - 1}") if k else F.lit(None).cast("long")).alias("before")) for k, s in enumerate(order))))
    rate = F.try_divide("reached", "before")
    return one.select(stages.alias("x")).select("x.*").select("level", "stage", "reached", rate.alias("pass_through"), F.coalesce((F.col("reached") < 50) | (rate > 0.95), F.lit(False)).alias("degenerate"))


def stage_rows(df: DataFrame, column: str, order: list[str], stage: int, mapping: dict[str, str] | None = None) -> DataFrame:
    """The rows that reached ``stage``, with y = 1 where they went further."""
    return df.withColumn("_level", level_of(column, order, mapping)).where(F.col("_level") >= stage).withColumn("y", (F.col("_level") > stage).cast("int")).drop("_level")


def stage_summary(df: DataFrame, column: str, order: list[str], mapping: dict[str, str] | None = None, least: int = 50) -> DataFrame:
    """(stage, n_rows, n_positive, sparse) of all K-1 stages in one pass."""
    return stage_sizes(df.select(level_of(column, order, mapping).alias("k")), len(order), least)


def stage_sizes(rows: DataFrame, n_levels: int, least: int = 50) -> DataFrame:
    """A32 of rows whose level is ``k``."""
    levels = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    stages = levels.select("k", "n", F.explode(F.sequence(F.lit(0), F.lit(n_levels - 2))).alias("stage")).where("k >= stage")
    found = stages.groupBy("stage").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("k") > F.col("stage"), F.col("n"))), F.lit(0)).alias("n_positive"))
    return found.withColumn("sparse", F.col("n_positive") < least)


def level_check(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(value, kind): levels of the data that are not configured, and the reverse."""
    data = df.select(trimmed(F.col(column)).alias("value")).where(~is_blank(F.col("value"))).distinct()
    known = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, order))).alias("value"))
    return data.exceptAll(known).withColumn("kind", F.lit("not configured")).unionByName(known.exceptAll(data).withColumn("kind", F.lit("not in data")))


def top_components(df: DataFrame, column: str, delimiter: str = ";", n: int = 10) -> DataFrame:
    """K2: (component, n) of the most frequent parts of cells, then by name."""
    parts = df.select(F.explode(components_of(F.col(column), delimiter)).alias("component")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return parts.orderBy(F.desc("n"), F.asc("component")).limit(n)


def normalize_multi_valued(df: DataFrame, column: str, delimiter: str = ";", n: int = 10) -> DataFrame:
    """D3: the sorted rejoined cell, its number of parts, and has_<part> for the n most
    frequent parts; null for blank cells. The n parts are read first."""
    top = [r["component"] for r in top_components(df, column, delimiter, n).collect()]
    blank = is_blank(F.col(column))
    rows = df.withColumn("_parts", F.when(~blank, F.array_sort(components_of(F.col(column), delimiter))))
    flags = {f"has_{slug(p)}": F.array_contains("_parts", p) for p in top}
    return rows.withColumns({f"{column}_normalized": F.array_join("_parts", f"{delimiter} "), f"{column}_count": F.when(~blank, F.size("_parts")), **flags}).drop("_parts")


def duration_features(df: DataFrame, column: str) -> DataFrame:
    """<column>_months and <column>_band."""
    rows = df.withColumn(f"{column}_months", duration_months(F.col(column)))
    return rows.withColumn(f"{column}_band", duration_band(F.col(f"{column}_months")))


def apply_merges(df: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """Replaces confirmed variants (variant, canonical) of a column; blanks stay.

    The merges join by value; Spark broadcasts them where they are small.
    """
    m = merges.select(F.col("variant").alias("_variant"), F.col("canonical").alias("_canonical"))
    met = df.join(m, F.col(column) == F.col("_variant"), "left")
    value = F.when(is_blank(F.col(column)), F.col(column)).otherwise(F.coalesce("_canonical", column))
    return met.select(*(value.alias(c) if c == column else F.col(c) for c in df.columns))


def outcome_by_age(df: DataFrame, created: Column, target: Column, as_of: str) -> DataFrame:
    """(bin, n, rate): outcome rate by whole days since creation."""
    # By microseconds: a part of a second short of a day is no day.
    micros = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    days = F.floor(micros / 86_400_000_000)
    edges = DAY_BINS
    label = lambda k: f"[{edges[k]},{edges[k + 1]})" if k + 1 < len(edges) else f"[{edges[k]},inf)"
    chain = F.when(days < 0, F.lit(None).cast("string"))
    for k in range(len(edges) - 1):
        chain = chain.when(days < edges[k + 1], label(k))
    rows = df.select(F.when(days.isNotNull(), chain.otherwise(label(len(edges) - 1))).alias("bin"), target.cast("double").alias("y"))
    return rows.where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))


def feature_profile(df: DataFrame, flag: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(flag, feature, count, mean, median, n_distinct), one row a feature and side."""
    nums = df.select(flag, *(F.col(c).cast("double").alias(c) for c in numeric)).unpivot([flag], numeric, "feature", "v").where("v is not null")
    counted = nums.groupBy(flag, "feature", "v").agg(F.count(F.lit(1)).alias("n"))
    med = quantiles(counted, [flag, "feature"], "v", "n", (0.5,)).select(flag, "feature", F.col("quantile").alias("median"))
    base = counted.groupBy(flag, "feature").agg(F.sum("n").alias("count"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    left = base.join(med, [flag, "feature"]).select(flag, "feature", "count", "mean", "median", F.lit(None).cast("long").alias("n_distinct"))
    cats = df.select(flag, *(F.col(c).cast("string").alias(c) for c in categorical)).unpivot([flag], categorical, "feature", "v").where("v is not null")
    right = cats.groupBy(flag, "feature").agg(F.count(F.lit(1)).alias("count"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("median"), F.countDistinct("v").alias("n_distinct"))
    return left.unionByName(right)


def signal_by_quartile(df: DataFrame, value: str, target: Column) -> DataFrame:
    """(bucket, n, rate) over quartiles, equal edges dropped, closed on the right."""
    rows = df.select(F.col(value).cast("double").alias("v"), target.cast("double").alias("y")).where("v is not null")
    counted = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.count("y").alias("k"))
    q = quantiles(counted.select("v", "n"), [], "v", "n", (0.0, 0.25, 0.5, 0.75, 1.0))
    edges = q.agg(F.array_sort(F.collect_set("quantile")).alias("e"))
    met = counted.crossJoin(F.broadcast(edges))  # one row
    above = F.size(F.filter("e", lambda e: e < F.col("v")))
    bucket = F.greatest(above, F.lit(1)).cast("long")
    return met.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), (F.sum("y") / F.sum("k")).alias("rate"))


def signal_by_category(df: DataFrame, value: str, target: Column, top: int = 20) -> DataFrame:
    """(category, n, rate) of the categories with the highest rates."""
    rows = df.select(F.col(value).alias("category"), target.cast("double").alias("y")).where("category is not null")
    found = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    return found.orderBy(F.desc("rate"), F.asc("category")).limit(top)

