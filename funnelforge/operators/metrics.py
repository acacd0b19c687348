"""Ranking metrics of scored rows: AUC, tiers, lift, capture, calibration.

All take (row_id, y, score) with y 0 or 1, and optional group columns, so that several
stages are measured in one pass. Rows with a null y or score are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.operators.position import cumulative, matched

#: Log-loss clip, tiers, capture shares, gates.
CLIP = 1e-15
TIERS = 10
CAPTURE = (0.60, 0.65, 0.70, 0.75)
SPARSE_BOTTOM, RESAMPLES = 20, 2000
#: Resamples that are drawn at once.
DRAWS = 250


def _clean(scored: DataFrame) -> DataFrame:
    return scored.where("y is not null and score is not null")


def roc_auc(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, auc), ties at average rank; null where a class is missing.

    Rows first collapse to one per distinct score.
    """
    group = group or []
    tied = _clean(scored).groupBy(*group, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    placed = cumulative(tied, group, [F.col("score")], {"below": F.col("neg")})
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return placed.groupBy(*group).agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def ordered(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Adds position (1 is the highest score, ties by row_id), positives up to the row, and
    the group's rows and positives; the basis of W2 to W7. A null group is a group."""
    group = group or []
    rows = _clean(scored)
    placed = cumulative(rows, group, [F.desc("score"), F.asc("row_id")], {"position": F.lit(1).cast("long"), "hits": F.col("y").cast("long")})
    placed = placed.withColumns({"position": F.col("position") + 1, "hits": F.col("hits") + F.col("y")})
    totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.sum("y").cast("long").alias("positives"))
    return matched(placed, totals, group) if group else placed.crossJoin(F.broadcast(totals))  # one row


def pr_auc(placed: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, average_precision) of ``ordered`` rows."""
    each = F.when(F.col("y") == 1, F.col("hits") / F.col("position"))
    return placed.groupBy(*(group or [])).agg(F.try_divide(F.sum(each), F.max("positives")).alias("average_precision"))


def tier_of(position: Column, rows: Column, k: int) -> Column:
    """Which of k near-equal slices a position is in."""
    return F.floor((position * k + rows - 1) / rows).cast("long")


def tier_table(placed: DataFrame, k: int = TIERS, group: list[str] | None = None) -> DataFrame:
    """Per tier its rows, positives, actual rate, share of positives in percent,
    mean score, and calibration gap in percentage points."""
    group = group or []
    tiers = placed.groupBy(*group, tier_of(F.col("position"), F.col("rows"), k).alias("tier"))
    found = tiers.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_positive"), F.avg("y").alias("actual_rate"),
        F.try_divide(100.0 * F.sum("y"), F.max("positives")).alias("captured_pct"), F.avg("score").alias("avg_score"),
    )
    return found.withColumn("gap_pp", 100 * (F.col("avg_score") - F.col("actual_rate")))


def tier_cutoffs(placed: DataFrame, k: int = TIERS, group: list[str] | None = None) -> DataFrame:
    """(group, boundary, cutoff): the score with which each tier after the first begins."""
    at = F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("boundary")
    hits = placed.select(*(group or []), "position", "rows", "score", at)
    return hits.where(F.col("position") == F.floor(F.col("boundary") * F.col("rows") / k) + 1).select(*(group or []), "boundary", F.col("score").alias("cutoff"))


def assign_tier(score: Column, cutoffs: list[float]) -> Column:
    """1 for scores above all of the pinned cutoffs; null scores have no tier."""
    below = sum((F.when(score >= c, 1).otherwise(0) for c in cutoffs), F.lit(0))
    return F.when(score.isNotNull(), F.lit(len(cutoffs) + 1) - below)


def lift(tiers: DataFrame, k: int = TIERS, group: list[str] | None = None) -> DataFrame:
    """(group, base_rate, top_rate, bottom_rate, lift, ratio, status)."""
    top, bottom = F.col("tier") == 1, F.col("tier") == k
    found = tiers.groupBy(*(group or [])).agg(
        (F.sum("n_positive") / F.sum("n")).alias("base_rate"), F.max(F.when(top, F.col("actual_rate"))).alias("top_rate"),
        F.max(F.when(bottom, F.col("actual_rate"))).alias("bottom_rate"),
    )
    zero = F.coalesce(F.col("bottom_rate") == 0, F.lit(False))
    return found.withColumns(
        {
            "lift": F.try_divide("top_rate", "base_rate"),
            "ratio": F.when(~zero, F.try_divide("top_rate", "bottom_rate")),
            "status": F.when(zero, "bottom tier has zero positives").otherwise("ok"),
        }
    )


def capture_thresholds(placed: DataFrame, shares: tuple[float, ...] = CAPTURE, group: list[str] | None = None) -> DataFrame:
    """(group, share, population_pct): how far down the ranking a share of positives is met."""
    share = F.explode(F.array(*map(F.lit, shares))).alias("share")
    rows = placed.where("positives > 0").select(*(group or []), "position", "hits", "rows", "positives", share)
    met = rows.where(F.col("hits") / F.col("positives") >= F.col("share"))
    return met.groupBy(*(group or []), "share").agg((100.0 * F.min("position") / F.max("rows")).alias("population_pct"))


def bootstrap_ratio(tiers: DataFrame, k: int = TIERS, resamples: int = RESAMPLES, seed: int = 7, group: list[str] | None = None) -> DataFrame:
    """(group, low, high): 95 % interval of the top to bottom ratio of each group whose
    bottom tier has few positives; no row for others, and none where every resample has an
    empty bottom. 0/1 labels make a resample's mean a binomial draw. Draws are dealt by group
    and part, and depend on these and the seed alone."""
    group = group or []
    ends = tiers.groupBy(*group).agg(
        *(F.max(F.when(F.col("tier") == t, F.col(c))).alias(f"{c}_{t}") for t in (1, k) for c in ("n", "n_positive"))
    ).where(F.col(f"n_positive_{k}") < SPARSE_BOTTOM)
    parts = F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // DRAWS))).alias("part")
    named = F.xxhash64(F.lit("group"), *group)
    rows = ends.select(F.struct(*group, named.alias("_h")).alias("g"), "n_1", "n_positive_1", f"n_{k}", f"n_positive_{k}", parts).repartition("g", "part")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).field("_h").to_pylist()
            out = []
            for h, n1, p1, n2, p2, part in zip(names, *(b.column(c).to_pylist() for c in range(1, 6)), strict=True):
                g, m = np.random.default_rng([seed, h & (2**64 - 1), part]), min(DRAWS, resamples - part * DRAWS)
                top, bottom = g.binomial(n1, p1 / n1, m) / n1, g.binomial(n2, p2 / n2, m) / n2
                out.append((top[bottom > 0] / bottom[bottom > 0]).tolist())
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["g", "ratios"])

    q = F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    drawn = rows.mapInArrow(draw, f"g {rows.schema['g'].dataType.simpleString()}, ratios array<double>")
    found = drawn.select("g", F.explode("ratios").alias("ratio")).groupBy("g").agg(q)
    return found.select(*(F.col(f"g.{c}").alias(c) for c in group), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def benchmark_metrics(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, n, n_positive, base_rate, log_loss, brier)."""
    p = F.least(F.greatest(F.col("score"), F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))
    return _clean(scored).groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("n_positive"), F.avg("y").alias("base_rate"),
        F.avg(loss).alias("log_loss"), F.avg((F.col("score") - F.col("y")) ** 2).alias("brier"),
    )


def implausible(metrics: DataFrame, auc: float = 0.90, base_rate: float = 0.10) -> DataFrame:
    """Flags stages whose AUC is too good for a rare event."""
    return metrics.withColumn("implausible", F.coalesce((F.col("auc") > auc) & (F.col("base_rate") < base_rate), F.lit(False)))
