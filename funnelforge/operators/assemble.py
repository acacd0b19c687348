"""Joining source responses onto the lead spine, and reports of their coverage."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The match rate that is usual, and the spread that is not.
USUAL_RATE, SPREAD = (0.35, 0.43), 0.15
STATUSES = ("matched", "no_hit", "error", "not_sent")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each source's run that started last; ties by the smaller run_id."""
    last = runs.groupBy("source").agg(F.max("started_at").alias("started_at"))
    return runs.join(last, ["source", "started_at"]).groupBy("source").agg(F.min("run_id").alias("run_id"))


def repeated_responses(responses: DataFrame) -> DataFrame:
    """(run_id, lead_id, n) of leads with several responses in a run; must be empty."""
    return responses.groupBy("run_id", "lead_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def any_known(columns: list[str]) -> Column:
    """P5: whether any of the columns has a value; no columns, never."""
    return reduce(or_, (F.col(c).isNotNull() for c in columns), F.lit(False))


def source_frame(responses: DataFrame, source: str, features: list[str]) -> DataFrame:
    """A source's columns for the spine: status, times and is_enriched, which is any
    feature known, or the status where a source has no features."""
    enriched = any_known(features) if features else F.col("status") == "SUCCESS_MATCHED"
    return responses.select(
        "lead_id", *features, F.col("status").alias(f"{source}_match_status"), F.col("fetched_at").alias(f"{source}_fetched_at"),
        F.col("batch_id").alias(f"{source}_batch_id"), enriched.alias(f"{source}_is_enriched"),
    )


def assemble(spine: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """Left-joins each source's frame by lead_id; a lead without a response is not enriched.

    ``repeated_responses`` of what is joined must be empty: then the spine's rows neither
    grow nor shrink. A frame whose leads repeat raises when the result is read.
    """
    out = spine
    for source, frame in frames.items():
        out = out.join(_one_each(frame, source), "lead_id", "left")
        out = out.withColumn(f"{source}_is_enriched", F.coalesce(f"{source}_is_enriched", F.lit(False)))
    return out


def _one_each(frame: DataFrame, source: str) -> DataFrame:
    """The frame's rows, checked in the shuffle that the join needs anyway."""
    rest = [c for c in frame.columns if c != "lead_id"]
    one = frame.groupBy("lead_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    bad = F.raise_error(F.concat(F.lit(f"{source} has several responses for lead "), F.col("lead_id").cast("string")))
    return one.withColumn("_r", F.when(F.col("_n") > 1, bad.cast(one.schema["_r"].dataType)).otherwise(F.col("_r"))).select("lead_id", "_r.*")


def run_summary(responses: DataFrame) -> DataFrame:
    """(run_id, rows_attempted, matched, no_hit, error, not_sent)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return responses.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows_attempted"), n("SUCCESS_MATCHED").alias("matched"), n("SUCCESS_NO_HIT").alias("no_hit"), n("ERROR").alias("error"), n("NOT_SENT").alias("not_sent")
    )


def coverage(summary: DataFrame) -> DataFrame:
    """(run_id, status, n, pct, unusual): the match rate outside its usual band is flagged."""
    long = summary.unpivot(["run_id", "rows_attempted"], list(STATUSES), "status", "n")
    rate = F.try_divide("n", "rows_attempted")
    flag = (F.col("status") == "matched") & ~rate.between(*USUAL_RATE)
    return long.select("run_id", "status", "n", F.round(100 * rate, 1).alias("pct"), F.coalesce(flag, F.lit(False)).alias("unusual"))


def coverage_by_level(assembled: DataFrame, sources: list[str], level: str) -> DataFrame:
    """(source, level, rate, spread_flag): share enriched per level; null levels are left out."""
    long = assembled.where(F.col(level).isNotNull()).select(level, *(F.col(f"{s}_is_enriched").cast("int").alias(s) for s in sources)).unpivot([level], sources, "source", "e")
    rates = long.groupBy("source", level).agg(F.avg("e").alias("rate"))
    spread = rates.groupBy("source").agg((F.max("rate") - F.min("rate") > SPREAD).alias("spread_flag"))
    return rates.join(spread, "source").withColumnRenamed(level, "level")


def batch_invariants(runs: DataFrame, responses: DataFrame) -> DataFrame:
    """(run_id, n_repeated, counts_agree, spread_seconds) of sources with several runs."""
    several = runs.groupBy("source").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("source")
    mine = runs.join(several, "source", "left_semi")
    per = responses.groupBy("run_id", "lead_id").agg(F.count(F.lit(1)).alias("k"), F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b"), F.count(F.when(F.col("status") == "SUCCESS_MATCHED", 1)).alias("m"))
    found = per.groupBy("run_id").agg(F.count(F.when(F.col("k") > 1, 1)).alias("n_repeated"), F.sum("k").alias("n"), F.sum("m").alias("m"), (F.unix_timestamp(F.max("b")) - F.unix_timestamp(F.min("a"))).alias("spread_seconds"))
    agree = (F.col("n") == F.col("rows_attempted")) & (F.col("m") == F.col("matched"))
    return mine.join(found, "run_id").select("run_id", "n_repeated", agree.alias("counts_agree"), "spread_seconds")


def timing_leaks(responses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(lead_id, fetched_at, outcome_at) of responses fetched after the lead's outcome."""
    met = responses.select("lead_id", "fetched_at").join(outcomes.select("lead_id", "outcome_at"), "lead_id")
    return met.where("fetched_at > outcome_at")


def formula_consistency(df: DataFrame, holds: Column, source: str = "source") -> DataFrame:
    """(source, pass_rate, fails): the share of rows for which ``holds``, overall
    (source null, is_total) and per source; fails below 0.95, or all if the spread is above 0.15."""
    return formula_rates(df, {"holds": holds}, source).drop("formula")


def formula_rates(df: DataFrame, formulas: dict[str, Column], source: str = "source") -> DataFrame:
    """A33 of several formulas, by ``formula``, in one pass."""
    names = dict(enumerate(formulas))
    rows = df.select(F.col(source).alias("source"), *(formulas[n].cast("double").alias(f"h{i}") for i, n in names.items()))
    rates = rows.rollup("source").agg(*(F.avg(f"h{i}").alias(f"h{i}") for i in names), F.grouping("source").cast("int").alias("is_total"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("formula"), F.col(f"h{i}").alias("pass_rate")) for i, n in names.items())))
    long = rates.select("source", "is_total", each.alias("f")).select("f.formula", "source", "is_total", "f.pass_rate")
    own = F.when(F.col("is_total") == 0, F.col("pass_rate"))
    w = Window.partitionBy("formula")  # a row a source
    spread = F.max(own).over(w) - F.min(own).over(w)
    return long.withColumn("spread", spread).select("formula", "source", "is_total", "pass_rate", ((F.col("pass_rate") < 0.95) | (F.col("spread") > 0.15)).alias("fails"))


def sum_invariant(total: str, parts: list[str], tolerance: float = 1e-6) -> Column:
    """total = sum of parts; a null total holds, a null part is 0."""
    gap = F.abs(F.col(total) - sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0)))
    return F.coalesce(gap <= tolerance, F.lit(True))


def le_invariant(small: str, large: str, tolerance: float = 1e-6) -> Column:
    """small <= large; a null on either side holds."""
    return F.coalesce(F.col(small) <= F.col(large) + tolerance, F.lit(True))
