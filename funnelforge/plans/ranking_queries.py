"""Queries of the ranking metrics and of the splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelforge.operators import metrics as M
from funnelforge.operators import position, split
from funnelforge.plans.tables import LEADS_SQL, SCORED_SQL, leads, scored, table
from funnelforge.session import scratch_path
from funnelforge.sources import bucketed


def _six(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on their order; six places do not."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def w0_ordered_position(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return position.ordered_position(rows, ["y"], [F.desc("score"), F.asc("row_id")]).select("row_id", "y", "position")


def w1_roc_auc(spark, sf_dir):
    return _six(M.roc_auc(scored(spark, sf_dir)), "auc")


def w2_pr_auc(spark, sf_dir):
    return _six(M.pr_auc(M.ordered(scored(spark, sf_dir))), "average_precision")


def w3_tier_table(spark, sf_dir):
    return _six(M.tier_table(M.ordered(scored(spark, sf_dir)), 7), "actual_rate", "captured_pct", "avg_score", "gap_pp")


def w4_tier_cutoffs(spark, sf_dir):
    return _six(M.tier_cutoffs(M.ordered(scored(spark, sf_dir)), 7), "cutoff")


def w5_assign_tier(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", M.assign_tier(F.col("score"), [0.9, 0.7, 0.5, 0.3, 0.1]).cast("long").alias("tier"))


def w6_lift(spark, sf_dir):
    return _six(M.lift(M.tier_table(M.ordered(scored(spark, sf_dir)))), "base_rate", "top_rate", "bottom_rate", "lift", "ratio")


def w7_capture_thresholds(spark, sf_dir):
    return _six(M.capture_thresholds(M.ordered(scored(spark, sf_dir))), "population_pct")


def w8_bootstrap_ratio(spark, sf_dir):
    """Interval of a ranking whose bottom tier has few positives: orders of one customer in nine."""
    rows = scored(spark, sf_dir).withColumn("y", F.when(F.col("row_id") % 97 == 0, 1).otherwise(F.when(F.col("score") > 0.9, F.col("y")).otherwise(0)))
    return M.bootstrap_ratio(M.tier_table(M.ordered(rows), 1000), 1000)


def w8_intervals_by_segment(spark, sf_dir):
    """The ends of each priority's ranking of rare orders, with intervals of their ratio: the
    counts, whether the interval holds the ratio, and whether its ends are near those of the
    normal approximation of the ratio's logarithm."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("segment"), ((F.col("o_orderkey") % 11 == 0) & (F.col("o_custkey") % 2 == 0)).cast("int").alias("y"), (F.col("o_custkey") * 7919 % 1000 / 1000.0).alias("score")
    )
    tiers = M.tier_table(M.ordered(rows, ["segment"]), SEGMENT_TIERS, ["segment"])
    end = lambda t, c: F.max(F.when(F.col("tier") == t, F.col(c)))
    ends = tiers.groupBy("segment").agg(*(end(t, c).alias(f"{c}_{name}") for t, name in ((1, "top"), (SEGMENT_TIERS, "bottom")) for c in ("n", "n_positive")))
    met = ends.join(M.bootstrap_ratio(tiers, SEGMENT_TIERS, group=["segment"]), "segment", "left")
    p1, p2 = F.col("n_positive_top") / F.col("n_top"), F.col("n_positive_bottom") / F.col("n_bottom")
    ratio = F.try_divide(p1, p2)
    spread = 1.96 * F.sqrt(F.try_divide(1 - p1, F.col("n_positive_top")) + F.try_divide(1 - p2, F.col("n_positive_bottom")))
    near = (F.abs(F.ln("low") - F.ln(ratio) + spread) < 0.5 * spread) & (F.abs(F.ln("high") - F.ln(ratio) - spread) < 0.9 * spread)
    return met.select("segment", "n_top", "n_positive_top", "n_bottom", "n_positive_bottom", F.col("low").isNotNull().alias("has_interval"), ratio.between(F.col("low"), F.col("high")).alias("holds"), F.when(F.least("n_positive_top", "n_positive_bottom") >= 5, near).alias("near"))


#: Tiers of a segment's ranking.
SEGMENT_TIERS = 8


def a34_benchmark_metrics(spark, sf_dir):
    return _six(M.benchmark_metrics(scored(spark, sf_dir)), "base_rate", "log_loss", "brier")


def a38_implausible(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("stage", F.col("row_id") % 3)
    met = M.roc_auc(rows, ["stage"]).join(M.benchmark_metrics(rows, ["stage"]), "stage")
    return _six(M.implausible(met, 0.5, 0.6).select("stage", "auc", "base_rate", "implausible"), "auc", "base_rate")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def x1_random_split(spark, sf_dir):
    return split.random_split(_orders(spark, sf_dir), "o_orderkey")


def x2_stratified_split(spark, sf_dir):
    return split.stratified_split(leads(spark, sf_dir), "lead_id", ["source", "disposition"])


def x3_temporal_split(spark, sf_dir):
    return split.temporal_split(table(spark, sf_dir, "events"), "event_id", "ts", "2024-01-20")


def x4_period_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("week", F.date_format("ts", "yyyy-MM-dd"))
    return split.period_split(events, "event_id", "week", ["2024-01-05", "2024-01-06"])


def x5_grouped_split(spark, sf_dir):
    return split.grouped_split(table(spark, sf_dir, "events"), "event_id", "user_id")


def x6_check_ids(spark, sf_dir):
    return split.check_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


def x7_saved_split(spark, sf_dir):
    """A split that is checked, made, saved and loaded."""
    path = scratch_path(spark, "saved-split")
    split.save_split(split.split_dataset(_orders(spark, sf_dir), "o_orderkey", seed=3, columns=["o_orderstatus"]), path)
    return split.load_split(spark, path).ids.withColumn("split_id", F.lit("s1"))


def a29_composition(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return split.composition(o, split.random_split(o, "o_orderkey"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def a30_base_rate_shift(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    found = split.base_rate_shift(e, split.temporal_split(e, "event_id", "ts", "2024-01-20"), "event_id", F.col("event_type") == "purchase")
    return _six(found, "train_rate", "test_rate", "change")


def j6_apply_split(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return split.apply_split(o, split.random_split(o, "o_orderkey"), "o_orderkey", "test").select("o_orderkey", "o_orderstatus")


def j6_bucketed_split(spark, sf_dir):
    """Orders and a split of them, both dealt to buckets by their keys, saved, loaded and joined."""
    path = scratch_path(spark, "bucketed-split")
    bucketed.save_bucketed(_orders(spark, sf_dir), f"{path}/orders", "o_orderkey", 8)
    o = bucketed.load_bucketed(spark, f"{path}/orders")
    split.save_split(split.split_dataset(o, "o_orderkey", columns=[]), f"{path}/split", 8)
    return split.apply_split(o, split.load_split(spark, f"{path}/split").ids, "o_orderkey", "test").select("o_orderkey", "o_orderstatus")


def j6_missing_ids(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return split.missing_ids(o.where("o_orderstatus <> 'P'"), split.random_split(o, "o_orderkey"), "o_orderkey")


def u3_split_check(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return split.split_check(o, split.random_split(o, "o_orderkey").where("row_id % 10 <> 3"), "o_orderkey")


QUERIES = [
    w0_ordered_position, w1_roc_auc, w2_pr_auc, w3_tier_table, w4_tier_cutoffs, w5_assign_tier, w6_lift, w7_capture_thresholds, w8_bootstrap_ratio, w8_intervals_by_segment,
    a34_benchmark_metrics, a38_implausible, x1_random_split, x2_stratified_split, x3_temporal_split, x4_period_split, x5_grouped_split,
    x6_check_ids, x7_saved_split, a29_composition, a30_base_rate_shift, j6_apply_split, j6_bucketed_split, j6_missing_ids, u3_split_check,
]

_PLACED = SCORED_SQL + """, placed AS (SELECT *, row_number() OVER w AS position, CAST(sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hits, count(*) OVER () AS rows, sum(y) OVER () AS positives
  FROM scored WINDOW w AS (ORDER BY score DESC, row_id))"""


def _tiers(k: int) -> str:
    return (
        _PLACED
        + f""", tiers AS (SELECT (position * {k} + rows - 1) // rows AS tier, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, avg(y) AS actual_rate,
      100.0 * sum(y) / max(positives) AS captured_pct, avg(score) AS avg_score FROM placed GROUP BY 1)"""
    )


def _random(table_: str, key: str, seed: int, size: float = 0.2) -> str:
    return f"""SELECT {key} AS row_id, CASE WHEN row_number() OVER (ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), {key}) <= round_even((SELECT count(*) FROM {table_}) * {size}, 0)
      THEN 'test' ELSE 'train' END AS side FROM {table_}"""


_SPLIT = f"WITH split AS ({_random('orders', 'o_orderkey', 42)})"
_RATES = """SELECT avg(CASE WHEN ts < TIMESTAMP '2024-01-20' THEN CAST(event_type = 'purchase' AS INTEGER) END) AS a, avg(CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN CAST(event_type = 'purchase' AS INTEGER) END) AS b FROM events"""

SQL = {
    "w0_ordered_position": SCORED_SQL + " SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY score DESC, row_id) AS position FROM scored",
    "w1_roc_auc": SCORED_SQL
    + """, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)
      SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""",
    "w2_pr_auc": _PLACED + " SELECT round(sum(CASE WHEN y = 1 THEN hits / position END) / max(positives), 6) AS average_precision FROM placed",
    "w3_tier_table": _tiers(7)
    + " SELECT tier, n, n_positive, round(actual_rate, 6) AS actual_rate, round(CAST(captured_pct AS DOUBLE), 6) AS captured_pct, round(avg_score, 6) AS avg_score, round(100 * (avg_score - actual_rate), 6) AS gap_pp FROM tiers",
    "w4_tier_cutoffs": _PLACED + " SELECT CAST(b AS INTEGER) AS boundary, round(CAST(score AS DOUBLE), 6) AS cutoff FROM placed, range(1, 7) AS q(b) WHERE position = b * rows // 7 + 1",
    "w5_assign_tier": SCORED_SQL + " SELECT row_id, CAST(6 - len(list_filter([0.9, 0.7, 0.5, 0.3, 0.1], lambda c: c <= score)) AS BIGINT) AS tier FROM scored",
    "w6_lift": _tiers(10)
    + """, s AS (SELECT sum(n_positive) / sum(n) AS base, max(actual_rate) FILTER (tier = 1) AS top, max(actual_rate) FILTER (tier = 10) AS bottom FROM tiers)
      SELECT round(base, 6) AS base_rate, round(top, 6) AS top_rate, round(bottom, 6) AS bottom_rate, round(top / base, 6) AS lift, CASE WHEN bottom <> 0 THEN round(top / bottom, 6) END AS ratio,
      CASE WHEN bottom = 0 THEN 'bottom tier has zero positives' ELSE 'ok' END AS status FROM s""",
    "w7_capture_thresholds": _PLACED
    + " SELECT share, round(CAST(100.0 * min(position) / max(rows) AS DOUBLE), 6) AS population_pct FROM placed, (VALUES (CAST(0.6 AS DOUBLE)), (0.65), (0.7), (0.75)) AS q(share) WHERE hits / positives >= share GROUP BY 1",
    "a34_benchmark_metrics": SCORED_SQL
    + """, p AS (SELECT y, CAST(score AS DOUBLE) AS s, least(greatest(CAST(score AS DOUBLE), 1e-15), 1 - 1e-15) AS p FROM scored)
      SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, round(avg(y), 6) AS base_rate, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((s - y) * (s - y)), 6) AS brier FROM p""",
    "a38_implausible": SCORED_SQL
    + """, r AS (SELECT row_id % 3 AS stage, y, rank() OVER (PARTITION BY row_id % 3 ORDER BY score) + (count(*) OVER (PARTITION BY row_id % 3, score) - 1) / 2.0 AS r FROM scored),
      m AS (SELECT stage, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc, avg(y) AS base_rate FROM r GROUP BY 1)
      SELECT stage, round(auc, 6) AS auc, round(base_rate, 6) AS base_rate, auc > 0.5 AND base_rate < 0.6 AS implausible FROM m""",
    "x1_random_split": _random("orders", "o_orderkey", 42),
    "x2_stratified_split": LEADS_SQL
    + """, k AS (SELECT lead_id, coalesce(source, '<missing>') || chr(31) || coalesce(disposition, '<missing>') AS key FROM leads), s AS (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM k),
      t AS (SELECT lead_id, CASE WHEN c < 2 THEN '__RARE__' ELSE key END AS key FROM s),
      p AS (SELECT lead_id, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY md5('42|' || lead_id), lead_id) AS p FROM t)
      SELECT lead_id AS row_id, CASE WHEN n >= 2 AND p <= least(greatest(round_even(n * 0.2, 0), 1), n - 1) THEN 'test' ELSE 'train' END AS side FROM p""",
    "x3_temporal_split": "SELECT event_id AS row_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'test' ELSE 'train' END AS side FROM events",
    "x4_period_split": "SELECT event_id AS row_id, CASE WHEN strftime(ts, '%Y-%m-%d') IN ('2024-01-05', '2024-01-06') THEN 'test' ELSE 'train' END AS side FROM events",
    "x5_grouped_split": """WITH g AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS g FROM events), p AS (SELECT g, row_number() OVER (ORDER BY md5('42|' || g), g) AS p, count(*) OVER () AS n FROM g)
      SELECT event_id AS row_id, CASE WHEN n >= 2 AND p <= least(greatest(round_even(n * 0.2, 0), 1), n - 1) THEN 'test' ELSE 'train' END AS side FROM events JOIN p ON CAST(user_id AS VARCHAR) = g""",
    "x6_check_ids": "SELECT count(*) AS n, count(*) - count(l_orderkey) AS n_null, count(l_orderkey) - count(DISTINCT l_orderkey) AS n_repeated FROM lineitem",
    "x7_saved_split": f"SELECT *, 's1' AS split_id FROM ({_random('orders', 'o_orderkey', 3)})",
    "a29_composition": _SPLIT
    + """, long AS (SELECT side, 'o_orderstatus' AS col, o_orderstatus AS value FROM orders JOIN split ON o_orderkey = row_id UNION ALL SELECT side, 'o_orderpriority', o_orderpriority FROM orders JOIN split ON o_orderkey = row_id),
      c AS (SELECT col, coalesce(value, '<missing>') AS value, count(*) FILTER (side = 'train') AS train_n, count(*) FILTER (side = 'test') AS test_n FROM long GROUP BY 1, 2),
      n AS (SELECT count(*) FILTER (side = 'train') AS a, count(*) FILTER (side = 'test') AS b FROM split)
      SELECT col, value, train_n, test_n, round(CAST(100.0 * train_n / a AS DOUBLE), 2) AS train_pct, round(CAST(100.0 * test_n / b AS DOUBLE), 2) AS test_pct FROM c, n""",
    "a30_base_rate_shift": f"WITH r AS ({_RATES}) SELECT round(a, 6) AS train_rate, round(b, 6) AS test_rate, round(abs(b - a) / a, 6) AS change, coalesce(CASE WHEN a = 0 THEN b > 0 ELSE abs(b - a) / a > 0.3 END, FALSE) AS shifted FROM r",
    "j6_apply_split": _SPLIT + " SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT row_id FROM split WHERE side = 'test')",
    "w8_intervals_by_segment": """WITH r AS (SELECT o_orderkey AS row_id, o_orderpriority AS segment, CAST(o_orderkey % 11 = 0 AND o_custkey % 2 = 0 AS INTEGER) AS y, o_custkey * 7919 % 1000 / 1000.0 AS score FROM orders),
      p AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, row_id) AS position, count(*) OVER (PARTITION BY segment) AS rows FROM r),
      t AS (SELECT segment, (position * 8 + rows - 1) // rows AS tier, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM p GROUP BY 1, 2),
      e AS (SELECT segment, max(n) FILTER (tier = 1) AS n_top, max(k) FILTER (tier = 1) AS n_positive_top, max(n) FILTER (tier = 8) AS n_bottom, max(k) FILTER (tier = 8) AS n_positive_bottom FROM t GROUP BY 1)
      SELECT *, n_positive_bottom > 0 AND n_positive_bottom < 20 AS has_interval, CASE WHEN n_positive_bottom > 0 AND n_positive_bottom < 20 THEN TRUE END AS holds,
      CASE WHEN n_positive_bottom > 0 AND n_positive_bottom < 20 AND least(n_positive_top, n_positive_bottom) >= 5 THEN TRUE END AS near FROM e""",
    "j6_bucketed_split": _SPLIT + " SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT row_id FROM split WHERE side = 'test')",
    "j6_missing_ids": _SPLIT + " SELECT row_id, side FROM split WHERE row_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
    "u3_split_check": "SELECT CAST(0 AS BIGINT) AS overlap, count(*) FILTER (o_orderkey % 10 = 3) AS uncovered FROM orders",
}
