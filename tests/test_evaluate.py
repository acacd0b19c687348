"""Evaluation of stages and segments against DuckDB over the stored scores, and intervals."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelforge.operators import metrics, model, split
from funnelforge.session import scratch_path
from funnelforge.sources import bucketed

ORDER = ["asked", "called", "visited"]


def rows(spark, n=1500):
    k = F.col("id")
    level = F.when(k * 31 % 101 < 60, 0).when(k * 31 % 101 < 85, 1).otherwise(2)
    return spark.range(n).select(
        k.alias("row_id"), F.element_at(F.array(*map(F.lit, ORDER)), level + 1).alias("state"), (level * 3 + k * 17 % 11).cast("double").alias("dose"), F.when(k % 4 > 0, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("ward")
    )


@pytest.fixture(scope="module")
def chain(spark):
    return model.train(rows(spark), "state", ORDER, ["dose"], ["ward"], [], "baseline", trees=2, depth=2)


#: Metrics of (y, score) rows by group, without any of the library's operators.
PLAIN = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY score DESC, row_id) AS p, sum(y) OVER (PARTITION BY {g} ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING) AS hits FROM s),
  won AS (SELECT {a}, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM s a JOIN s b ON {j} AND a.y = 1 AND b.y = 0 GROUP BY ALL),
  m AS (SELECT {g}, count(*) AS n, avg((score - y) ** 2) AS brier, avg(hits / p) FILTER (y = 1) AS ap FROM r GROUP BY ALL)
  SELECT {m}, n, brier, ap, auc FROM m LEFT JOIN won ON {w}"""


@pytest.mark.parametrize("by", [[], ["ward"]])
def test_metrics_equal_duckdb_over_the_scores(spark, chain, by):
    found = model.evaluate_run(rows(spark), chain, "row_id", override=True, by=by)
    group = ["stage", *by]
    s = found["scored"].toPandas()  # noqa: F841
    same = lambda x, y: " AND ".join(f"{x}.{c} IS NOT DISTINCT FROM {y}.{c}" for c in group)
    sql = PLAIN.format(g=", ".join(group), a=", ".join(f"a.{c}" for c in group), m=", ".join(f"m.{c}" for c in group), j=same("a", "b"), w=same("m", "won"))
    want = duckdb.sql(sql).fetchall()
    k = len(group)
    got = {tuple(r[c] for c in group): r for r in found["metrics"].collect()}
    assert len(got) == len(want) == (2 if not by else 8)
    for w in want:
        r = got[tuple(x if x == x else None for x in w[:k])]
        assert r["n"] == w[k] and np.allclose([r["brier"], r["average_precision"], r["auc"]], w[k + 1 :])
    assert found["lift"].count() == len(want) and {"low", "high"} <= set(found["lift"].columns)


def test_intervals_of_groups_hold_their_ratios(spark):
    """Ends of tiers of 400 rows; the interval of the exact ratio of two binomials."""
    cells = {"a": (400, 120, 400, 15), "b": (400, 60, 400, 8), "c": (400, 100, 400, 60), "d": (50, 5, 50, 0), None: (300, 90, 310, 19)}
    long = [(g, t, n, p) for g, (n1, p1, n2, p2) in cells.items() for t, n, p in ((1, n1, p1), (9, n2, p2))]
    tiers = spark.createDataFrame(long, "seg string, tier long, n long, n_positive long")
    one = {r["seg"]: (r["low"], r["high"]) for r in metrics.bootstrap_ratio(tiers, 9, group=["seg"]).collect()}
    again = {r["seg"]: (r["low"], r["high"]) for r in metrics.bootstrap_ratio(tiers.repartition(5), 9, group=["seg"]).collect()}
    assert one == again and set(one) == {"a", "b", None}
    for g, (low, high) in one.items():
        n1, p1, n2, p2 = cells[g]
        rng = np.random.default_rng(1)
        bottom = rng.binomial(n2, p2 / n2, 200_000) / n2
        top = rng.binomial(n1, p1 / n1, 200_000) / n1
        want = np.quantile(top[bottom > 0] / bottom[bottom > 0], [0.025, 0.975])
        assert low < (p1 / n1) / (p2 / n2) < high and np.allclose([low, high], want, rtol=0.2)
    alone = metrics.bootstrap_ratio(tiers.where("seg = 'a'").drop("seg"), 9).first()
    assert alone["low"] < 8 < alone["high"]


def test_a_bucketed_split_moves_no_rows(spark):
    path = scratch_path(spark, "buckets")
    df = rows(spark)
    bucketed.save_bucketed(df, f"{path}/rows", "row_id", 6)
    data = bucketed.load_bucketed(spark, f"{path}/rows")
    made = split.split_dataset(data, "row_id", columns=[])
    split.save_split(made, f"{path}/split", 6)
    ids = split.load_split(spark, f"{path}/split").ids
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side, n in (("test", 300), ("train", 1200)):
            got = split.apply_split(data, ids, "row_id", side)
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            want = split.apply_split(df, made.ids, "row_id", side)
            assert sorted(got.select(*df.columns).collect(), key=str) == sorted(want.collect(), key=str) and got.count() == n
        assert "Exchange" in split.apply_split(df, made.ids, "row_id", "test")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    with pytest.raises(Exception, match="(?i)exists"):
        bucketed.save_bucketed(df, f"{path}/rows", "row_id", 6)
