"""Training rows that are added up before trees are grown, and how often a run reads its table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelforge.operators import assemble, metrics, model


@pytest.fixture(scope="module")
def rows(spark):
    """Labels that lean on a number with gaps and on a category; another number never varies."""
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    x = F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 9 == 1, float("nan")).otherwise(F.exp(6 * u))
    y = (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000 < u * F.when(F.col("id") % 4 == 0, 0.9).otherwise(0.4)).cast("int")
    kind = F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 4))
    return spark.range(30_000).select(F.col("id").alias("row_id"), y.alias("y"), x.alias("x"), F.lit(5.0).alias("same"), F.lit(None).cast("double").alias("none"), kind.alias("kind"))


def test_cells_hold_every_row_at_its_nearest_centre(spark, rows):
    f = model.pin(rows, ["x", "same", "none"], ["kind"])
    found = model.cells(model.project(rows, f, ["y"]), f).toPandas()
    raw = rows.toPandas()
    mids = np.sort(found["x"].dropna().unique())
    assert len(found) <= 2 * 32 * 5 and len(mids) == 31 and mids[0] == raw["x"].min() and mids[-1] == raw["x"].max()
    assert set(found["same"]) == {5.0} and found["none"].isna().all()
    # Values at an edge belong to the lower centre.
    raw["x"] = [math.nan if math.isnan(v) else mids[np.searchsorted((mids[:-1] + mids[1:]) / 2, v)] for v in raw["x"]]
    want = raw.fillna({"x": -1.0, "kind": ""}).groupby(["y", "x", "kind"]).size().to_dict()
    assert found.fillna({"x": -1.0, "kind": ""}).set_index(["y", "x", "kind"])["weight"].to_dict() == want


def test_centres_are_ends_and_ranks_and_edges_grow():
    assert model.centres([], 5) == ([], []) and model.centres([2.0, 2.0], 5) == ([2.0], [])
    assert model.centres([1.0, 1.0, 3.0, 9.0], 5) == ([1.0, 3.0, 9.0], [2.0, 6.0])
    kept, edges = model.centres([float(k * k) for k in range(101)], 11)
    assert kept == [float(k * k) for k in range(0, 101, 10)] and edges == sorted(set(edges)) and len(edges) == 10
    close = [1.0, math.nextafter(1.0, 2), math.nextafter(math.nextafter(1.0, 2), 2), math.inf]
    kept, edges = model.centres(close, 9)
    assert edges == sorted(set(edges)) and all(a <= e < b for a, e, b in zip(kept, edges, kept[1:], strict=False))


def test_a_model_of_cells_is_that_of_the_rows(spark, rows):
    f = model.pin(rows, ["x", "same"], ["kind"])
    fitted = model.fit_stage(rows, f, 5, 3)
    mids = np.sort(model.cells(model.project(rows, f, ["y"]), f).select("x").dropna().distinct().toPandas()["x"])
    # Grown on rows one by one, each at its centre: the same trees.
    at = F.udf(lambda v: None if v is None or math.isnan(v) else float(mids[np.searchsorted((mids[:-1] + mids[1:]) / 2, v)]), "double")
    moved = rows.withColumn("x", at("x"))
    plain = model._pipeline(f, 5, 3, 7).fit(model.encode(model.project(moved, f, ["y"]), f))
    one, two, raw = (model.probability(r, m, f, "p").select("row_id", "p").toPandas().set_index("row_id")["p"].sort_index() for r, m in ((moved, fitted), (moved, plain), (rows, fitted)))
    assert np.allclose(one, two, atol=1e-9) and (one == raw).all() and one.nunique() > 10
    # And as good as where MLlib picks the thresholds from a sample of rows.
    own = model._pipeline(f, 5, 3, 7).fit(model.encode(model.project(rows, f, ["y"]), f))
    auc = [metrics.roc_auc(model.probability(rows, m, f, "score").select("row_id", "y", "score")).first()["auc"] for m in (fitted, own)]
    assert auc[0] == pytest.approx(auc[1], abs=0.01) and auc[0] > 0.7


def test_rows_of_many_features_are_not_added_up():
    few = model.Features(["a", "b"], {"c": ["x"] * 5})
    assert model._few_cells(few) and not model._few_cells(model.Features(list("abcd"), {})) and not model._few_cells(model.Features(["a"], {c: ["x"] * 99 for c in "cde"}))


def test_a_training_run_reads_its_table_twice(spark):
    """Once for all formulas, and once for all else."""
    n, seen = 3000, spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    k = F.col("id")
    level = F.element_at(F.array(*map(F.lit, "ABC")), (k * 31 % 3 + 1).cast("int"))
    df = spark.range(n).select("id", level.alias("stage"), (k * 7919 % 101).cast("double").alias("core"), F.when(k % 3 == 0, k % 7).cast("double").alias("rich"), (k % 4).cast("string").alias("kind"))
    df = df.mapInArrow(count, df.schema)
    formulas = {"good": F.col("core") >= 0, "bad": F.col("core") < 50, "some": F.col("kind") != "2"}
    done = model.train_run(df, "stage", ["A", "B", "C"], ["core", "rich"], ["kind"], ["rich"], "unified", 2, 2, formulas=formulas, source_col="kind", id_col="id", batch=k % 3 == 0)
    assert seen.value <= 2 * n
    assert [(g.name, g.passed) for g in done.gates[2:]] == [("formula:good", True), ("formula:bad", False), ("formula:some", False), ("provenance", False)]
    assert done.null_rates == {"core": 0.0, "kind": 0.0, "rich": pytest.approx(2 / 3)}
    pinned = sorted((r["col"], r["value"] or "", r["rate"] or 0.0) for r in done.pinned.collect())
    assert [p[:2] for p in pinned] == [("core", ""), ("kind", ""), *(("kind", v) for v in "0123"), ("rich", "")] and pinned[-1][2] == pytest.approx(2 / 3)


def test_formulas_in_one_pass_are_those_one_by_one(spark):
    df = spark.range(400).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), "id")
    formulas = {"a": F.col("id") % 20 > 0, "b": F.col("id") >= 0, "c": F.when(F.col("id") % 5 > 1, F.col("id") % 2 == 0)}
    key = lambda r: str(tuple(r))
    together = assemble.formula_rates(df, formulas).collect()
    for name, holds in formulas.items():
        alone = sorted((tuple(r) for r in assemble.formula_consistency(df, holds).collect()), key=str)
        assert sorted((tuple(r)[1:] for r in together if r["formula"] == name), key=str) == alone and len(alone) == 6
    by = {(r["formula"], r["source"], r["is_total"]): (r["pass_rate"], r["fails"]) for r in sorted(together, key=key)}
    assert by["b", None, 1] == (1.0, False) and by["a", None, 0] == (0.75, True) and by["a", "s1", 0] == (1.0, True)
