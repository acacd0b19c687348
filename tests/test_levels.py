"""Categories of many levels, pre-flight checks that gate a batch, and ranked provenance."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from funnelforge.operators import levels, mapping, model, profile
from funnelforge.session import scratch_path, stored


def table(spark, flip=None, n=700):
    rng = random.Random(3)
    rows = [(k, rng.choice(["", None, "lone" + str(k % 11), "big", "big", "mid" + str(k % 4)]), int(rng.random() < 0.3 + 0.2 * (k % 2))) for k in range(n)]
    return spark.createDataFrame([(k, v, 1 - y if k == flip else y) for k, v, y in rows], "id long, shop string, y int"), rows


def test_statistics_equal_brute_force(spark):
    df, rows = table(spark)
    fold = {r["id"]: r["f"] for r in df.select("id", levels.fold_of(F.col("id")).alias("f")).collect()}
    found = {r["level"]: r for r in levels.statistics(df, ["shop"], levels.fold_of(F.col("id")), least=40).collect()}
    name = lambda v: "<missing>" if not v else v
    sizes = {}
    for _, v, _ in rows:
        sizes[name(v)] = sizes.get(name(v), 0) + 1
    level = lambda v: name(v) if sizes[name(v)] >= 40 else "__RARE__"

    def code(part, whole):
        return (sum(y for _, _, y in part) + 20 * sum(y for _, _, y in whole) / len(whole)) / (len(part) + 20)

    assert set(found) == {level(v) for _, v, _ in rows} | {"__RARE__"} and "lone3" not in found
    for v, r in found.items():
        own = [x for x in rows if level(x[1]) == v]
        assert r["n"] == len(own) and r["code"] == pytest.approx(code(own, rows))
        for k in range(levels.FOLDS):
            rest = lambda part, k=k: [x for x in part if fold[x[0]] != k]
            assert r["outs"][k] == pytest.approx(code(rest(own), rest(rows)))


def test_no_row_is_coded_by_its_own_label(spark):
    for row in (5, 123, 400):
        codes = []
        for flip in (None, row):
            df, _ = table(spark, flip)
            known = levels.fit_levels(df, ["shop"], "id", least=40)
            codes.append({r["id"]: r["shop__rate"] for r in known.coded(df, levels.fold_of(F.col("id"))).collect()})
        assert codes[0][row] == codes[1][row] and len(codes[0]) == 700
        assert sum(codes[0][k] != codes[1][k] for k in codes[0]) > 100  # rows of other folds see it


def test_unseen_levels_and_empty_tables(spark):
    df, _ = table(spark)
    known = levels.fit_levels(df, ["shop"], "id", least=40)
    new = spark.createDataFrame([(1, "never"), (2, "lone1"), (3, None), (4, " ")], "id long, shop string")
    got = {r["id"]: r["shop__rate"] for r in known.coded(new).collect()}
    assert got[1] == got[2] == known.rare["shop"] and got[3] == got[4] != got[1]
    nothing = levels.fit_levels(df.where("false"), ["shop"], "id")
    assert nothing.rare == {"shop": 0.5} and nothing.coded(new).count() == 4


@pytest.fixture(scope="module")
def chain(spark):
    """A funnel whose outcome depends on one of 10,000 streets."""
    k = F.col("id")
    street = F.pmod(k * 7919, F.lit(10_000))
    went = F.pmod(F.xxhash64(street % 100, k), F.lit(10)) < F.when(street % 100 < 50, 8).otherwise(1)
    df = stored(spark.range(600_000).select(k.alias("row_id"), F.concat(F.lit("street "), street).alias("street"), F.when(k % 3 == 0, "a").otherwise("b").alias("kind"), (k % 13).cast("double").alias("age"), F.when(went, "closed").otherwise("open").alias("state")), "streets")
    return df, model.train(df.where("row_id % 7 > 0"), "state", ["open", "closed"], ["age"], ["street", "kind"], [], "unified", 3, 3, id_col="row_id")


def test_ten_thousand_levels_are_trained_on_and_saved(spark, chain):
    df, fitted = chain
    features = fitted.stages[0].core_features
    assert features.levels.columns == ["street"] and set(features.vocab) == {"kind"} and features.columns == ["age", "kind", "street"]
    assert model.gains(spark, fitted.stages[0]).orderBy(F.desc("gain_pct")).first()["feature"] == "street"
    test = df.where("row_id % 7 = 0")
    path = scratch_path(spark, "levels-test")
    model.save_bundle(fitted, path, spark)
    loaded, _ = model.load_bundle(spark, path)
    a, b = ({r["row_id"]: r["score"] for r in model.score(test, c).select("row_id", "score").collect()} for c in (fitted, loaded))
    assert a == b and len(a) == 85_715
    assert model.evaluate(test, fitted, "row_id").first()["auc"] > 0.55
    with pytest.raises(ValueError, match="rows' id"):
        model.fit_stage(test.withColumn("y", F.lit(1)), features)


def test_a_batch_with_an_error_is_not_scored(spark, chain):
    df, fitted = chain
    pinned = stored(mapping.pins(profile.value_counts(df, ["age", "street", "kind"]), model.batch_features(fitted)), "pinned")
    batch = df.where("row_id % 7 = 0").drop("state")
    good = model.score_batch(batch.withColumn("kind", F.lit("new")), fitted, "row_id", [0.5], "b", pinned)
    assert good.count() == 85_715
    with pytest.raises(model.RefusedBatch, match="age: not_coercible"):
        model.score_batch(batch.withColumn("age", F.when(F.col("row_id") == 700, "old").otherwise("3")), fitted, "row_id", [0.5], "b", pinned)
    with pytest.raises(model.RefusedBatch, match="age: missing_feature.*kind: missing_feature"):
        model.score_batch(batch.drop("kind", "age"), fitted, "row_id", [0.5], "b", pinned)
    path = scratch_path(spark, "pins-test")
    model.save_bundle(fitted, path, spark, pinned=pinned)
    assert sorted(map(str, model.load_pinned(spark, path).collect())) == sorted(map(str, pinned.collect()))


def test_preflight_reads_each_table_once(spark):
    batch = stored(spark.createDataFrame([(None, "1", "x"), ("b", "2", "x"), ("zz", "no", None), (None, "4", "x")], "kind string, n string, more string"), "batch")
    past = stored(spark.createDataFrame([("a", "5"), ("b", "6")], "kind string, n string"), "past")
    features = {"kind": "categorical", "n": "numeric", "gone": "numeric"}
    report = mapping.preflight(profile.value_counts(batch), features, stored(mapping.pins(profile.value_counts(past), features), "pinned"))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    assert sorted(tuple(r) for r in report.collect()) == [("gone", "missing_feature", "error", 0), ("kind", "null_shift", "warning", 0), ("kind", "unseen_category", "warning", 1), ("n", "not_coercible", "error", 1)]
    assert tuple(mapping.verdict(report).first()) == (2, 2, False)
    clean = mapping.preflight(profile.value_counts(past), {"kind": "categorical"}, mapping.pins(profile.value_counts(past), {"kind": "categorical"}))
    assert tuple(mapping.verdict(clean).first()) == (0, 0, True)


def test_provenance_names_the_feature_that_tells(spark):
    k = F.col("id")
    df = spark.range(3000).select(k.alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(50)) + F.when(k % 2 == 0, 40).otherwise(0)).cast("double").alias("stamp"), (k * 31 % 17).cast("double").alias("fair"), (k * 7 % 5).cast("double").alias("other"))
    scores, _ = model.provenance_scores(df, "row_id", F.col("row_id") % 2 == 0, ["fair", "other", "stamp"], trees=3)
    s = scores.toPandas()  # noqa: F841
    want = dict(duckdb.sql("""SELECT coalesce(without, 'none'), sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*)
      FROM s a JOIN s b USING (without) WHERE a.y = 1 AND b.y = 0 GROUP BY 1 UNION ALL
      SELECT 'none', sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) FROM s a, s b WHERE a.without IS NULL AND b.without IS NULL AND a.y = 1 AND b.y = 0""").fetchall())
    found = model.provenance_features(df, "row_id", F.col("row_id") % 2 == 0, ["fair", "other", "stamp"], trees=3).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2, 3] and found[0]["feature"] == "stamp" and found[0]["fails"]
    for r in found:
        assert r["auc"] == pytest.approx(want["none"]) and r["auc_lost"] == pytest.approx(want["none"] - want[r["feature"]])
    # Each permuted feature has the same values as before.
    n = s.groupby(s["without"].fillna("none"))["row_id"].nunique()
    assert n.nunique() == 1 and len(n) == 4
