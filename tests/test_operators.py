"""Operators on small frames worked out by hand."""

import difflib
import json
import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from funnelforge.operators import assemble, bureau, derive, mapping, metrics, model, position, profile, split
from funnelforge.session import scratch_path, stored
from funnelforge.sources import audit, enrich, ingest


def texts(spark, **columns):
    n = max(map(len, columns.values()))
    rows = [tuple(c[i] if i < len(c) else None for c in columns.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def scored(spark, pairs):
    return spark.createDataFrame([(i, y, s if s is None else float(s)) for i, (y, s) in enumerate(pairs)], "row_id long, y int, score double")


def rows(df, *keys):
    return sorted(tuple(r[k] for k in keys) for r in df.collect())


# profiling ---------------------------------------------------------------------------


def test_near_duplicates_and_merges(spark):
    df = texts(spark, fruit=["Red  Apple"] * 4 + ["red apple"] * 7 + ["RED APPLE"] * 2, size=["large\t"] * 3 + ["large"] * 10)
    found = rows(profile.near_duplicates(profile.value_counts(df)), "col", "canonical", "n_variants", "total")
    assert found == [("fruit", "red apple", 3, 13), ("size", "large", 2, 13)]
    merged = derive.apply_merges(df, "fruit", profile.merge_suggestions(profile.value_counts(df, ["fruit"])))
    assert rows(merged.groupBy("fruit").count(), "count") == [(13,)]


def test_spelling_variants(spark):
    df = texts(spark, tree=["hornbeam"] * 9 + ["hornbean"] * 21 + ["willow"] * 40 + ["spruce"] * 12)
    assert rows(profile.spelling_variants(profile.value_counts(df)), "a", "b", "canonical") == [("hornbeam", "hornbean", "hornbean")]


def test_fuzzy_merges_equal_brute_force(spark):
    counts = {"hornbeam": 9, "hornbean": 21, "Hornbean ": 2, "willow": 40, "willows": 41, "spruce": 12, "spruces": 3, "fir": 30}
    found = rows(profile.merge_suggestions(profile.value_counts(texts(spark, tree=[v for v, n in counts.items() for _ in range(n)]))), "variant", "canonical", "confirmed")
    forms = {}
    for v, n in counts.items():
        forms.setdefault(" ".join(v.lower().split()), []).append((-n, v))
    want, best = [], {}
    for f, own in forms.items():
        best[f] = min(own)
        want += [(v, best[f][1], True) for _, v in own if v != best[f][1]]
    names = sorted((v, -n) for n, v in best.values() if len(v) >= profile.FUZZY_LENGTH)
    for i, (a, n) in enumerate(names):
        for b, m in names[i + 1 :]:
            if difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= profile.FUZZY_RATIO:
                want.append((a, b, False) if m > n else (b, a, False))
    assert found == sorted(want) and len(found) > 2


def test_alike_texts_equal_brute_force(spark):
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abcdeé ÖX") for _ in range(rng.randrange(1, 14))) for _ in range(400)})
    df = spark.createDataFrame([(c, t, k) for c in ("p", "q") for k, t in enumerate(names) if c == "p" or k % 3], "col string, text string, n long")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    want = []
    for c in ("p", "q"):
        own = [t for k, t in enumerate(names) if c == "p" or k % 3]
        want += [(c, *x) for x in sorted((round(-ratio(a, b), 9), a, b) for i, a in enumerate(own) for b in own[i + 1 :] if ratio(a, b) >= 0.7)[:40]]
    found = [(r["col"], round(-r["similarity"], 9), r["a"], r["b"]) for r in profile.alike(df, 0.7, 40, size=50).collect()]
    assert sorted(found) == sorted(want) and len(want) > 60


def test_few_pairs_are_compared():
    rng = random.Random(12)
    names = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(5, 25))) for _ in range(500)]
    names += ["abcdefgh" * 8, "abcdefgh" * 8 + "k", "abcdefgi" * 9]
    found, tried = profile._best_pairs(names, names, True, 0.65, 15)
    assert 0 < tried < len(names) ** 2 / 2 / 500 and "abcdefgh" * 8 in found[0]


def test_five_thousand_forms_take_seconds(spark):
    k = F.col("id")
    forms = spark.range(5000).select(F.concat(F.translate(F.md5(k.cast("string")).substr(1, 12), "0123456789", "ghijklmnop"), F.repeat(F.lit("z"), (k % 9).cast("int"))).alias("v"))
    vc = forms.select(F.lit("c").alias("col"), F.col("v").alias("value"), F.lit(4).cast("long").alias("n"))
    assert profile.spelling_variants(vc).count() == 0
    began = time.perf_counter()
    assert profile.spelling_variants(vc, 5000).count() == 15
    assert time.perf_counter() - began < 60


def test_sentinels_and_clusters(spark):
    """Depths of wells: 0 where a well is dry, -1 where nobody looked, and a shallow group."""
    depth = ["0"] * 7 + [f"{12.5 + k * 0.75}" for k in range(61)]
    looked = ["-1"] * 2 + ["-1.0"] + [str(3 * k + 1) for k in range(90)]
    shallow = [f"{k / 4}" for k in range(5)] + [str(77 + 2 * k) for k in range(40)]
    df = texts(spark, depth=depth, looked=looked, reach=shallow, few=["0"] * 9)
    vc = profile.value_counts(df)
    assert rows(profile.literal_sentinels(vc), "col", "sentinel", "count") == [("depth", 0.0, 7), ("looked", -1.0, 3), ("reach", 0.0, 1)]
    clusters = {r["col"]: r for r in profile.low_clusters(vc).collect()}
    assert (clusters["reach"]["count"], clusters["reach"]["low_max"], clusters["reach"]["high_min"]) == (5, 1.0, 77)


@pytest.mark.parametrize(
    ("values", "verdict"),
    [
        (["3.11.1987", "19.6.2001", "4.4.1999"], "day_first"), (["6-30-2011", "7-4-2012"], "month_first"), (["5/6/2019", "7/8/2020", "9/9/2021"], "ambiguous"),
        (["14.2.2003", "2.14.2003", "1.1.2003"], "mixed"), (["9 august 1975", "31 Dec 08"], "text_month"), (["1999-12-31", "2001-03-02"], "day_first"), (["7/7", "soon", "12:30"], None),
    ],
)
def test_date_formats(spark, values, verdict):
    found = profile.date_formats(profile.value_counts(texts(spark, dob=values))).collect()
    assert (found[0]["inference"] if found else None) == verdict


def test_identifiers_multi_values_and_free_text(spark):
    meters = [f"{40000 + 13 * k}.0" if k % 3 else f"M{k}" for k in range(36)]
    crops = ["rye|oats", "oats|rye", "rye", "barley|oats|rye"] * 7
    df = texts(spark, meter=meters, floor=[f"{k % 4}.0" for k in range(36)], crops=crops, soil=["sand, loam"] * 30, remark=[f"seen in week {k}, dry" for k in range(36)])
    vc = profile.value_counts(df)
    assert [(r["col"], round(r["fraction"], 3)) for r in profile.float_identifiers(vc).collect()] == [("meter", 0.667)]
    assert rows(profile.multi_valued(vc), "col", "delimiter", "n_components", "order_varies") == [("crops", "|", 3, True), ("remark", ",", 37, False), ("soil", ",", 2, False)]
    assert {r["col"] for r in profile.free_text(vc).collect()} == {"meter", "remark"}


def test_empty_tables(spark):
    empty = texts(spark, a=["x"], b=["1"]).limit(0)
    vc = profile.value_counts(empty)
    for f in (profile.blank_rates, profile.infer_schema, profile.near_duplicates, profile.low_clusters, profile.numeric_distribution, profile.multi_valued, profile.free_text, profile.date_formats):
        assert f(vc).count() == 0
    assert profile.overview(empty).first()["n_rows"] == 0
    assert profile.fingerprint(empty).first()["n_rows"] == 0


def test_fingerprint_ignores_order_and_sees_nulls(spark):
    a = texts(spark, x=["1", None, "2"], y=["a", "b", "c"])
    b = a.orderBy(F.desc("y"))
    assert profile.fingerprint(a).collect() == profile.fingerprint(b).collect()
    assert profile.fingerprint(a).collect() != profile.fingerprint(a.fillna("")).collect()


def test_numeric_distribution_matches_exact_percentiles(spark):
    df = texts(spark, v=[str(k * k % 97) for k in range(101)])
    got = {r["metric"]: r["value"] for r in profile.numeric_distribution(profile.value_counts(df)).collect()}
    want = df.select(F.percentile(F.col("v").cast("double"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))).first()[0]
    assert [got["p5"], got["p50"], got["p95"]] == pytest.approx(want) and got["count"] == 101


def test_profile_plans_read_their_counts_once(spark):
    """Findings of several steps scan the counts once; what they build on is stored."""
    vc = profile.value_counts(texts(spark, a=["1; 2", "2; 1", "3", "4"], b=["5", "6", "7", "8"]))
    for f, most in ((profile.multi_valued, 5), (profile.low_clusters, 5), (profile.numeric_distribution, 8)):
        plan = f(vc)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") + plan.count("LogicalRDD") <= most, f


# positions, metrics ------------------------------------------------------------------


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 2, 0, 0.1), (None, 3, 1, 0.8), (None, 4, 0, 0.2)], "g string, row_id long, y int, score double")
    placed = metrics.ordered(df, ["g"])
    assert rows(placed, "row_id", "position", "rows") == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 2, 2)]
    assert {r["g"]: r["average_precision"] for r in metrics.pr_auc(placed, ["g"]).collect()} == {"a": 1.0, None: 1.0}
    assert metrics.tier_table(placed, 2, ["g"]).count() == metrics.capture_thresholds(placed, (0.5, 1.0), ["g"]).count() == 4
    values = spark.createDataFrame([("a", 1.0, 1), (None, 3.0, 2), (None, 5.0, 1)], "g string, v double, n long")
    assert {r["g"]: r["quantile"] for r in position.quantiles(values, ["g"], "v", "n", (0.5,)).collect()} == {"a": 1.0, None: 3.0}


def test_ordered_position_spreads_and_agrees(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).alias("v"), "id")
    placed = position.ordered_position(df.repartition(16), ["g"], [F.desc("v"), F.asc("id")])
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r["g"], -r["v"], r["id"])):
        want.setdefault(r["g"], []).append(r["id"])
    assert {r["id"]: r["position"] for r in placed.collect()} == {i: k for ids in want.values() for k, i in enumerate(ids, 1)}


def test_auc(spark):
    assert metrics.roc_auc(scored(spark, [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.3), (0, 0.2), (0, 0.1)])).first()["auc"] == 1.0
    assert metrics.roc_auc(scored(spark, [(1, 0.5), (0, 0.5)])).first()["auc"] == 0.5
    assert metrics.roc_auc(scored(spark, [(1, 0.5)])).first()["auc"] is None


def test_log_loss_and_brier(spark):
    assert metrics.benchmark_metrics(scored(spark, [(1, 0.8), (0, 0.2)])).first()["log_loss"] == pytest.approx(0.2231, abs=1e-4)
    assert metrics.benchmark_metrics(scored(spark, [(1, 0.8), (0, 0.3)])).first()["brier"] == pytest.approx(0.065)


def test_tiers_lift_and_capture(spark):
    """63 rows in 7 tiers of 9: positives are those whose rank from the top is a square."""
    squares = {k * k for k in range(1, 8)}
    placed = metrics.ordered(scored(spark, [(int(rank in squares), 64 - rank) for rank in range(1, 64)]))
    tiers = metrics.tier_table(placed, 7)
    assert rows(tiers, "tier", "n", "n_positive") == [(1, 9, 3), (2, 9, 1), (3, 9, 1), (4, 9, 1), (5, 9, 0), (6, 9, 1), (7, 9, 0)]
    found = metrics.lift(tiers, 7).first()
    assert found["lift"] == pytest.approx(3 / 9 / (7 / 63)) and found["ratio"] is None and found["status"] != "ok"
    assert rows(metrics.capture_thresholds(placed, (0.4, 0.5, 1.0)), "share", "population_pct") == [(0.4, 100 * 9 / 63), (0.5, 100 * 16 / 63), (1.0, 100 * 49 / 63)]
    for n, k in ((50, 7), (11, 4), (3, 5)):
        sizes = [r["n"] for r in metrics.tier_table(metrics.ordered(scored(spark, [(i % 2, i) for i in range(n)])), k).collect()]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_assign_tier(spark):
    cut = [0.625, 0.25]
    got = scored(spark, [(0, s) for s in (0.75, 0.625, 0.5, 0.25, 0.125)] + [(1, None)]).select(metrics.assign_tier(F.col("score"), cut).alias("t")).collect()
    assert [r["t"] for r in got] == [1, 1, 2, 2, 3, None]


def test_bootstrap_interval_holds_the_ratio(spark):
    tiers = spark.createDataFrame([(1, 100, 60), (2, 100, 10)], "tier long, n long, n_positive long")
    found = metrics.bootstrap_ratio(tiers, 2, 500).first()
    assert found["low"] < 6 < found["high"]
    assert metrics.bootstrap_ratio(tiers.replace(10, 30), 2, 500).count() == 0


# splits ------------------------------------------------------------------------------


def parcels(spark, n=630):
    """Parcels of depots of very unlike sizes; one depot has a single one."""
    k = F.col("id")
    depot = F.when(k == 17, "lone").otherwise(F.concat(F.lit("depot"), (k * k % 7).cast("string")))
    return spark.range(n).select(k.alias("parcel"), depot.alias("depot"), (k * k % 11 == 3).cast("int").alias("late"), F.floor(k / 9).alias("truck"))


def halves(n, size):
    """``n * size`` rounded, halves to the even number."""
    return round(n * size)


def test_splits_take_their_share_of_each_part(spark):
    df = parcels(spark).cache()
    known = {r["parcel"]: r for r in df.collect()}
    for size in (0.15, 0.4):
        cut = {r["row_id"]: r["side"] for r in split.random_split(df, "parcel", size, seed=5).collect()}
        assert set(cut) == set(known) and list(cut.values()).count("test") == halves(630, size)
        cut = {r["row_id"]: r["side"] for r in split.stratified_split(df, "parcel", ["depot", "late"], size, seed=5).collect()}
        parts = {}
        for i, r in known.items():
            parts.setdefault((r["depot"], r["late"]), []).append(cut[i])
        for key, sides in parts.items():
            n = len(sides)
            assert sides.count("test") == (0 if n < 2 else min(max(halves(n, size), 1), n - 1)), key
        cut = {r["row_id"]: r["side"] for r in split.grouped_split(df, "parcel", "truck", size, seed=5).collect()}
        trucks = {}
        for i, r in known.items():
            trucks.setdefault(r["truck"], set()).add(cut[i])
        assert all(len(s) == 1 for s in trucks.values()) and sum(s == {"test"} for s in trucks.values()) == halves(70, size)


def test_splits_do_not_depend_on_the_order_of_rows(spark):
    df = parcels(spark)
    for cut in (lambda d: split.random_split(d, "parcel"), lambda d: split.stratified_split(d, "parcel", ["depot"]), lambda d: split.grouped_split(d, "parcel", "truck")):
        one, two = cut(df), cut(df.orderBy(F.desc("late"), "depot").repartition(5))
        assert sorted(one.collect()) == sorted(two.collect())
        assert split.split_check(df, one, "parcel").first().asDict() == {"overlap": 0, "uncovered": 0}
    assert sorted(split.random_split(df, "parcel", seed=1).collect()) != sorted(split.random_split(df, "parcel", seed=2).collect())


def test_strata_of_one_row_are_split_together(spark):
    kinds = ["elm"] * 7 + ["oak"] * 3 + [f"tree{k}" for k in range(6)]
    df = spark.createDataFrame(list(enumerate(kinds)), "n long, kind string")
    sides = {r["row_id"]: r["side"] for r in split.stratified_split(df, "n", ["kind"], 0.34).collect()}
    assert [[sides[i] for i in range(a, b)].count("test") for a, b in ((0, 7), (7, 10), (10, 16))] == [2, 1, 2]


def test_split_errors(spark):
    df = texts(spark, id=["1", "2"], ts=["2024-01-01", "no date"], g=["a", None])
    with pytest.raises(Exception, match="no date"):
        split.temporal_split(df, "id", "ts", "2024-01-01").collect()
    with pytest.raises(Exception, match="g is null"):
        split.grouped_split(df, "id", "g").collect()


# mapping, assembly -------------------------------------------------------------------


def test_mapping_takes_the_first_solid_value(spark):
    df = texts(spark, cell=["\t", "77", "", None], home=["55", " 66", None, "  "], work=["1", "2", " ", "\n"], town=["Ulm", "Bonn", "Graz", None])
    found = mapping.apply_mapping(df, {"reach": ["cell", "home", "work"], "place": ["town"]})
    assert [tuple(r) for r in found.collect()] == [("55", "Ulm"), ("77", "Bonn"), (" ", "Graz"), ("\n", None)]
    kept = mapping.apply_mapping(df, {"reach": ["home"]})
    assert kept.columns == ["reach", "extra__cell", "extra__work", "extra__town"]


def test_canonical_issues_have_severities(spark):
    """Boats: an id that repeats, call signs that are no phones, and days of either order."""
    df = texts(spark, hull=["a1", "a1", "b2", None, " "], phone=["0170 1234567890", "x-12", "77", "", None], created_at=["3/4/2020", "5/6/2021", "5/6/2021", None, "7/7/2022"])
    fields = [mapping.Field("hull", "always", True), mapping.Field("skipper", "always"), mapping.Field("fate", "train"), mapping.Field("note")]
    found = sorted(tuple(r) for r in mapping.canonical_issues(df, fields, True).collect())
    assert found == [
        ("ambiguous_date_needs_confirmation", "created_at", "error", 0, 0, ""), ("duplicate_value", "hull", "error", 1, 2, ""), ("low_phone_match_rate", "phone", "error", 2, 3, "77|x-12"),
        ("missing_required_field", "fate", "error", 0, 0, ""), ("missing_required_field", "skipper", "error", 0, 0, ""),
    ]
    calm = mapping.canonical_issues(df, fields[:1], False, day_first=False, least_phones=0.3)
    assert [tuple(r) for r in calm.collect()] == [("duplicate_value", "hull", "error", 1, 2, "")]
    late = texts(spark, hull=["a", "b", "c", "d"], created_at=["30/1/2020", "2/3/2021", "soon", "31/3/2019"])
    assert [tuple(r) for r in mapping.canonical_issues(late, fields[:1], False).collect()] == [("unparsed_created_at", "created_at", "warning", 1, 4, "")]
    assert mapping.canonical_issues(texts(spark, hull=["a"]).limit(0), fields[:1], False).count() == 0


def test_findings_count_a_table_once(spark):
    df = stored(texts(spark, a=["x;y", "y;x", "Z", "z"], b=["1", "2", "3", "4"]), "found")
    plan = mapping.compare_findings(mapping.findings(df), mapping.findings(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "found-" not in plan and "Expand" not in plan


def test_numbers_are_counted_as_numbers(spark):
    df = spark.createDataFrame([(1, 2.5, "7"), (1, float("nan"), "x"), (None, 2.5, "7.0")], "a int, b double, c string")
    assert rows(profile.numbers(df, ["a", "b", "c"]), "col", "v", "n") == [("a", 1.0, 2), ("b", 2.5, 2), ("c", 7.0, 2)]
    assert "like" not in profile.numbers(df, ["a", "b"])._jdf.queryExecution().toString().lower()


def test_assembly_keeps_rows_and_rejects_repeats(spark):
    spine = texts(spark, lead_id=["1", "2", "3"])
    frame = spark.createDataFrame([("1", 5, True), ("9", 6, True)], "lead_id string, f int, s_is_enriched boolean")
    assert rows(assemble.assemble(spine, {"s": frame}), "lead_id", "s_is_enriched") == [("1", True), ("2", False), ("3", False)]
    with pytest.raises(Exception, match="several responses"):
        assemble.assemble(spine, {"s": frame.union(frame)}).collect()


def report(accounts, score="700"):
    return {"data": {"cCRResponse": {"cIRReportDataLst": [{"cIRReportData": {"retailAccountDetails": accounts, "scoreDetails": [{"value": score, "scoringElements": []}]}}]}}}


def log(spark, payloads):
    return spark.createDataFrame([("r", str(i), "SUCCESS_MATCHED", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "run_id string, lead_id string, status string, payload_json string")


def test_bureau_features(spark):
    accounts = [
        {"accountType": "Personal Loan", "institution": "HDFC", "sanctionAmount": "1,000", "balance": 500, "accountStatus": "Current", "dateReported": "01/01/2024", "dateOpened": "2020-01-01", "history48Months": [{"suitFiledStatus": "*"}, {"suitFiledStatus": "Suit"}]},
        {"accountType": "Gold Loan", "institution": "Muthoot", "sanctionAmount": "3000", "balance": 0, "accountStatus": "Closed", "dateReported": "01/12/2023", "dateOpened": "2023-01-01"},
    ]
    payloads = [report(accounts), report([], "-1"), "{}", "[]", "not json", {"data": []}, report(None)]
    out = {r["lead_id"]: r for r in bureau.features(log(spark, payloads)).collect()}
    assert len(out) == len(payloads)
    one = out["0"]
    assert (one["equifax_total_accounts"], one["equifax_active_accounts"], one["equifax_active_pct"]) == (2, 1, 50.0)
    assert (one["equifax_oldest_account_age_months"], one["equifax_newest_account_age_months"], one["equifax_average_account_age_months"]) == (48, 12, 30.0)
    assert (one["equifax_pct_of_total_sanctioned_amount_gold"], one["equifax_credit_diversity_index"], one["equifax_suit_filed_status_values"]) == (75.0, 50.0, "Suit")
    assert (one["equifax_score"], one["equifax_is_premium"]) == (700.0, "Mainstream")
    none = out["1"]
    assert (none["equifax_score"], none["equifax_total_accounts"], none["equifax_active_pct"], none["equifax_total_sanction_amount"], none["equifax_suit_filed_status_values"]) == (None, 0, None, None, None)
    for i in "2345":
        assert all(v is None for k, v in out[i].asDict().items() if k.startswith("equifax_")), i


def test_each_account_is_classified_once(spark):
    found = bureau.accounts(bureau.parsed(log(spark, [report([])])))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("asset reconstruction") == 1


def test_amounts_are_numbers_or_nothing(spark):
    from funnelforge.functions.bureau import amount

    df = texts(spark, a=["1,204.5", " 7 ", "1d", "2f", "nan", "", None, "-3", "x"])
    assert [r["v"] for r in df.select(amount(F.col("a")).alias("v")).collect()] == [1204.5, 7.0, 0.0, 0.0, 0.0, 0.0, 0.0, -3.0, 0.0]


# funnels -----------------------------------------------------------------------------


def test_funnel_flags_and_stage_rows(spark):
    order = ["seed", "sprout", "bloom", "fruit"]
    df = texts(spark, d=["sprout ", "fruit", "seed", "bloom", "bloom", "weed", " ", None, "seed"])
    flags = derive.funnel_stages(df, "d", order)
    assert [r["reached_sprout"] for r in flags.collect()] == [1.0, 1.0, 0.0, 1.0, 1.0, None, None, None, 0.0]
    assert [r["reached_fruit"] for r in flags.collect()] == [0.0, 1.0, 0.0, 0.0, 0.0, None, None, None, 0.0]
    assert [sorted(r["y"] for r in derive.stage_rows(df, "d", order, k).collect()) for k in range(3)] == [[0, 0, 1, 1, 1, 1], [0, 1, 1, 1], [0, 0, 1]]
    assert rows(derive.funnel_report(df, "d", order), "kind", "value", "n") == [("stage", "bloom", 2), ("stage", "fruit", 1), ("stage", "seed", 2), ("stage", "sprout", 1), ("unmapped", "weed", 1)]


# models ------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_ages_are_whole_days_to_the_microsecond(spark, kind):
    times = ["2024-01-25 00:00:00", "2024-01-25 00:00:00.000001", "2024-01-18 00:00:00.7", "2024-02-01 00:00:00.5", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast(kind).alias("t"))
    found = derive.outcome_by_age(df, F.col("t"), F.lit(True), "2024-02-01")
    assert rows(found, "bin", "n") == [("[0,7)", 1), ("[7,14)", 2)]


def test_chain_is_ordinal_saved_and_blended(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), F.element_at(F.array(*map(F.lit, ["seed", "sprout", "bloom"])), (F.col("id") % 3 + 1).cast("int")).alias("d"), (F.col("id") % 3 * 10 + F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") % 3 * 1.0).alias("rich"), F.when(F.col("id") % 5 > 0, F.lit("A")).alias("c"))
    order = ["seed", "sprout", "bloom"]
    chain = model.train(df, "d", order, ["x", "rich"], ["c"], ["rich"], "dual", trees=2, depth=2)
    assert chain.stages[0].rich is not None
    path = scratch_path(spark, "bundle-test")
    model.save_bundle(chain, path, spark, {"cutoffs": [0.5]})
    loaded, extra = model.load_bundle(spark, path)
    batch = df.withColumn("c", F.when(F.col("row_id") % 9 == 0, "NEW").otherwise(F.col("c"))).withColumn("p", F.lit("kept"))
    a, b = (sorted(tuple(r) for r in model.score(batch, m).select("row_id", "stage_0", "stage_1", "score", "p").collect()) for m in (chain, loaded))
    assert a == b and extra == {"cutoffs": [0.5]} and len(a) == 600
    assert model.ordinal_violations(model.score(batch, loaded), ["stage_0", "stage_1"]).first()["n"] == 0
    assert min(r["auc"] for r in model.evaluate(df, chain, "row_id").collect()) > 0.8
    with pytest.raises(Exception, match="missing features: x"):
        model.score(batch.drop("x"), loaded)
    with pytest.raises(Exception):
        model.save_bundle(chain, path, spark)


def test_provenance_leak_is_found(spark):
    df = spark.range(800).select(F.col("id").alias("row_id"), (F.col("id") % 2 == 0).alias("batch"), (F.col("id") % 2 * 5 + F.col("id") % 3).cast("double").alias("leaky"), (F.col("id") * 7919 % 101).cast("double").alias("fair"))
    assert model.provenance(df, "row_id", F.col("batch"), ["leaky"], trees=2).first()["fails"]
    assert not model.provenance(df, "row_id", F.col("batch"), ["fair"], trees=2).first()["fails"]


# files, audit, enrichment ------------------------------------------------------------


def test_encodings_and_malformed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfa,b,c\n1,2,3\n4,5,6,extra\n7,8\n9,\"10,x\",011\n")
    (tmp_path / "b.txt").write_bytes("a|b\ncafé|1\n".encode("latin-1"))
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in ingest.files(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.csv": "utf-8-sig", "b.txt": "latin-1"}
    path = f"file://{tmp_path}/a.csv"
    assert rows(ingest.read_delimited(spark, path).fillna("-"), "a", "b", "c") == [("1", "2", "3"), ("7", "8", "-"), ("9", "10,x", "011")]
    seen = ingest.lines(spark, path)
    assert ingest.detect_delimiter(seen).first()["delimiter"] == ","
    assert ingest.malformed_report(ingest.malformed_rows(seen, ",", 3)).first()["n"] == 2
    assert rows(ingest.read_delimited(spark, f"file://{tmp_path}/b.txt", "|", "latin-1"), "a", "b") == [("café", "1")]


def test_datasets_are_written_once(spark):
    root = scratch_path(spark, "audit-test")
    df = texts(spark, a=["1", "2"])
    audit.save_dataset(df, f"{root}/d")
    with pytest.raises(Exception):
        audit.save_dataset(df, f"{root}/d")
    first = audit.register_dataset(df, root, "raw")
    audit.register_dataset(df, root, "clean", first)
    assert rows(spark.read.parquet(f"{root}/datasets").fillna("-"), "name", "n_rows") == [("clean", 2), ("raw", 2)]


def test_enrichment_answers_for_every_lead(spark):
    def flaky(frame):
        out = frame.assign(status="SUCCESS_MATCHED", payload_json="{}")
        out.loc[out["key"].str.endswith("9"), "status"] = "ERROR"
        return out[~out["key"].str.endswith("8")][["lead_id", "status", "payload_json"]]

    df = texts(spark, lead_id=["1", "2", "3", "4"], phone=["7000000001", "7000000009", "7000000008", "x"])
    got = enrich.run_source(df, enrich.Adapter("s", flaky, lambda d: d), "run", retries=2)
    assert rows(got, "lead_id", "status", "attempts") == [("1", "SUCCESS_MATCHED", 1), ("2", "ERROR", 3), ("3", "ERROR", 3), ("4", "NOT_SENT", 0)]


# scratch -----------------------------------------------------------------------------


def test_scratch_scopes_of_threads_are_their_own(spark):
    from funnelforge.session import scratch_scope, stored

    begun, made, out = threading.Event(), threading.Event(), {}

    def other():
        begun.wait(60)
        out["free"] = stored(spark.range(7), "free")
        with scratch_scope(spark):
            out["inner"] = stored(spark.range(5), "inner").count()
        made.set()

    worker = threading.Thread(target=other)
    worker.start()
    with scratch_scope(spark):
        begun.set()
        assert made.wait(120)
        mine = stored(spark.range(3), "mine")
        with scratch_scope(spark):
            stored(spark.range(2), "nested")
        assert mine.count() == 3
    worker.join()
    assert out["free"].count() == 7 and out["inner"] == 5
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST"):
        mine.collect()


def test_scratch_scope_deletes_what_it_made(spark):
    from funnelforge.session import scratch_scope, stored

    kept = stored(spark.range(3).toDF("a"), "kept")
    with scratch_scope(spark):
        gone = stored(spark.range(3).toDF("a"), "gone")
        assert gone.count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_files_of_different_layouts_are_read_by_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"id","full, name"\n1,"x\ny"\n2,"say ""hi"""\n')
    (tmp_path / "b.csv").write_bytes("id|città\n3|Forlì\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("\ufeffid;full, name\n4;zed\n".encode())
    out = ingest.read_files(spark, f"{tmp_path}/*.csv", multiline=True)
    assert set(out.columns) == {"id", "full, name", "città"}
    got = {r["id"]: (r["full, name"], r["città"]) for r in out.collect()}
    assert got == {"1": ("x\ny", None), "2": ('say "hi"', None), "3": (None, "Forlì"), "4": ("zed", None)}


# enrichment, mapping, splits and models in one call ----------------------------------


def test_the_last_of_several_answers_counts(spark):
    def fetch(pdf):
        twice = pdf[["lead_id"]].assign(status="SUCCESS_NO_HIT", payload_json=None)
        return pd.concat([twice, twice.assign(status="SUCCESS_MATCHED", payload_json="{}")])

    leads = spark.createDataFrame([("1", "7000000001"), ("2", "7000000002"), ("3", None)], "lead_id string, phone string")
    log = enrich.run_source(leads, enrich.Adapter("s", fetch, lambda df: df), "r")
    assert rows(log, "lead_id", "status", "attempts") == [("1", "SUCCESS_MATCHED", 1), ("2", "SUCCESS_MATCHED", 1), ("3", "NOT_SENT", 0)]


def test_suggestions_equal_brute_force(spark):
    names = ["Phone No.", "phone", "mobile number", "Created", "creation date", "xyz", "fone"]
    aliases = {"phone": ["mobile number", "contact"], "created_at": ["creation date", "lead date"]}
    df = spark.createDataFrame([(f, n) for f in ("one", "two") for n in names if f == "one" or n != "phone"], "file string, column string")
    found = mapping.suggest_mapping(df, aliases).collect()
    plain = lambda x: "".join(c for c in x.lower() if c.isalnum())
    want = []
    for file in ("one", "two"):
        for field, more in aliases.items():
            known = [plain(a) for a in [field, *more]]
            tried = [(0.95 if plain(n) in known else max(difflib.SequenceMatcher(None, plain(n), a).ratio() for a in known), n) for n in names if file == "one" or n != "phone"]
            best = sorted(((-r, n) for r, n in tried if r >= 0.55))
            want += [(file, field, k, n, round(-r, 3)) for k, (r, n) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_split_in_one_call_is_saved_and_loaded(spark):
    df = spark.range(200).select("id", (F.col("id") % 4).cast("string").alias("kind"), (F.col("id") >= 150).cast("int").alias("y"), F.col("id").alias("day")).union(spark.createDataFrame([(900, "rare", 0, 0)]))
    done = split.split_dataset(df, "id", "stratified", strata=["kind"])
    assert sum(done.rows.values()) == 201 and done.warnings == ["1 strata of one row are one stratum"] and done.composition.count() == 5
    late = split.split_dataset(df, "id", "period", period_col="day", periods=list(range(150, 200)), target=F.col("y"))
    assert late.rows == {"train": 151, "test": 50} and "base rate" in late.warnings[0]
    path = scratch_path(spark, "split-test")
    split.save_split(done, path)
    back = split.load_split(spark, path)
    assert (back.rows, back.warnings) == (done.rows, done.warnings) and sorted(back.ids.collect()) == sorted(done.ids.collect())
    with pytest.raises(Exception, match="(?i)exists"):
        split.save_split(done, path)
    for bad, match in (({"strategy": "no"}, "unknown"), ({"size": 1.0}, "size"), ({"strategy": "grouped"}, "needs group_col"), ({"columns": ["z"]}, "no such column")):
        with pytest.raises(ValueError, match=match):
            split.split_dataset(df, "id", **bad)
    with pytest.raises(ValueError, match="repeat"):
        split.split_dataset(df.union(df), "id")
    with pytest.raises(ValueError, match="nothing"):
        split.split_dataset(df.limit(0), "id")


@pytest.fixture(scope="module")
def funnel(spark):
    """Rows of three levels with a core number, an enriched one and a category of many levels."""
    level = F.when(F.col("id") % 10 < 5, "A").when(F.col("id") % 10 < 8, "B").otherwise("C")
    k = F.when(level == "A", 0).when(level == "B", 1).otherwise(2)
    return spark.range(600).select("id", level.alias("stage"), (F.col("id") * 7919 % 101 + 20 * k).cast("double").alias("core"), F.when(F.col("id") % 3 == 0, 10.0 * k + F.col("id") % 7).alias("rich"), F.concat(F.lit("c"), F.col("id") % 150).alias("cat"))


def test_training_in_one_call_reports_gates_and_warnings(spark, funnel):
    done = model.train_run(funnel, "stage", ["A", "B", "C"], ["core", "rich"], ["cat"], ["rich"], "dual", 2, 2, formulas={"small": F.col("core") < 50}, id_col="id", batch=F.col("id") % 3 == 0)
    gates = {g.name: g.passed for g in done.gates}
    assert gates["target_leakage"] and gates["post_event_features"] and not gates["formula:small"] and not gates["provenance"]
    assert done.null_rates["rich"] == pytest.approx(2 / 3) and done.null_rates["cat"] == 0 and done.warnings == []
    assert done.chain.stages[0].core_features.levels.columns == ["cat"] and done.chain.stages[0].rich is not None
    few = model.train_run(funnel.where("id < 80"), "stage", ["A", "B", "C"], ["core", "rich"], [], ["rich"], "dual", 1, 1)
    assert [w.split(":")[0] for w in few.warnings] == ["stage 0", "stage 1", "stage 0", "stage 1"]
    with pytest.raises(model.LeakageError, match="target"):
        model.train_run(funnel, "stage", ["A", "B", "C"], ["core"], ["stage"], [])
    assert not model.feature_gates("stage", ["closure_days"])[1].passed


def test_evaluation_in_one_call(spark, funnel):
    chain = model.train(funnel.where("id % 2 = 0"), "stage", ["A", "B", "C"], ["core", "rich"], [], ["rich"], trees=3, depth=2)
    found = model.evaluate_run(funnel.where("id % 2 = 1"), chain, "id", 5)
    assert rows(found["metrics"], "stage", "n") == [(0, 300), (1, 120 + 30)] or found["metrics"].count() == 2
    tiers = rows(found["tiers"], "stage", "tier", "n")
    assert [t[:2] for t in tiers] == [(s, t) for s in (0, 1) for t in range(1, 6)] and sum(n for s, _, n in tiers if s == 0) == 300
    assert rows(found["cutoffs"].groupBy("stage").count(), "stage", "count") == [(0, 4), (1, 4)]
    assert found["lift"].count() == 2 and found["capture"].count() == 8


def test_models_train_on_the_index_that_encode_makes(spark, funnel):
    f = model.pin(funnel, ["core"], ["cat"])
    fitted = model.fit_stage(funnel.withColumn("y", (F.col("stage") == "A").cast("int")), f, 2, 2)
    assert "cat__index" in fitted.stages[0].getInputCols()
    coded = model.encode(model.project(funnel, f, ["id"]), f)
    assert coded.schema["cat__index"].metadata["ml_attr"]["type"] == "nominal" and coded.where("cat__index > 100").isEmpty()


def test_columns_of_a_role(spark):
    df = spark.createDataFrame([("1", "5", "x", "y")], "id string, n string, c string, t string")
    schema = profile.infer_schema(profile.value_counts(df), {"id": "id", "t": "target"})
    assert profile.columns_of_role(df, schema, "feature").columns == ["c", "n"]
    assert profile.columns_of_role(df, schema, "feature", "numeric", ("id",)).columns == ["id", "n"]
