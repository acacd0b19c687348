"""Enrichment runs: resumed, logged by source and run, and assembled."""

import re
import time
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from funnelforge.operators import assemble
from funnelforge.session import scratch_path
from funnelforge.sources import enrich


def leads(spark, n=240):
    k = F.col("id")
    return spark.range(n).select(k.cast("string").alias("lead_id"), F.when(k % 12 == 7, "none").otherwise(F.concat(F.lit("0"), (6_100_000_000 + k).cast("string"))).alias("phone"))


def bureau(folder, source="tiles", bad=(), kill=None):
    """Writes a file per call; the leads ``bad`` are errors, a batch with lead ``kill`` dies."""

    def fetch(rows: pd.DataFrame) -> pd.DataFrame:
        if kill is not None and not Path(folder, "mended").exists() and kill in set(rows["lead_id"]):
            raise RuntimeError("the line went dead")
        for lead in rows["lead_id"]:
            with open(Path(folder, f"call-{lead}"), "a") as f:
                f.write("x")
        found = rows["lead_id"].astype(int) % 3 == 0
        status = found.map({True: "SUCCESS_MATCHED", False: "SUCCESS_NO_HIT"})
        status[rows["lead_id"].isin(bad)] = "ERROR"
        return pd.DataFrame({"lead_id": rows["lead_id"], "status": status, "payload_json": '{"points": ' + rows["lead_id"] + "}"})

    return enrich.Adapter(source, fetch, lambda df: df.withColumn(f"{source}_points", F.col("payload.points")), (f"{source}_points",), "points int")


def calls(folder):
    return {p.name.removeprefix("call-"): len(p.read_text()) for p in Path(folder).glob("call-*")}


def test_a_killed_run_calls_no_lead_twice(spark, tmp_path):
    root = scratch_path(spark, "log-test")
    adapter = bureau(tmp_path, kill="100")
    with pytest.raises(Exception, match="went dead"):
        enrich.resume(leads(spark), adapter, root, "r1", slices=12, batch=20)
    before = enrich.response_log(spark, root).count()
    paid = calls(tmp_path)
    # The slice under way may have called some leads whose answers are lost with its job.
    assert 0 < before < 240
    lost = set(paid) - {r["lead_id"] for r in enrich.response_log(spark, root).collect()}
    (tmp_path / "mended").touch()
    row = enrich.resume(leads(spark), adapter, root, "r1", slices=12, batch=20)
    assert (row["state"], row["rows_attempted"], row["not_sent"], row["error"]) == ("finished", 240, 20, 0)
    assert enrich.response_log(spark, root).count() == 240
    assert {k for k, n in calls(tmp_path).items() if n > 1} <= lost and len(calls(tmp_path)) == 220
    again = calls(tmp_path)
    enrich.resume(leads(spark), adapter, root, "r1", slices=12)
    assert calls(tmp_path) == again and enrich.response_log(spark, root).count() == 240
    (run,) = enrich.runs(spark, root).collect()
    assert run["matched"] == row["matched"] and run["started_at"] <= run["finished_at"]


def test_parts_of_a_run_add_up_and_errors_are_asked_again(spark, tmp_path):
    root = scratch_path(spark, "log-test")
    first = bureau(tmp_path, bad={"5", "6"})
    row = enrich.resume(leads(spark, 60), first, root, "r", slices=6, most=2, retries=1)
    assert row["state"] == "open" and 0 < row["rows_attempted"] < 60
    assert enrich.latest_responses(enrich.response_log(spark, root), enrich.runs(spark, root)).count() == 0
    row = enrich.resume(leads(spark, 60), first, root, "r", slices=6, retries=1)
    assert (row["state"], row["error"], row["rows_attempted"]) == ("finished", 2, 60)
    row = enrich.resume(leads(spark, 60), bureau(tmp_path), root, "r", slices=6)
    assert row["error"] == 0
    final = enrich.final_responses(enrich.response_log(spark, root))
    assert {(r["lead_id"], r["status"]) for r in final.where("lead_id in ('5', '6')").collect()} == {("5", "SUCCESS_NO_HIT"), ("6", "SUCCESS_MATCHED")}
    assert final.count() == 60 and assemble.repeated_responses(final).count() == 0
    once = {k for k, n in calls(tmp_path).items() if n == 1}
    assert once == set(calls(tmp_path)) - {"5", "6"}


def test_leads_that_repeat_or_have_no_id(spark, tmp_path):
    root = scratch_path(spark, "log-test")
    df = spark.createDataFrame([("1", "6100000001"), ("1", "6100000001"), (None, "6100000002"), ("2", None)], "lead_id string, phone string")
    row = enrich.resume(df, bureau(tmp_path), root, "r")
    assert (row["rows_attempted"], row["not_sent"], row["state"]) == (2, 1, "finished") and calls(tmp_path) == {"1": 1}
    empty = enrich.resume(df.where("false"), bureau(tmp_path), root, "none")
    assert (empty["rows_attempted"], empty["state"]) == (0, "finished")


def test_latest_runs_prune_the_log(spark, tmp_path):
    root = scratch_path(spark, "log-test")
    for run in ("a", "b", "c"):
        enrich.resume(leads(spark, 40), bureau(tmp_path), root, run, slices=2)
    enrich.resume(leads(spark, 40), bureau(tmp_path, "bricks"), root, "d", slices=2)
    enrich.resume(leads(spark, 400), bureau(tmp_path, "bricks"), root, "e", slices=40, most=1)
    found = enrich.latest_responses(enrich.response_log(spark, root), enrich.runs(spark, root))
    assert {(r["source"], r["run_id"]) for r in found.collect()} == {("tiles", "c"), ("bricks", "d")}
    assert found.count() == 80
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan)
    read = enrich.response_log(spark, root).where("source = 'tiles' and run_id = 'c'")
    assert "PartitionFilters: [isnotnull(source" in read._jdf.queryExecution().toString()


def test_runs_of_several_sources_are_assembled(spark, tmp_path):
    root, began = scratch_path(spark, "log-test"), datetime.now(timezone.utc).replace(tzinfo=None)
    sources = enrich.Registry(bureau(tmp_path), bureau(tmp_path, "bricks", bad={"9"}))
    seen = []
    rows = enrich.run_enrichment(leads(spark, 90), [sources["tiles"], sources["bricks"]], root, "d1", lambda s, r: seen.append((s, r["matched"])), slices=3, retries=0)
    assert [r["source"] for r in rows] == ["tiles", "bricks"] and [s for s, _ in seen] == ["tiles", "bricks"]
    out = {r["lead_id"]: r for r in enrich.assembled(leads(spark, 95), root, sources).collect()}
    assert len(out) == 95
    assert (out["6"]["tiles_points"], out["6"]["tiles_is_enriched"], out["6"]["bricks_points"]) == (6, True, 6)
    assert (out["7"]["tiles_match_status"], out["7"]["tiles_is_enriched"], out["7"]["tiles_batch_id"]) == ("NOT_SENT", False, None)
    assert (out["8"]["tiles_match_status"], out["8"]["tiles_points"]) == ("SUCCESS_NO_HIT", None)
    assert out["9"]["bricks_match_status"] == "ERROR" and out["9"]["tiles_points"] == 9
    assert (out["93"]["tiles_match_status"], out["93"]["tiles_is_enriched"]) == (None, False)
    assert all(r["tiles_fetched_at"] >= began for r in out.values() if r["tiles_match_status"])
    known, log = enrich.runs(spark, root), enrich.final_responses(enrich.response_log(spark, root))
    enrich.run_enrichment(leads(spark, 90), [sources["tiles"]], root, slices=3)
    checked = assemble.batch_invariants(enrich.runs(spark, root), enrich.final_responses(enrich.response_log(spark, root))).collect()
    assert len(checked) == 2 and all(r["counts_agree"] and r["n_repeated"] == 0 and r["spread_seconds"] >= 0 for r in checked)
    outcomes = spark.createDataFrame([("6", datetime(2020, 1, 1)), ("9", datetime(2990, 1, 1))], "lead_id string, outcome_at timestamp")
    late = {(r["source"], r["lead_id"]) for r in enrich.timing_leaks(root, outcomes).collect()}
    assert late == {("tiles", "6"), ("bricks", "6")} and known.count() == 2 and log.count() == 180


def test_registry_and_payloads(spark, tmp_path):
    sources = enrich.Registry(bureau(tmp_path))
    with pytest.raises(ValueError, match="known already"):
        sources.add(bureau(tmp_path))
    with pytest.raises(KeyError, match="known are tiles"):
        sources["straw"]
    rows = spark.createDataFrame(
        [("1", "SUCCESS_MATCHED", '{"points": 4}'), ("2", "SUCCESS_MATCHED", "[]"), ("3", "SUCCESS_NO_HIT", '{"points": 5}'), ("4", "SUCCESS_MATCHED", "no json"), ("5", "SUCCESS_MATCHED", None)], "lead_id string, status string, payload_json string"
    )
    found = {r["lead_id"]: r["tiles_points"] for r in enrich.features_of(rows, sources["tiles"]).collect()}
    assert found == {"1": 4, "2": None, "3": None, "4": None, "5": None}
    with pytest.raises(ValueError, match="gives no gone"):
        enrich.features_of(rows, enrich.Adapter("s", None, lambda df: df, ("gone",)))


def test_answers_are_looked_up_in_little_time():
    asked = pd.DataFrame({"lead_id": [str(i) for i in range(50_000)], "key": "1"})
    fetch = lambda rows: pd.DataFrame({"lead_id": rows["lead_id"], "status": "SUCCESS_NO_HIT", "payload_json": None})
    began = time.process_time()
    out = list(enrich._fetching(enrich.Adapter("s", fetch, lambda df: df), "r", 50_000, 0, 0.0)(iter([asked])))
    took = time.process_time() - began
    assert len(out[0]) == 50_000 and took < 0.5
