"""Fetching responses for leads from user functions, into a log that a run can resume.

The log is a table partitioned by source and run, so that readers of some runs read the
files of these alone. A run is written slice by slice: what a slice has fetched is there
for good once its job ends, and a call that finds answers in the log does not ask again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelforge.functions.scalars import phone
from funnelforge.operators import assemble
from funnelforge.session import scratch_path
from funnelforge.sources import audit

RESPONSES = "run_id string, lead_id string, source string, status string, payload_json string, batch_id string, attempts int, fetched_at timestamp"
_COLUMNS = ["run_id", "lead_id", "source", "status", "payload_json", "batch_id", "attempts", "fetched_at"]
RUNS = "run_id string, source string, dataset_id string, rows_attempted long, matched long, no_hit long, error long, not_sent long, started_at timestamp, finished_at timestamp, state string"

#: Answers that are not asked for again.
FINAL = ("SUCCESS_MATCHED", "SUCCESS_NO_HIT", "NOT_SENT")
MATCHED = "SUCCESS_MATCHED"

#: Takes (lead_id, key) rows, gives (lead_id, status, payload_json) rows.
Fetch = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Adapter:
    """V1: a source: how to fetch its responses and how to turn them into features.

    ``payload`` is the schema of a matched response's JSON; where it is given, ``transform``
    gets the parsed column ``payload``. ``features`` are the columns that ``transform`` adds.
    """

    source: str
    fetch: Fetch
    transform: Callable[[DataFrame], DataFrame]
    features: tuple[str, ...] = ()
    payload: str | None = None


class Registry:
    """V1: the sources that are known, by name."""

    def __init__(self, *adapters: Adapter):
        self._known: dict[str, Adapter] = {}
        for a in adapters:
            self.add(a)

    def add(self, adapter: Adapter) -> None:
        if adapter.source in self._known:
            raise ValueError(f"source {adapter.source!r} is known already")
        self._known[adapter.source] = adapter

    def __getitem__(self, source: str) -> Adapter:
        if source not in self._known:
            raise KeyError(f"unknown source {source!r}; known are {', '.join(sorted(self._known))}")
        return self._known[source]

    def names(self) -> list[str]:
        return sorted(self._known)


def features_of(responses: DataFrame, adapter: Adapter) -> DataFrame:
    """V1: the responses of a source with its features. Only matched responses are parsed;
    a payload of another shape gives nulls."""
    rows = responses
    if adapter.payload:
        rows = rows.withColumn("payload", F.from_json(F.when(F.col("status") == MATCHED, F.col("payload_json")), adapter.payload))
    found = adapter.transform(rows)
    lacking = [c for c in (*adapter.features, "lead_id", "status") if c not in found.columns]
    if lacking:
        raise ValueError(f"{adapter.source} gives no {', '.join(lacking)}")
    return found.drop("payload") if adapter.payload else found


def _fetching(adapter: Adapter, run_id: str, batch: int, retries: int, wait: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Fetches (lead_id, key) rows in batches; each batch's answers carry the time of the
    attempt that gave them."""

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            blank = pdf["key"].isna()
            now = datetime.now(timezone.utc)
            out = [pdf[blank][["lead_id"]].assign(status="NOT_SENT", payload_json=None, batch_id=None, attempts=0, fetched_at=now)]
            todo = pdf[~blank]
            for k in range(0, len(todo), batch):
                pending, pause, got = todo.iloc[k : k + batch], wait, {}
                name = f"{run_id}-{pending['lead_id'].iloc[0]}"
                for attempt in range(1, retries + 2):
                    answers = adapter.fetch(pending)
                    # Of several answers for a lead the last one stays.
                    found = dict(zip(answers["lead_id"], zip(answers["status"], answers["payload_json"], strict=True), strict=True))
                    now = datetime.now(timezone.utc)
                    for lead in pending["lead_id"]:
                        status, payload = found.get(lead, ("ERROR", None))
                        got[lead] = (lead, status, payload, name, attempt, now)
                    pending = pending[[got[x][1] == "ERROR" for x in pending["lead_id"]]]
                    if pending.empty or attempt > retries:
                        break
                    time.sleep(pause)
                    pause *= 2
                out.append(pd.DataFrame(list(got.values()), columns=["lead_id", "status", "payload_json", "batch_id", "attempts", "fetched_at"]))
            yield pd.concat([x for x in out if len(x)] or out).assign(run_id=run_id, source=adapter.source)[_COLUMNS]

    return fetch


def _keyed(leads: DataFrame, key_col: str) -> DataFrame:
    """(lead_id, key): a lead that repeats is one; leads without an id are left out."""
    rows = leads.select(F.col("lead_id").cast("string").alias("lead_id"), phone(F.col(key_col)).alias("key")).where("lead_id is not null")
    return rows.groupBy("lead_id").agg(F.min("key").alias("key"))


def run_source(leads: DataFrame, adapter: Adapter, run_id: str, key_col: str = "phone", batch: int = 100, retries: int = 2, wait: float = 0.0, parts: int | None = None) -> DataFrame:
    """V2: one response per lead: run_id, lead_id, source, status, payload_json, batch_id,
    attempts, fetched_at.

    Keys are normalised; leads without one are NOT_SENT and not fetched. ``ERROR`` is tried
    again up to ``retries`` times, waiting twice as long each time. A lead for which the
    function gives nothing is an ERROR; of several answers for a lead the last one counts.
    Leads are dealt to ``parts`` tasks, or as many as the session shuffles to. A lost
    executor's leads are fetched anew, and so are all when the result is read twice;
    ``resume`` keeps what has been fetched.
    """
    rows = _keyed(leads, key_col)
    rows = (rows.repartition(parts, "lead_id") if parts else rows).sortWithinPartitions("lead_id")
    return rows.mapInPandas(_fetching(adapter, run_id, batch, retries, wait), RESPONSES)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def response_log(spark: SparkSession, root: str) -> DataFrame:
    """All responses that runs have written under ``root``, errors that were asked again
    for included; filters on source and run_id prune files."""
    return _table(spark, f"{root}/responses", RESPONSES).select(*_COLUMNS)


def append_responses(responses: DataFrame, root: str) -> None:
    """Adds responses to the log, in the partitions of their source and run."""
    responses.write.mode("append").partitionBy("source", "run_id").parquet(f"{root}/responses")


def final_responses(log: DataFrame) -> DataFrame:
    """One response per source, run and lead: a final answer before an error, then the last."""
    rank = F.struct(F.col("status").isin(*FINAL).alias("final"), "fetched_at", "attempts", "batch_id")
    rest = [c for c in _COLUMNS if c not in ("source", "run_id", "lead_id")]
    return log.groupBy("source", "run_id", "lead_id").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("run_id", "lead_id", "source", "r.*").select(*_COLUMNS)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """V2: one row per run, as its last call left it."""
    rows = _table(spark, f"{root}/runs", RUNS)
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("run_id", "started_at"))), "finished_at").alias("r"), F.min("started_at").alias("started_at")).select("run_id", "started_at", "r.*")


def latest_responses(log: DataFrame, known: DataFrame) -> DataFrame:
    """The final responses of each source's last finished run. The runs are joined
    to the log's partition columns, so files of other runs are not read."""
    last = assemble.latest_runs(known.where("state = 'finished'").select("source", "run_id", "started_at"))
    return final_responses(log.join(F.broadcast(last), ["source", "run_id"]))  # a row per source


def resume(leads: DataFrame, adapter: Adapter, root: str, run_id: str, key_col: str = "phone", batch: int = 100, retries: int = 2, wait: float = 0.0, slices: int = 16, most: int | None = None, dataset_id: str | None = None) -> dict:
    """V2: fetches what a run still lacks and appends it to the log under ``root``; returns
    the run's row.

    Leads with a final answer in the log are not asked for again, whether an earlier call
    ended, failed or was killed. The others are dealt to ``slices`` by a hash of their id and
    each slice is a job: what has been fetched is in the log once its job ends, and a lost
    executor costs the calls of the slice under way. More slices lose less and take more
    jobs. ``most`` slices are fetched by this call, or all. The run is ``finished`` when each
    lead has a response; errors are asked for again by the next call.
    """
    spark = leads.sparkSession
    started = datetime.now(timezone.utc)
    own = lambda: response_log(spark, root).where((F.col("source") == adapter.source) & (F.col("run_id") == run_id))
    keyed = _keyed(leads, key_col)
    done = own().where(F.col("status").isin(*FINAL)).select("lead_id").distinct()
    pending = keyed.join(done, "lead_id", "left_anti").withColumn("slice", F.pmod(F.xxhash64("lead_id"), F.lit(slices)).cast("int"))
    path = scratch_path(spark, "pending")
    pending.repartition("slice", F.pmod(F.xxhash64("lead_id", F.lit(1)), F.lit(32))).write.partitionBy("slice").parquet(path)
    waiting = spark.read.schema("lead_id string, key string, slice int").parquet(path)
    todo = [r["slice"] for r in waiting.select("slice").distinct().orderBy("slice").collect()]  # as many as slices at most
    for k in todo[:most]:
        rows = waiting.where(F.col("slice") == k).select("lead_id", "key").sortWithinPartitions("lead_id")
        append_responses(rows.mapInPandas(_fetching(adapter, run_id, batch, retries, wait), RESPONSES), root)
    found = assemble.run_summary(final_responses(own())).first()
    counts = {c: found[c] if found else 0 for c in ("rows_attempted", "matched", "no_hit", "error", "not_sent")}
    state = "finished" if counts["rows_attempted"] == keyed.count() else "open"
    row = {"run_id": run_id, "source": adapter.source, "dataset_id": dataset_id, **counts, "started_at": started, "finished_at": datetime.now(timezone.utc), "state": state}
    audit.append(spark.createDataFrame([tuple(row.values())], RUNS), f"{root}/runs")
    return row


def run_enrichment(leads: DataFrame, adapters: list[Adapter], root: str, dataset_id: str | None = None, progress: Callable[[str, dict], None] | None = None, **how) -> list[dict]:
    """V2: a new run of each source in turn; returns their rows. Earlier runs stay as they are."""
    out = []
    for adapter in adapters:
        row = resume(leads, adapter, root, uuid.uuid4().hex, dataset_id=dataset_id, **how)
        out.append(row)
        if progress:
            progress(adapter.source, row)
    return out


def assembled(spine: DataFrame, root: str, sources: Registry) -> DataFrame:
    """The spine with the features, status and times of each source's last finished run."""
    spark = spine.sparkSession
    latest = latest_responses(response_log(spark, root), runs(spark, root))
    frames = {}
    for name in sources.names():
        adapter = sources[name]
        mine = features_of(latest.where(F.col("source") == name), adapter)
        frames[name] = assemble.source_frame(mine, name, list(adapter.features))
    return assemble.assemble(spine, frames)


def timing_leaks(root: str, outcomes: DataFrame, condition: Column | None = None) -> DataFrame:
    """J3 over the log: (source, lead_id, fetched_at, outcome_at) of responses of the last
    finished runs that were fetched after the lead's outcome."""
    spark = outcomes.sparkSession
    latest = latest_responses(response_log(spark, root), runs(spark, root))
    rows = latest if condition is None else latest.where(condition)
    met = rows.select("source", "lead_id", "fetched_at").join(outcomes.select(F.col("lead_id").cast("string").alias("lead_id"), "outcome_at"), "lead_id")
    return met.where("fetched_at > outcome_at")
