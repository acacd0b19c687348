"""Append-only tables: datasets, their lineage, and what is asked of them."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelforge.operators import profile
from funnelforge.session import stored


def save_dataset(df: DataFrame, path: str) -> None:
    """Writes Parquet; a path that exists raises."""
    df.write.mode("errorifexists").parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """S6."""
    return spark.read.parquet(path)


def save_report(df: DataFrame, path: str) -> None:
    """Writes JSON lines; a path that exists raises."""
    df.write.mode("errorifexists").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Writes CSV with a header; a path that exists raises."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    """Appends the rows of a job to an audit table."""
    df.write.mode("append").parquet(path)


def record(spark: SparkSession, table: str, **values: str | int | float | None) -> str:
    """Appends one audit row with an id and the time; returns the id."""
    row = {"id": uuid.uuid4().hex, "created_at": datetime.now(timezone.utc).isoformat(), **values}
    kinds = {str: "string", int: "bigint", float: "double", type(None): "string"}
    append(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())), table)
    return row["id"]


UPLOADS = "upload_id string, path string, bytes long, encoding string, hash string, created_at timestamp"


def uploads(spark: SparkSession, root: str) -> DataFrame:
    """Every file of every upload; without rows before the first."""
    try:
        return spark.read.schema(UPLOADS).parquet(f"{root}/uploads")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], UPLOADS)


def register_upload(files: DataFrame, root: str, upload_id: str) -> DataFrame:
    """Adds the files (path, bytes, encoding, hash) of an upload to the catalogue, and
    gives (path, hash, n_earlier, first_upload, first_path) of those whose bytes an earlier
    upload has already brought. An upload that is in the catalogue is not added again, and
    is no earlier one of itself."""
    spark = files.sparkSession
    new = stored(files.select(F.lit(upload_id).alias("upload_id"), "path", "bytes", "encoding", "hash", F.current_timestamp().alias("created_at")), "upload")
    known = stored(uploads(spark, root), "uploads")
    before = known.where(F.col("upload_id") != upload_id)
    if known.where(F.col("upload_id") == upload_id).isEmpty():
        append(new, f"{root}/uploads")
    # Only contents that come again are looked up: the catalogue is cut to them first.
    met = before.join(new.select("hash").distinct(), "hash", "left_semi")
    first = met.groupBy("hash").agg(F.count(F.lit(1)).alias("n_earlier"), F.min(F.struct("created_at", "upload_id", "path")).alias("f"))
    return new.join(first, "hash").select("path", "hash", "n_earlier", F.col("f.upload_id").alias("first_upload"), F.col("f.path").alias("first_path"))


def register_dataset(df: DataFrame, root: str, name: str, source_id: str | None = None, content_hash: str | None = None) -> str:
    """Persists a dataset, its schema and its fingerprint, with the id of the
    dataset it came from and the hash of the file that it was read from; returns its id."""
    spark = df.sparkSession
    path = f"{root}/data/{name}-{uuid.uuid4().hex}"
    save_dataset(df, path)
    saved = load_dataset(spark, path)
    found = profile.fingerprint(saved).first()
    key = record(spark, f"{root}/datasets", name=name, path=path, source_id=source_id, n_rows=found["n_rows"], fingerprint=found["hash"], content_hash=content_hash)
    append(profile.infer_schema(profile.value_counts(saved)).withColumn("dataset_id", F.lit(key)), f"{root}/schemas")
    return key


def save_predictions(scored: DataFrame, root: str, bundle_id: str, batch: str) -> str:
    """Persists the scored rows of a batch and an audit row of the run; returns its id."""
    spark = scored.sparkSession
    path = f"{root}/predictions/{batch}-{uuid.uuid4().hex}"
    save_dataset(scored, path)
    n = load_dataset(spark, path).count()
    return record(spark, f"{root}/runs", bundle_id=bundle_id, batch=batch, path=path, n_rows=n)


def merchants(tables: list[DataFrame]) -> DataFrame:
    """The distinct merchants of several tables."""
    out = tables[0].select("merchant")
    for t in tables[1:]:
        out = out.union(t.select("merchant"))
    return out.where("merchant is not null").distinct()


def next_versions(profiles: DataFrame) -> DataFrame:
    """(merchant, next_version, profile): the version after the last, and the last profile."""
    return profiles.groupBy("merchant").agg((F.max("version") + 1).alias("next_version"), F.max(F.struct("version", "profile")).alias("m")).select("merchant", "next_version", "m.profile")


def history(datasets: DataFrame, splits: DataFrame, bundles: DataFrame, runs: DataFrame, merchant: str) -> DataFrame:
    """(kind, id, created_at) of one merchant's datasets and what was made of them."""
    own = datasets.where(F.col("merchant") == merchant)
    cut = splits.join(own.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
    made = bundles.join(cut.select(F.col("id").alias("split_id")), "split_id", "left_semi")
    ran = runs.join(made.select(F.col("id").alias("bundle_id")), "bundle_id", "left_semi")
    parts = [t.select(F.lit(k).alias("kind"), "id", "created_at") for k, t in (("dataset", own), ("split", cut), ("bundle", made), ("run", ran))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("created_at"), "kind", "id")


def lineage(runs: DataFrame, bundles: DataFrame, splits: DataFrame, datasets: DataFrame) -> DataFrame:
    """(run_id, bundle_id, split_id, dataset_id)."""
    b = bundles.select(F.col("id").alias("bundle_id"), "split_id")
    s = splits.select(F.col("id").alias("split_id"), "dataset_id")
    d = datasets.select(F.col("id").alias("dataset_id"))
    return runs.select(F.col("id").alias("run_id"), "bundle_id").join(b, "bundle_id").join(s, "split_id").join(d, "dataset_id").select("run_id", "bundle_id", "split_id", "dataset_id")
