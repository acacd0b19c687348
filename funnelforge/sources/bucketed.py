"""Tables dealt to buckets by a key when they are written, so that joins on the key need no
shuffle afterwards.

A folder holds the rows, one file a bucket, and a note of key and number. Reading makes the
folder known to the session as a table, which is how Spark learns of buckets.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: A multiple of the cores that will read: one bucket is one task.
BUCKETS = 64


def save_bucketed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Writes ``df`` in ``buckets`` files by a hash of ``key``, sorted by it; a path that
    exists raises. Rows of one key share a bucket, null keys too."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    # Dealt as buckets are, so that each task writes one file.
    rows = df.repartition(buckets, key)
    note = json.dumps({"key": key, "buckets": buckets, "schema": json.loads(df.schema.json())})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/layout")
    try:
        rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{path}/rows").saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay


def load_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``save_bucketed``; the session knows the table by a name of its path."""
    note = json.loads(spark.read.text(f"{path}/layout").first()["value"])
    schema = T.StructType.fromJson(note["schema"])
    name = f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"
    quoted = path.replace("'", r"\'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{note['key']}`) SORTED BY (`{note['key']}`) INTO {note['buckets']} BUCKETS LOCATION '{quoted}/rows'")
    return spark.table(name)
