"""Session settings and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit every job of this package; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    conf = SETTINGS | {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
    }
    return reachable(SparkSession.builder.config(map=conf | extra).getOrCreate())


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local master import this package from any directory.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    if spark.sparkContext.master.startswith("local"):
        root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
        known = env.get("PYTHONPATH", "").split(os.pathsep)
        if root not in known + os.environ.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a local master gets a
    temporary folder, and a cluster a folder in its warehouse, if executors can reach that.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            if _filesystem(spark, found)[0].getScheme() == "file":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The paths that the innermost scope of this thread has made.
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its content is deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _filesystem(spark, path)
    fs.deleteOnExit(where)
    own = _scope.get()
    if own is not None:
        own.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch paths made inside: for jobs whose results are
    written elsewhere by then. Paths that other threads make meanwhile are theirs."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in own:
            fs, where = _filesystem(spark, path)
            fs.delete(where, True)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The plan's lineage ends there, so a lost executor costs a re-read and no
    recomputation, and several consumers share one computation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


#: Where ``stored`` has put the tables that are still in use.
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``; nothing may read it any more."""
    path = _stored.pop(df, None)
    if path:
        fs, where = _filesystem(df.sparkSession, path)
        fs.delete(where, True)
