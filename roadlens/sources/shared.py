"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local master gets a new temporary folder; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="roadlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    """A place for an intermediate table, which is deleted when the program ends."""
    if not _written:
        atexit.register(delete_all)
    path = f"{shared_folder(spark)}/roadlens-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: it is computed once, and lost executors don't cost its lineage."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._roadlens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of saved() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_roadlens_path", None):
            delete(path)


def delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may have ended
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def temporary():
    """Tables that are saved inside are deleted on the way out."""
    before = set(_written)
    yield
    for path in [p for p in _written if p not in before]:
        delete(path)


def delete_all() -> None:
    for path in list(_written):
        delete(path)
