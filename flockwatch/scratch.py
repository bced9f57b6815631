"""Tables that are written to cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def filesystem(spark: SparkSession, path: str):
    """The Hadoop path and the file system it is on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own if that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='flockwatch-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the shared folder, deleted with the other scratch tables."""
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}{suffix}"
    _made.append((spark, path))
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs here go when it ends, else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    The table outlives any executor, so what is built on it never recomputes what came
    before, and every reader sees the same rows. What was shuffled to write it goes at once.
    Scratch tables go with `release` or `sweep`, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at, fs = filesystem(spark, path)
        fs.delete(at, True)
    except Exception:  # the session may be gone by now
        return


def release(*tables: DataFrame) -> None:
    """Delete scratch tables, as `cut` gave them, that nothing reads any more."""
    gone = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for t in tables for f in t.inputFiles()}
    for k in [k for k, (_, path) in enumerate(_made) if path.split(":", 1)[-1].lstrip("/") in gone][::-1]:
        _delete(*_made.pop(k))


def made() -> int:
    """How many scratch tables there are: what a later `sweep` may keep."""
    return len(_made)


def sweep(keep: int = 0) -> None:
    """Delete scratch tables but the first `keep`; what is built on them must have been written by then."""
    while len(_made) > keep:
        _delete(*_made.pop())


atexit.register(sweep)
