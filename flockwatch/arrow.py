"""Arrow batches: how large they are, and that executors can import what works on them."""

from __future__ import annotations

import atexit
import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .scratch import filesystem, shared_dir

#: Rows and bytes of an Arrow batch that a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, by way of the shared folder, wherever the driver was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root).as_posix()}")
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}/{root.name}.zip"  # stays as long as the driver: executors may fetch it at any time
    at, fs = filesystem(spark, path)
    out = fs.create(at)
    out.write(held.getvalue())
    out.close()
    atexit.register(_drop, spark, path)
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at, fs = filesystem(spark, path)
        fs.delete(at, True)
    except Exception:  # the session may be gone by now
        return


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that long texts travel in, and see that executors can import us.

    Plans read these settings when they run, which may be after the operator has returned, so
    they stay; they are only ever lowered.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
