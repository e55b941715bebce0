"""Sends this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers and back by 4 MB, not by Spark's 64, where the session names no size of its own.

    An executor holds a batch several times for each of its cores: in the JVM's buffers for both ways and in the worker.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


def send_package(spark: SparkSession) -> None:
    """Adds the package as a zip archive, once for each Spark context, so that functions of its modules can be loaded there."""
    context = spark.sparkContext
    if getattr(context, "_factloom_sent", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted([*home.rglob("*.py"), *home.rglob("*.sql")]):
            z.write(f, f"factloom/{f.relative_to(home)}")
    context.addPyFile(str(archive))
    context._factloom_sent = True
