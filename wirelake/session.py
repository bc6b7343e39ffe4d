"""Session plumbing shared by every query: worker imports and scratch tables."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started, and bound the Arrow
    batches they hold, unless the session has set a size of its own."""
    if spark.conf.get(_BATCH, None) == "67108864b":  # Spark's default
        spark.conf.set(_BATCH, "4m")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and all of Spark runs in
    one process (tests, a laptop) is a local folder chosen and recorded in the session. Elsewhere
    each machine would write to a disk of its own, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wirelake-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; it goes when the driver's interpreter ends."""
    path = f"{scratch_dir(spark)}/wirelake/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and later readers
    survive the loss of any executor. The table goes when the driver's interpreter ends."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote, once nothing lazily reads it any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at interpreter exit
        pass
