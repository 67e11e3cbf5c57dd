"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import contextlib
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names.

    Only where it's unset and everything runs on this machine (tests) a temporary folder is made and set; on a
    cluster its executors wouldn't see that, so there the setting is required.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        with contextlib.suppress(Exception):
            named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="corpusloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written(rows: DataFrame) -> DataFrame:
    """The same rows from the shared folder: computed once for several uses, and safe from the loss of executors."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
