"""The folder that driver and executors share, and entries that commit what runs have written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or set on the context.

    Without one only a local master, where driver and executor are one process, gets a temporary
    folder; on a cluster a folder of one machine would hide each executor's files from the others.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def append_entry(rows: DataFrame, root: str) -> None:
    """Add entries under ``root``, as one file, so that all of them are there or none is."""
    rows.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/entries")


def entries(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All entries under ``root`` with the time at which they were ``written``; none if there is no folder yet."""
    try:
        found = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/entries")
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], f"{schema}, written TIMESTAMP")
    return found.withColumn("written", F.col("_metadata.file_modification_time"))


def first_entries(found: DataFrame, key: str, run: str = "run") -> DataFrame:
    """Of several runs that entered one ``key`` the rows of the first one: by time, then by name.

    What a reader has once seen stays, as a later entry does not come before an earlier one.
    """
    first = found.groupBy(key).agg(F.min(F.struct("written", run)).alias("first"))
    chosen = first.select(key, F.col(f"first.{run}").alias(run))
    return found.join(chosen, [key, run], "left_semi")


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table of their own in the shared folder, so that Spark knows their size."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
