"""Cutting lineage by checkpoints, and folders for tables, in the session's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session may lack it (tests), and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="noema-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(frame: DataFrame) -> DataFrame:
    """frame, written to the shared folder."""
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            system, target = place(spark, path)
            system.delete(target, True)

    atexit.register(remove)
    return path


def written(frame: DataFrame) -> DataFrame:
    """frame, written to the shared folder as compressed Parquet: for tables of texts or marks, which checkpoints would hold as they are."""
    path = scratch(frame.sparkSession, "table")
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
