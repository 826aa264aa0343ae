"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session settings of this subpackage: small Arrow batches bound a Python worker's memory whatever
#: the length of the texts, and the shuffle files of a finished write are removed at once.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}




def prepare(spark: SparkSession) -> None:
    """Set the settings of this subpackage in a session; they apply to what it runs from then on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def fresh(columns: list[str], name: str) -> str:
    """A column name that the given ones don't hold (in any case)."""
    held = {c.lower() for c in columns}
    while f"_{name}" in held:
        name = f"_{name}"
    return f"_{name}"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session may lack it (tests): it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="noema-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def delete(spark: SparkSession, path: str) -> None:
    system, target = _place(spark, path)
    system.delete(target, True)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern."""
    system, target = _place(spark, pattern)
    return [x.getPath().toString() for x in system.globStatus(target) or []]


class Staging:
    """Writes frames as Parquet under one folder of its own and reads them back: cuts lineage and
    outlives lost executors, unlike shuffle or cached blocks. What is left is deleted when the driver's Python ends,
    or by close(), since a lazy result may read it until then."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        prepare(spark)
        self._count = 0
        atexit.register(self.close)

    def save(self, frame: DataFrame, name: str = "t", partition_by: str | None = None, codec: str | None = None) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{name}"
        writer = frame.write.mode("overwrite")
        writer = writer.option("compression", codec) if codec else writer
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        back._staged_path = path
        return back

    def drop(self, frame: DataFrame) -> None:
        """Delete a staged table that nothing reads any more."""
        path = getattr(frame, "_staged_path", None)
        if path:
            delete(self.spark, path)

    def close(self) -> None:
        """Delete all staged tables."""
        atexit.unregister(self.close)
        if self.spark.sparkContext._jsc is not None:
            delete(self.spark, self.root)
