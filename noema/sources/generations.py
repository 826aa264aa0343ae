"""Versioned output: a new generation is written beside the old ones, then published by a pointer that only one writer gets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.operators.lineage import place


class Conflict(RuntimeError):
    """Another writer has published the generation that would have been next."""


def next_generation(pointers: DataFrame) -> int:
    return (pointers.agg(F.coalesce(F.max("generation"), F.lit(0)).alias("g")).first()["g"] or 0) + 1


def _published(spark: SparkSession, root: str) -> dict[int, str]:
    """Generations by number, with the folder each lies in. A pointer without content is that of a writer that died."""
    system, folder = place(spark, f"{root}/published")
    found: dict[int, str] = {}
    if system.exists(folder):
        for file in system.listStatus(folder):
            if file.getLen():
                stream = system.open(file.getPath())
                found[int(file.getPath().getName())] = bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
                stream.close()
    return found


def newest(spark: SparkSession, root: str) -> int:
    """The number of the newest generation, 0 before the first."""
    return max(_published(spark, root), default=0)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, base: int | None = None) -> int:
    """Write all tables of a new generation, then its pointer; readers never see half of one.

    The pointer is a file that must not exist yet, which the file system lets one writer create. base is the generation
    that the tables were made from (the newest, if not given): if another one has been published since, this is a Conflict
    and nothing of it can be read.
    """
    known = _published(spark, root)
    number = (max(known, default=0) if base is None else base) + 1
    if number in known:
        raise Conflict(f"generation {number} is published already")
    own = uuid.uuid4().hex
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/{name}/{own}")
    system, pointer = place(spark, f"{root}/published/{number}")
    if system.exists(pointer) and not system.getFileStatus(pointer).getLen():
        raise Conflict(f"generation {number} is being published, or its writer died: remove {root}/published/{number} then")
    try:
        stream = system.create(pointer, False)
    except Exception as error:
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            raise Conflict(f"generation {number} has been published meanwhile") from error
        raise
    stream.write(bytearray(own.encode()))
    stream.close()
    return number


def read(spark: SparkSession, name: str, root: str, generation: int | None = None) -> DataFrame:
    """A table of a generation, of the newest one if none is given."""
    known = _published(spark, root)
    return spark.read.parquet(f"{root}/{name}/{known[max(known) if generation is None else generation]}")
