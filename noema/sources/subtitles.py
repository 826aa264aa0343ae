"""Timed subtitle files: parsing, refusal of whole files, and rendering, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.functions import text as X
from noema.sources.charsets import eight_bit, eight_bit_of

_TIMES = r"^\s*(\S+)\s+-->\s+(\S+)\s*$"


def read_files(spark, path: str, most_bytes: int) -> DataFrame:
    """(path, length, data, verdict): files as bytes; too long ones without their data. Spark's reader
    passes empty files by, so they have no row."""
    files = spark.read.format("binaryFile").load(path)
    verdict = F.when(F.col("length") > most_bytes, "too large").otherwise("ok")
    return files.select("path", "length", verdict.alias("verdict"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("data"))


def _plain(data: Column) -> tuple[Column, Column]:
    """Text of bytes with a byte order mark (the longest first) or in strict UTF-8, and the bytes if they are neither."""
    start = F.hex(F.substring(data, 1, 4))
    part = lambda skip, charset: F.decode(F.substring(data, skip + 1, 1 << 30), charset)
    marked = start.isin("FFFE0000", "0000FEFF") | F.startswith(start, F.lit("EFBBBF")) | F.startswith(start, F.lit("FFFE")) | F.startswith(start, F.lit("FEFF"))
    text = (
        F.when(start == "FFFE0000", part(4, "UTF-32")).when(start == "0000FEFF", part(4, "UTF-32"))
        .when(F.startswith(start, F.lit("EFBBBF")), part(3, "UTF-8"))
        .when(F.startswith(start, F.lit("FFFE")), F.decode(data, "UTF-16")).when(F.startswith(start, F.lit("FEFF")), F.decode(data, "UTF-16"))
        .otherwise(F.try_validate_utf8(data.cast("string")))
    )
    return text, F.when(~marked & ~F.is_valid_utf8(data.cast("string")), data)


def _readable(text: Column) -> Column:
    return F.when(text.rlike(r"[^\s\p{Z}]") & ~F.contains(text, F.lit("\ufffd")), text)


def decode(data: Column) -> Column:
    """Text of bytes: by byte order mark, else strict UTF-8, else the likeliest 8-bit set; null if that leaves no text or
    characters that can't be read."""
    text, rest = _plain(data)
    return _readable(F.coalesce(text, eight_bit(rest)))


def decoded(files: DataFrame) -> DataFrame:
    """decode for all files of an import, with a column data, which becomes text: those in 8-bit sets are judged by how the sure ones are spelled."""
    text, rest = _plain(F.col("data"))
    likeliest = eight_bit_of(files.select(rest.alias("data")))
    return files.withColumn("text", _readable(F.coalesce(text, likeliest(rest)))).drop("data")


def parse(files: DataFrame) -> DataFrame:
    """(file, cue, start_ms, end_ms, text, verdict) of files(file, text): one row a block. One bad block refuses the
    whole file: its rows carry the first reason in 'verdict', rows of good files carry 'ok'."""
    plain = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), r"\r\n?", "\n")
    blocks = F.filter(F.split(F.regexp_replace(plain, r"^\s+|\s+$", ""), r"\n[ \t]*\n\s*"), lambda b: F.length(X.strip(b)) > 0)
    rows = files.select("file", F.posexplode_outer(blocks).alias("place", "block")).withColumn("lines", F.split("block", "\n"))
    number = X.strip(F.get("lines", F.lit(0)))
    timing = F.get("lines", F.lit(1))
    rows = rows.select(
        "file", "place",
        F.when(number.rlike(r"^[0-9]{1,19}$"), F.expr("try_cast(trim(lines[0]) as bigint)")).alias("cue"),
        X.parsed_clock(F.regexp_extract(timing, _TIMES, 1)).alias("start_ms"), X.parsed_clock(F.regexp_extract(timing, _TIMES, 2)).alias("end_ms"),
        X.strip(F.array_join(F.slice("lines", 3, 1 << 20), "\n")).alias("text"),
    )
    before = F.lag("cue").over(Window.partitionBy("file").orderBy("place"))
    reason = (
        F.when(F.col("place").isNull(), "empty").when(F.col("cue").isNull() | (F.col("cue") < 1), "number").when(before >= F.col("cue"), "order")
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "timing").when(F.col("end_ms") < F.col("start_ms"), "times")
        .when(F.length("text") == 0, "no text")
    )
    judged = rows.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason"))).over(Window.partitionBy("file"))
    return judged.withColumn("verdict", F.coalesce(first["reason"], F.lit("ok"))).drop("reason")


def render(cues: DataFrame) -> DataFrame:
    """(file, text) of cues(file, cue, start_ms, end_ms, text); the cues of a file are one text."""
    block = F.concat_ws("\n", F.col("cue").cast("string"), F.concat(X.clock(F.col("start_ms")), F.lit(" --> "), X.clock(F.col("end_ms"))), "text")
    listed = cues.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("cue", block.alias("block")))).alias("b"))
    return listed.select("file", F.concat(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("text"))
