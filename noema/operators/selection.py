"""Exact order statistics without one task that sorts or holds all values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.operators.lineage import checkpointed


def _at_ranks(rows: DataFrame, column: str, ranks) -> tuple[int, dict[int, float]]:
    """The number of values, and those at ranks(n), from 0. Different values are counted, dealt out in ranges, and each range's
    count goes to the driver; only ranges that hold a wanted rank are looked into."""
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n")).where(~F.isnan("x"))
    placed = checkpointed(values.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    sums = sorted(map(tuple, placed.groupBy("part").agg(F.sum("n")).collect()))
    total = sum(n for _, n in sums)
    wanted, before, sought = sorted(set(ranks(total))) if total else [], 0, []
    for part, n in sums:
        sought += [(part, r - before, r) for r in wanted if before <= r < before + n]
        before += n
    if not sought:
        return total, {}
    spark = rows.sparkSession
    near = placed.join(F.broadcast(spark.createDataFrame(sought, "part int, place long, rank long")), "part")
    upto = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("x"))
    found = near.withColumn("upto", upto).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
    return total, {r["rank"]: r["x"] for r in found.select("rank", "x").collect()}


def quantiles(rows: DataFrame, column: str, fractions: Sequence[float], between: bool = True) -> tuple[int, list[float | None]]:
    """The number of values that aren't null or NaN, and their quantiles: between two neighbours in proportion, or the
    lower of the two. Without values a quantile is None."""
    places = lambda n: [(n - 1) * f for f in fractions]
    total, found = _at_ranks(rows, column, lambda n: [r for p in places(n) for r in (math.floor(p), math.ceil(p))])
    if not total:
        return 0, [None] * len(fractions)
    out = []
    for p in places(total):
        low, high = found[math.floor(p)], found[math.ceil(p)]
        out.append(low + (high - low) * (p - math.floor(p)) if between and high != low else low)
    return total, out
