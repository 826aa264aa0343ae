"""Closures and paths of a tree given by parent links, level by level until nothing new is met."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.operators.lineage import checkpointed


def _levels(tree: DataFrame, start: DataFrame, step) -> Iterator[DataFrame]:
    """The start and then each next level; a node that was met before isn't met again, so cycles end."""
    level = checkpointed(start)
    met = level.select("id")
    while not level.isEmpty():
        yield level
        below = step(tree.select("id", "parent").join(level.withColumnRenamed("id", "parent"), "parent"))
        level = checkpointed(below.join(met, "id", "left_anti"))
        met = met.union(level.select("id"))


def _union(levels: Iterator[DataFrame], empty: DataFrame) -> DataFrame:
    out = None
    for level in levels:
        out = level if out is None else out.unionByName(level)
    return empty.limit(0) if out is None else out


def paths(tree: DataFrame) -> DataFrame:
    """(id, root, path, depth) of tree(id, parent); rows on a cycle have no root and no path."""
    start = tree.where("parent is null").select("id", F.col("id").alias("root"), F.col("id").cast("string").alias("path"), F.lit(0).alias("depth"))
    step = lambda b: b.select("id", "root", F.concat_ws("/", "path", F.col("id").cast("string")).alias("path"), (F.col("depth") + 1).alias("depth"))
    return _union(_levels(tree, start, step), start)


def descendants(tree: DataFrame, start: str) -> DataFrame:
    """(id, depth) of a node and all below it, at any depth."""
    first = tree.where(F.col("id") == start).select("id", F.lit(0).alias("depth")).distinct()
    return _union(_levels(tree, first, lambda b: b.select("id", (F.col("depth") + 1).alias("depth"))), first)


def breadcrumb(tree: DataFrame, current: str | None, root: str) -> DataFrame:
    """(place, id, label, level): the way from the root (its given label, no id) to a node of tree(id, parent, label, level). What
    lies at level 0 is the root itself; a cycle ends the way where it is met again, an unknown node leaves the root."""
    top = tree.sparkSession.createDataFrame([(0, None, root, 0)], f"place int, id {tree.schema['id'].dataType.simpleString()}, label string, level int")
    if current is None:
        return top
    up = tree.select(F.col("parent").alias("_up"), F.col("id").alias("_own"))
    step = lambda b: b.select(F.col("_up").alias("id"), (F.col("depth") + 1).alias("depth"))
    level = checkpointed(tree.where(F.col("id") == current).select("id", F.lit(0).alias("depth")).distinct())
    met = level
    while not level.isEmpty():
        above = step(level.join(up, F.col("id") == F.col("_own"))).where("id is not null").distinct()
        level = checkpointed(above.join(tree.select("id"), "id", "left_semi").join(met.select("id"), "id", "left_anti"))
        met = checkpointed(met.unionByName(level))
    way = met.join(tree.select("id", "label", "level"), "id").where("level > 0")
    place = F.row_number().over(Window.orderBy(F.col("depth").desc()))  # a way, not a tree
    return top.unionByName(way.select(place.alias("place"), "id", "label", F.col("level").cast("int").alias("level")))


def ancestor_at(paths: DataFrame, level: int) -> DataFrame:
    """(id, ancestor): the ancestor (or the node itself) at a level, for nodes at least so deep; of paths()."""
    return paths.where(F.col("depth") >= level).select("id", F.get(F.split("path", "/"), F.lit(level)).alias("ancestor"))
