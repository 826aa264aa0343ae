"""Similarity graphs: mutual neighbours, blended scores, a degree bound, roll-ups and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.functions.numbers import blended, jaccard
from noema.operators.lineage import checkpointed
from noema.operators.selection import quantiles


def scored_edges(directed: DataFrame, tags: DataFrame, weight: float) -> DataFrame:
    """Edges (a < b) of directed neighbours (id, other, sim, rank) with cosine, tag bonus, final score and whether
    either is the other's neighbour. tags has id and tags (array)."""
    pairs = directed.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(
        F.max("sim").alias("cosine"), (F.count("*") == 2).alias("mutual")
    )
    named = pairs.join(tags.select(F.col("id").alias("a"), F.col("tags").alias("ta")), "a").join(tags.select(F.col("id").alias("b"), F.col("tags").alias("tb")), "b")
    overlap = jaccard(F.col("ta"), F.col("tb"))
    return named.select("a", "b", "cosine", (weight * overlap).alias("bonus"), blended(F.col("cosine"), overlap, weight).alias("score"), "mutual")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "place", "state")


def degree_bounded(edges: DataFrame, k: int) -> DataFrame:
    """The edges that a greedy pass in order (mutual first, then score, cosine, ids) keeps if no node may have more
    than k. Rounds decide at once every edge whose two ends leave no doubt: kept if fewer than k better edges that
    are not refused stand before it at both ends, refused if k kept ones stand before it at either end. The best open edge
    is always decided, so rounds go on until none is open."""
    order = F.struct((~F.col("mutual")).alias("m"), (-F.round("score", 9)).alias("s"), (-F.round("cosine", 9)).alias("c"), "a", "b")
    state = edges.withColumn("place", order).withColumn("state", F.lit(0))  # 0 open, 1 kept, 2 refused
    window = Window.partitionBy("node").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        ends = _ends(state).withColumn("kept", F.coalesce(F.sum((F.col("state") == 1).cast("int")).over(window), F.lit(0))).withColumn(
            "live", F.coalesce(F.sum((F.col("state") != 2).cast("int")).over(window), F.lit(0))
        )
        seen = ends.groupBy("a", "b").agg(F.max("kept").alias("kept"), F.max("live").alias("live"))
        state = checkpointed(state.join(seen, ["a", "b"]).withColumn(
            "state", F.when(F.col("state") != 0, F.col("state")).when(F.col("live") < k, 1).when(F.col("kept") >= k, 2).otherwise(0)
        ).drop("kept", "live"))
        if state.where("state = 0").isEmpty():
            break
    return state.where("state = 1").drop("state", "place")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def isolated(nearest_one: DataFrame, least: float, factor: float, eps: float = 1e-9) -> DataFrame:
    """Points whose nearest similarity lies below the bound and the lower fence of all nearest similarities."""
    rows = checkpointed(nearest_one.select("id", "sim"))
    n, (low, high) = quantiles(rows, "sim", (0.25, 0.75))
    return rows.where(F.col("sim") < min(least, low - factor * (high - low)) - eps) if n >= 3 else rows.where("false")


def edge_statistics(edges: DataFrame, score: str = "score") -> DataFrame:
    rows = checkpointed(edges.select(score))
    _, (median,) = quantiles(rows, score, (0.5,))
    return rows.agg(F.count("*").alias("edges"), F.min(score).alias("least"), F.avg(score).alias("mean"), F.lit(median).cast("double").alias("median"), F.max(score).alias("most"))


def roll_up(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between groups(id, grp): highest score and number of relations; edges within a group and of unknown
    ends are left out."""
    left = groups.select(F.col("id").alias("a"), F.col("grp").alias("ga"))
    right = groups.select(F.col("id").alias("b"), F.col("grp").alias("gb"))
    return (
        edges.join(left, "a").join(right, "b").where("ga <> gb")
        .groupBy(F.least("ga", "gb").alias("source"), F.greatest("ga", "gb").alias("target"))
        .agg(F.max("score").alias("score"), F.count("*").alias("relations"))
    )


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.round("score", 9).desc(), "source", "target").limit(n)


def neighbourhood(edges: DataFrame, node: Column) -> DataFrame:
    """Nodes directly linked with a node, and itself."""
    near = edges.where((F.col("a") == node) | (F.col("b") == node))
    return near.select(F.explode(F.array("a", "b")).alias("node")).union(near.sparkSession.range(1).select(node.alias("node"))).distinct()


def level_view(clusters: DataFrame, loose: DataFrame, limit: int) -> DataFrame:
    """Clusters by size, label and id, then loose facts in the places that are left; truncated if any is cut."""
    rows = clusters.select(F.lit(0).alias("kind_order"), F.lit("cluster").alias("kind"), F.col("id").cast("string").alias("id"), "label", "size").unionByName(
        loose.select(F.lit(1).alias("kind_order"), F.lit("fact").alias("kind"), F.col("id").cast("string").alias("id"), "label", F.lit(1).cast("long").alias("size"))
    )
    order = ["kind_order", F.col("size").desc(), F.lower("label"), "id"]
    total = rows.agg((F.count("*") > limit).alias("truncated"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).drop("kind_order")
