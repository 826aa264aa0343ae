"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.staging import Staging

#: Different edges of two numbers each that one task joins; more are joined in rounds over all tasks.
LOCAL = 1 << 20


def _canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v").distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the smallest node around u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, moves to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the smallest node each is joined with: roots take the smaller root of a neighbour
    and all nodes their root's root, until no edge lies between two roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if found:
        nodes, roots = joined(*(np.concatenate(x) for x in zip(*found)))
        yield from pa.table({"node": nodes, "component": roots}).to_batches(max_chunksize=1 << 16)


def connected_components(edges: DataFrame, stage: Staging) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    edges has columns a and b of one orderable type; nulls, loops and repeats count for nothing. Each round's
    edges are a staged table; the result is a star around each smallest node when a round changes nothing. Up to LOCAL
    different edges of whole numbers are one small file, which a single task solves.
    """
    current, before = stage.save(_canonical(edges), "edges"), None
    if {t for _, t in current.dtypes} == {"bigint"} and current.count() <= LOCAL:
        return current.coalesce(1).mapInArrow(_at_once, "node long, component long")
    while True:
        larger = stage.save(_large_star(current), "large")
        stage.drop(current)
        current = stage.save(_small_star(larger), "small")
        stage.drop(larger)
        mark = current.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("x")).first()
        if mark == before or mark["n"] == 0:
            break
        before = mark
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
