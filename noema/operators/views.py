"""What a graph view shows: tiers, items, labels, positions and clean edges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.operators.selection import quantiles

#: Camera ratios from which domains, and up to which facts are shown; labels shown by tier.
DOMAINS_FROM, FACTS_TO = 1.2, 0.52
LABELS = {"domains": 12, "themes": 18, "knowledge": 24}
#: The quantile of edge scores below which edges are hidden.
CUTOFFS = {"themes": 0.15, "knowledge": 0.25}


def zoom_tier(ratio: Column) -> Column:
    """The tier of a camera ratio; what is no finite number counts as 1."""
    finite = ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) < float("inf"))
    safe = F.when(finite, F.greatest(F.lit(0.01), ratio)).otherwise(F.lit(1.0))
    return F.when(safe >= DOMAINS_FROM, "domains").when(safe <= FACTS_TO, "knowledge").otherwise("themes")


def kind_visible(kind: Column, tier: Column, has_clusters: Column) -> Column:
    """Without clusters facts are always shown; with them clusters are, and in the nearest tier all."""
    return F.when(~has_clusters, kind == "knowledge").otherwise((tier == "knowledge") | (kind == "cluster"))


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, "s").otherwise(""))


def search_items(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, node_key, kind, label, cluster_id, subtitle) of clusters(id, label, members) and facts(id, label, cluster_id,
    source_title)."""
    key = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("node_key")
    own = clusters.select(F.col("id").cast("string").alias("id"), key("cluster"), F.lit("cluster").alias("kind"), "label", F.col("id").cast("string").alias("cluster_id"), counted(F.col("members"), "connaissance").alias("subtitle"))
    more = facts.select(F.col("id").cast("string").alias("id"), key("knowledge"), F.lit("knowledge").alias("kind"), "label", F.col("cluster_id").cast("string").alias("cluster_id"), F.col("source_title").alias("subtitle"))
    return own.unionByName(more)


def availability(has_profile: Column, state: Column) -> tuple[Column, Column]:
    """Whether a graph can be shown, and the tone of the message about it."""
    held = F.when(state == "stale", "warning").when(state == "building", "info").when(state == "error", "warning").otherwise("ready")
    none = F.when(state == "vector_index_required", "warning").when(state.isin("error", "unavailable"), "error").otherwise("info")
    return has_profile, F.when(has_profile, held).otherwise(none)


def visible_labels(nodes: DataFrame, tier: str, forced: list[str]) -> DataFrame:
    """(id) of nodes(id, kind, label, size) whose label is shown: the largest of the tier's kind (a view without clusters
    counts as the nearest tier), and forced ones that exist."""
    leaf = nodes.where("kind = 'cluster'").isEmpty()
    tier = "knowledge" if leaf else tier
    top = nodes.where(F.col("kind") == ("knowledge" if tier == "knowledge" else "cluster")).orderBy(F.col("size").desc(), F.lower("label"), "label", "id").limit(LABELS[tier])
    return top.select("id").union(nodes.where(F.col("id").isin(forced)).select("id")).distinct()


def canonical_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, score, relations) of edges between known nodes: no loops, one edge a pair in either direction,
    with the highest score (within -1 to 1, 0 if it is no number) and the highest count (whole, 1 or more)."""
    score = F.when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))
    known = nodes.select("id").distinct()
    both = edges.where("source <> target").join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return both.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max(score).alias("score"), F.max(F.greatest(F.lit(1), F.coalesce("relations", F.lit(1)).cast("long"))).alias("relations"))


def positions(points: DataFrame) -> DataFrame:
    """(grp, x, y): each group's mean place, of points(grp, x, y)."""
    return points.groupBy("grp").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def cluster_view(clusters: DataFrame, members: DataFrame, cluster: str, limit: int) -> DataFrame:
    """(kind, id, label, place, truncated): a cluster's children, largest first; a leaf's members by title.

    clusters has id, parent, label and size, members has id, cluster and title. An unknown cluster is an error.
    """
    if clusters.where(F.col("id") == cluster).isEmpty():
        raise ValueError(f"no cluster {cluster}")
    children = clusters.where(F.col("parent") == cluster)
    if children.isEmpty():
        rows = members.where(F.col("cluster") == cluster).select(F.lit("knowledge").alias("kind"), "id", F.col("title").alias("label"), F.lit(0).cast("long").alias("size"))
    else:
        rows = children.select(F.lit("cluster").alias("kind"), "id", "label", F.col("size").cast("long").alias("size"))
    order = [F.col("size").desc(), F.lower("label"), F.col("id")]
    total = rows.agg((F.count("*") > limit).alias("truncated"))
    top = rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # the limit's rows
    return top.crossJoin(F.broadcast(total)).select("kind", "id", "label", "place", "truncated")


def graph_faults(nodes: DataFrame) -> DataFrame:
    """(fault, rows) of nodes(id, label, x, y) that break a view's contract."""
    twice = nodes.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    own = nodes.agg(F.count_if(F.length(F.trim(F.coalesce("label", F.lit("")))) == 0).alias("blank label"), F.count_if(bad("x") | bad("y")).alias("no place"))
    return own.crossJoin(twice).select(F.expr("stack(3, 'blank label', `blank label`, 'no place', `no place`, 'repeated id', n) as (fault, rows)"))


class Presentation(NamedTuple):
    """nodes(id, kind, hidden, highlighted, dimmed) and edges(source, target, score, hidden, highlighted, dimmed)."""

    nodes: DataFrame
    edges: DataFrame


def presentation(nodes: DataFrame, edges: DataFrame, focus, marked, tier: str) -> Presentation:
    """How nodes(id, kind) and edges(source, target, score) are shown around a focus, with a marked node; either may be None.

    The focus and the marked node are highlighted and never hidden; other nodes are hidden by kind and tier. With a
    focus that exists all but it and its neighbours are dimmed, whether they are hidden or not, and of the edges only
    its own are shown, highlighted. Without one the weakest edges are hidden: those below a low quantile of all scores,
    higher in the nearest tier, none in the farthest.
    """
    c = F.col
    if focus is not None and nodes.where(c("id") == focus).isEmpty():
        focus = None
    clusters = not nodes.where("kind = 'cluster'").isEmpty()
    lit = c("id").isin([x for x in (focus, marked) if x is not None])
    hidden = ~lit & ~kind_visible(c("kind"), F.lit(tier), F.lit(clusters))
    direct = F.lit(False) if focus is None else (c("source") == focus) | (c("target") == focus)
    near = edges.where(direct).select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("near", F.lit(True))
    far = F.lit(False) if focus is None else ~F.coalesce(c("near"), F.lit(False)) & (c("id") != focus)
    shown = nodes.join(near, "id", "left").select("id", "kind", hidden.alias("hidden"), lit.alias("highlighted"), far.alias("dimmed"))
    cutoff = None
    if focus is None and tier in CUTOFFS:
        _, (cutoff,) = quantiles(edges.where(F.abs("score") < float("inf")), "score", (CUTOFFS[tier],), between=False)
    weak = ~direct if focus is not None else F.lit(False) if cutoff is None else c("score") < cutoff
    lines = edges.select("source", "target", "score", weak.alias("hidden"), direct.alias("highlighted"), (~direct if focus is not None else F.lit(False)).alias("dimmed"))
    return Presentation(shown, lines)
