"""Queries of vector search, similarity graphs, clusters, trees and views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.functions import numbers as N
from noema.operators import cluster, graph, similarity, tree
from noema.operators.lineage import checkpointed
from noema.operators.selection import quantiles
from noema.plans.registry import Tables, query

K, LEAST, WEIGHT = 8, 0.25, 0.05

_COS = "list_cosine_similarity({a}.embedding::double[], {b}.embedding::double[])"
_DIRECTED = f"""s as (select a.vec_id as id, b.vec_id as other, {_COS.format(a='a', b='b')} as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by id order by round(sim, 9) desc, other) as rank from s qualify rank <= {K}), d as (select * from k where sim >= {LEAST})"""
_EDGES = _DIRECTED + f""", p as (select least(id, other) as a, greatest(id, other) as b, max(sim) as cosine, count(*) = 2 as mutual from d group by 1, 2),
e as (select p.*, {WEIGHT} * j::double as bonus, greatest(-1.0, least(1.0, (1 - {WEIGHT})::double * cosine + {WEIGHT}::double * j)) as score from (select p.*, case when x.label = y.label then 1.0::double
when x.label % 3 = y.label % 3 then 1.0::double / 3 else 0.0::double end as j from p join embeddings x on x.vec_id = p.a join embeddings y on y.vec_id = p.b) p)"""


def _points(t: Tables):
    return similarity.unit_vectors(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"))


def _directed(t: Tables):
    return similarity.nearest(_points(t), K, unit=True).where(F.col("sim") >= LEAST)


def _tags(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.array(F.col("label").cast("string"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))).alias("tags"))


def _edges(t: Tables):
    return graph.scored_edges(_directed(t), _tags(t), WEIGHT)


def _asked(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 7").first()["embedding"]]


@query(f"select b.vec_id as id, round({_COS.format(a='a', b='b')}, 6) as score from embeddings a, embeddings b where a.vec_id = 7 order by round({_COS.format(a='a', b='b')}, 9) desc, b.vec_id limit 10")
def vector_topk(t: Tables):
    return similarity.top_k(_points(t), _asked(t), 10).select("id", F.round("score", 6).alias("score"))


@query(f"""select b.vec_id as id, round({_COS.format(a='a', b='b')}, 6) as score, l.quality from embeddings a, embeddings b join labels l on l.doc_id = b.vec_id
where a.vec_id = 7 and l.toxic = 0 order by round({_COS.format(a='a', b='b')}, 9) desc, b.vec_id limit 10""")
def vector_topk_enriched(t: Tables):
    """Hits whose checkpoint is good: the filter comes before the limit."""
    good = t.labels.where("toxic = 0").select(F.col("doc_id").alias("id"), "quality")
    hits = similarity.top_k(_points(t).join(good, "id", "left_semi"), _asked(t), 10)
    return hits.join(good, "id").select("id", F.round("score", 6).alias("score"), "quality")


@query(f"""select b.vec_id as id, round({_COS.format(a='a', b='b')}, 6) as score from embeddings a, embeddings b where a.vec_id = 7 and b.label = 3 order by round({_COS.format(a='a', b='b')}, 9) desc, b.vec_id limit 5""")
def vector_topk_filtered(t: Tables):
    points = similarity.unit_vectors(t.embeddings.where("label = 3").select(F.col("vec_id").alias("id"), "embedding"))
    return similarity.top_k(points, _asked(t), 5).select("id", F.round("score", 6).alias("score"))


@query(f"with {_DIRECTED} select id, other, round(sim, 6) as sim, rank::int as rank from d")
def knn_directed(t: Tables):
    return _directed(t).select("id", "other", F.round("sim", 6).alias("sim"), "rank")


@query(f"with {_EDGES} select a, b, round(cosine, 6) as cosine from e where mutual")
def knn_mutual(t: Tables):
    return _edges(t).where("mutual").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"with {_EDGES} select a, b, round(bonus, 6) as bonus, round(score, 6) as score, mutual from e")
def edge_scores(t: Tables):
    return _edges(t).select("a", "b", F.round("bonus", 6).alias("bonus"), F.round("score", 6).alias("score"), "mutual")


@query(f"with {_EDGES} select count(*) as edges, round(min(score), 6) as least, round(avg(score), 6) as mean, round(quantile_cont(score, 0.5), 6) as median, round(max(score), 6) as most from e")
def edge_stats(t: Tables):
    s = graph.edge_statistics(_edges(t))
    return s.select("edges", *(F.round(c, 6).alias(c) for c in ("least", "mean", "median", "most")))


@query(f"with {_EDGES}, n as (select unnest([a, b]) as node from e) select node, count(*) as degree from n group by 1")
def node_degree(t: Tables):
    return graph.degrees(_edges(t))


@query(f"""with {_DIRECTED}, n as (select id, max(sim) as sim from s group by 1), f as (select quantile_cont(sim, 0.25) as q1, quantile_cont(sim, 0.75) as q3 from n)
select id, round(sim, 6) as sim from n, f where sim < least(0.45::double, q1 - 1.5::double * (q3 - q1)) - 1e-9::double""")
def isolated_nodes(t: Tables):
    return graph.isolated(similarity.nearest(_points(t), 1, unit=True), 0.45, 1.5).select("id", F.round("sim", 6).alias("sim"))


@query(f"with {_EDGES} select true as bounded, true as canonical, 0::bigint as lost_mutual")
def knn_capped_invariants(t: Tables):
    """The degree-bounded graph: no node over the bound, a < b, and no mutual edge is lost."""
    edges = checkpointed(_edges(t))
    kept = graph.degree_bounded(edges, K)
    lost = edges.where("mutual").join(kept.select("a", "b"), ["a", "b"], "left_anti").agg(F.count("*").alias("lost_mutual"))
    most = graph.degrees(kept).agg(F.coalesce(F.max("degree") <= K, F.lit(True)).alias("bounded"))
    shape = kept.agg(F.coalesce(F.every(F.col("a") < F.col("b")), F.lit(True)).alias("canonical"))
    return most.crossJoin(shape).crossJoin(lost)  # one row each


@query()
def knn_capped(t: Tables):
    kept = graph.degree_bounded(checkpointed(_edges(t)), K)
    return kept.select("a", "b", F.round("score", 6).alias("score"), "mutual")


_UNIT = "u as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as pos, unnest(list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[])))) as x from embeddings)"
_MEAN = _UNIT + ", m as (select label, pos, avg(x) as x from u group by 1, 2)"


def _labelled(t: Tables):
    return _points(t).join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("grp")), "id")


@query(f"with {_MEAN}, n as (select label, sqrt(sum(x * x)) as n from m group by 1) select label as grp, pos::int - 1 as pos, round(x / n, 6) as x from m join n using (label)")
def centroids(t: Tables):
    means = similarity.mean_vectors(_labelled(t), "grp")
    return means.select("grp", F.posexplode(N.unit(F.col("mean"))).alias("pos", "x")).select("grp", "pos", F.round("x", 6).alias("x"))


_TO_CENTRE = _MEAN + """, n as (select label, sqrt(sum(x * x)) as n from m group by 1), c as (select u.vec_id, u.label, sum(u.x * m.x) / any_value(n.n) as sim from u join m on m.label = u.label and m.pos = u.pos join n on n.label = u.label group by 1, 2)"""


def _to_centre(t: Tables):
    points = _labelled(t)
    means = similarity.mean_vectors(points, "grp").select("grp", N.unit(F.col("mean")).alias("c"))
    return points.join(means, "grp").select("id", "grp", N.dot(F.col("u"), F.col("c")).alias("sim"))


@query(f"with {_TO_CENTRE} select label as grp, vec_id as id, row_number() over (partition by label order by round(sim, 9) desc, vec_id)::int as rank from c qualify rank <= 5")
def representatives(t: Tables):
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.round("sim", 9).desc(), "id"))
    return _to_centre(t).withColumn("rank", rank).where("rank <= 5").select("grp", "id", "rank")


@query(f"with {_TO_CENTRE} select vec_id as id, round(greatest(0, least(1, (sim + 1) / 2)), 6) as confidence from c")
def confidence(t: Tables):
    return _to_centre(t).select("id", F.round(N.confidence(F.col("sim")), 6).alias("confidence"))


@query(f"""with {_MEAN}, g as (select label, count(distinct vec_id) as n from u group by 1), d as (select u.vec_id, u.label, m.label as other, 1 - sum(u.x * m.x) as far from u join m on m.pos = u.pos group by 1, 2, 3),
e as (select d.*, g.n, case when d.label = other then case when n > 1 then far * n / (n - 1) end end as own, case when d.label <> other then far end as apart from d join g on g.label = d.other),
f as (select vec_id, max(own) as a, min(apart) as b from e group by 1) select round(avg(case when a is null or greatest(a, b) <= 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from f""")
def silhouette(t: Tables):
    points = _labelled(t)
    return similarity.silhouette(points, similarity.mean_vectors(points, "grp"), "grp").select(F.round("silhouette", 6).alias("silhouette"))


@query("with c as (select label, count(*) as n from embeddings group by 1) select count(*) as clusters, min(n) as least, round(avg(n), 6) as mean, max(n) as most from c")
def cluster_sizes(t: Tables):
    sizes = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


_ROLL = _EDGES + """, r as (select least(x.label, y.label) as source, greatest(x.label, y.label) as target, max(score) as score, count(*) as relations from e join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b where x.label <> y.label group by 1, 2)"""


def _rolled(t: Tables):
    return graph.roll_up(_edges(t), t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("grp")))


@query(f"with {_ROLL} select source, target, round(score, 6) as score, relations from r")
def edge_rollup(t: Tables):
    return _rolled(t).select("source", "target", F.round("score", 6).alias("score"), "relations")


@query(f"with {_ROLL} select source, target, round(score, 6) as score, relations from r order by round(score, 9) desc, source, target limit 7")
def edge_rollup_topn(t: Tables):
    return graph.top_edges(_rolled(t), 7).select("source", "target", F.round("score", 6).alias("score"), "relations")


@query(f"with {_EDGES} select distinct unnest([a, b]) as node from e where a = 11 or b = 11 union select 11")
def neighbourhood(t: Tables):
    return graph.neighbourhood(_edges(t), F.lit(11).cast("long"))


@query(f"with {_EDGES}, l as (select list_sort(list(score)) as v from e) select round(v[(floor((len(v) - 1) * 0.6::double))::int + 1], 6) as cutoff from l")
def edge_cutoff(t: Tables):
    """The score below which the weakest edges of a view are hidden."""
    _, (cutoff,) = quantiles(_edges(t), "score", (0.6,), between=False)
    return t.spark.range(1).select(F.round(F.lit(cutoff).cast("double"), 6).alias("cutoff"))


@query("""with c as (select 0 as o, 'cluster' as kind, label::varchar as id, 'Group ' || label as label, count(*) as size from embeddings where label < 8 group by label),
l as (select 1 as o, 'fact' as kind, vec_id::varchar as id, 'Fact ' || vec_id as label, 1::bigint as size from embeddings where label >= 8), a as (select * from c union all select * from l)
select kind, id, label, size, (select count(*) from a) > 30 as truncated from a order by o, size desc, lower(label), id limit 30""")
def level_view(t: Tables):
    groups = t.embeddings.where("label < 8").groupBy(F.col("label").alias("id")).agg(F.count("*").alias("size")).withColumn("label", F.concat_ws(" ", F.lit("Group"), F.col("id").cast("string")))
    loose = t.embeddings.where("label >= 8").select(F.col("vec_id").alias("id"), F.concat_ws(" ", F.lit("Fact"), F.col("vec_id").cast("string")).alias("label"))
    return graph.level_view(groups, loose, 30)


@query("select label as grp, round(8 + 1.85::double * sqrt(count(*)), 6) as raw, round(greatest(10::double, least(26::double, 8 + 1.85::double * sqrt(count(*)))), 6) as node, round(greatest(0.68::double, least(2.1::double, 0.4::double + 0.28::double * log2(count(*) + 1))), 6) as edge from embeddings group by 1")
def visual_sizes(t: Tables):
    n = t.embeddings.groupBy(F.col("label").alias("grp")).agg(F.count("*").alias("n"))
    return n.select("grp", F.round(8 + 1.85 * F.sqrt("n"), 6).alias("raw"), F.round(N.node_size(F.col("n")), 6).alias("node"), F.round(N.edge_size(F.col("n")), 6).alias("edge"))


@query("""with p as (select o_orderkey as id, o_totalprice as x, o_custkey::double as y from orders), m as (select min(x) a, max(x) b, min(y) c, max(y) d from p)
select id, round((x - (a + b) / 2) / ((b - a) / 2), 6) as x, round((y - (c + d) / 2) / ((d - c) / 2), 6) as y from p, m""")
def minmax_axis(t: Tables):
    flat = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return cluster.spread(flat, ["x", "y"]).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("select count(*) as points, true as inside, true as touches from embeddings")
def layout_bounds(t: Tables):
    """The layout lies in the square and touches its edges."""
    flat = cluster.layout(_points(t))
    inside = (F.abs("x") <= 1 + 1e-9) & (F.abs("y") <= 1 + 1e-9)
    most = F.least(F.max(F.abs("x")), F.max(F.abs("y")))
    return flat.agg(F.count("*").alias("points"), F.every(inside).alias("inside"), (most > 1 - 1e-9).alias("touches"))


@query("select true as orthonormal, true as falling")
def pca_invariants(t: Tables):
    """Axes are orthonormal, and variances along them fall."""
    import numpy as np

    mean, axes = cluster.principal_axes(_points(t), 8)
    flat = _points(t).select(*(N.dot(F.transform("u", lambda x: x), F.array(*map(F.lit, axes[:, j].tolist()))).alias(f"c{j}") for j in range(8)))
    spread = flat.agg(*(F.variance(f"c{j}").alias(f"v{j}") for j in range(8)))
    straight = bool(np.allclose(axes.T @ axes, np.eye(8), atol=1e-8))
    falling = F.lit(True)
    for j in range(7):
        falling = falling & (F.col(f"v{j}") >= F.col(f"v{j + 1}") - 1e-9)
    return spread.select(F.lit(straight).alias("orthonormal"), falling.alias("falling"))


@query("select (select count(*) from embeddings) as points, 4::bigint as groups, true as sizes_add_up")
def partition_choice(t: Tables):
    """A cut of the average-linkage dendrogram of all points into four groups is a partition of them."""
    points = checkpointed(_points(t))
    members = t.embeddings.select("vec_id").join(cluster.cut(points, cluster.average_linkage(points), 4), F.col("vec_id") == F.col("id"))
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("d"))
    return sizes.agg(F.sum("n").alias("points"), F.count("*").alias("groups"), (F.sum("n") == F.sum("d")).alias("sizes_add_up"))


@query("select (select count(*) from embeddings) as points, true as themes_inside")
def hierarchy_invariants(t: Tables):
    """Every point is in the hierarchy once, and a theme lies in one domain."""
    found = checkpointed(cluster.hierarchy(_points(t), 12, 3, 0.0, 6))
    themes = found.where("theme is not null").groupBy("theme").agg(F.count_distinct("domain").alias("d")).agg(F.coalesce(F.max("d") <= 1, F.lit(True)).alias("themes_inside"))
    placed = t.embeddings.select(F.col("vec_id").alias("id")).join(found, "id")
    return placed.agg(F.count("id").alias("points")).crossJoin(themes)  # one row each


@query()
def point_clusters(t: Tables):
    """Domain and theme of every point, and points that belong nowhere."""
    return cluster.clustered(_points(t), 12, 3, 0.0, 0.45, 1.5, 6)


@query()
def partition_scores(t: Tables):
    """The silhouette of every cut of all points that has groups of three or more."""
    points = checkpointed(_points(t).withColumn("part", F.lit(0).cast("long")))
    found = cluster.partition_search(points, checkpointed(cluster.average_linkage(points)), 12, 3, 0.0)
    return found.scores.select("groups", F.round("silhouette", 6).alias("silhouette"), "least")


def _tree(t: Tables):
    top = t.spark.range(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = t.region.select(key("r", "r_regionkey").alias("id"), F.lit("root").alias("parent"))
    nations = t.nation.select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"))
    return top.union(regions).union(nations)


_TREE = "t as (select 'root' as id, null as parent union all select 'r' || r_regionkey, 'root' from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"


@query(f"with recursive {_TREE}, w as (select id, 0 as depth from t where id = 'r1' union all select t.id, w.depth + 1 from t join w on t.parent = w.id) select id, depth from w")
def tree_descendants(t: Tables):
    return tree.descendants(_tree(t), "r1")


@query(f"with recursive {_TREE}, w as (select id, id as root, id as path, 0 as depth from t where parent is null union all select t.id, w.root, w.path || '/' || t.id, w.depth + 1 from t join w on t.parent = w.id) select id, root, path, depth from w")
def tree_paths(t: Tables):
    return tree.paths(_tree(t))


@query("""select 'r2' as cluster, (select count(*) from nation where n_regionkey = 2) as children, (select count(*) from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2) as members""")
def subtree_detail(t: Tables):
    """A cluster with its children and all members of its subtree."""
    whole = _tree(t)
    below = tree.descendants(whole, "r2")
    members = t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id")).join(below.select("id"), "id", "left_semi").agg(F.count("*").alias("members"))
    children = whole.where("parent = 'r2'").agg(F.count("*").alias("children"))
    return children.crossJoin(members).select(F.lit("r2").alias("cluster"), "children", "members")


_LABELLED = """l as (select 'root' as id, null as parent, 'World' as label, 0 as level union all select 'r' || r_regionkey, 'root', r_name, 1 from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, 2 from nation
union all select 'c' || c_custkey, 'n' || c_nationkey, c_name, 3 from customer)"""


@query(f"""with recursive {_LABELLED}, w as (select id, parent, label, level from l where id = 'c9' union all select l.id, l.parent, l.label, l.level from l join w on l.id = w.parent)
select level as place, id, label, level from w where level > 0 union all select 0, null, 'All', 0""")
def breadcrumbs(t: Tables):
    """The way from the root to a customer."""
    names = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("label"), F.lit(1).alias("level")).union(
        t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_name", F.lit(2))
    )
    inner = _tree(t).join(names, "id", "left").select("id", "parent", F.coalesce("label", F.lit("World")).alias("label"), F.coalesce("level", F.lit(0)).alias("level"))
    leaves = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.col("c_name").alias("label"), F.lit(3).alias("level"))
    return tree.breadcrumb(inner.unionByName(leaves), "c9", "All")
