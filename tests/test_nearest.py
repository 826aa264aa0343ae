"""Exact nearest neighbours over several blocks and strips, with copies that tie, against all products."""

import numpy as np
import pytest

from noema.operators import similarity
from noema.operators.lineage import checkpointed


def test_blocks_strips_and_ties(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "STRIP", 7)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(150, 8))
    x[60:100] = x[60]  # forty copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(int(i), row.tolist()) for i, row in enumerate(x)], "id long, u array<double>")
    got = {(r["id"], r["rank"]): (r["other"], round(r["sim"], 8)) for r in similarity.nearest(points, 5, 0.1).collect()}
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -9)
    wanted = {}
    for i, row in enumerate(sims):
        for rank, j in enumerate(np.lexsort((np.arange(150), -row))[:5]):
            if row[j] >= 0.1:
                wanted[i, rank + 1] = (j, round(row[j], 8))
    assert got.keys() == wanted.keys()
    assert all(got[k][0] == wanted[k][0] and abs(got[k][1] - wanted[k][1]) < 1e-7 for k in got)


def test_few_points(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, u array<double>")
    assert similarity.nearest(one, 3).count() == 0
    assert similarity.nearest(one.limit(0), 3).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, u array<double>")
    assert [(r["id"], r["other"]) for r in similarity.nearest(two, 3).orderBy("id").collect()] == [(1, 2), (2, 1)]


def test_regions_give_the_same_rows_with_few_products(spark, monkeypatch):
    draw = np.random.default_rng(4)
    middles = draw.normal(size=(12, 16))
    x = middles[np.arange(600) % 12] + draw.normal(size=(600, 16)) * 0.05
    x[100:130] = x[100]  # copies that tie
    x[590:] = draw.normal(size=(10, 16))  # points far from all
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(int(i), row.tolist()) for i, row in enumerate(x)], "id long, u array<double>").repartition(4)
    rows = lambda f: sorted((r["id"], r["rank"], r["other"], round(r["sim"], 8)) for r in f.collect())
    wanted = rows(similarity.nearest(points, 6, 0.2))
    assert rows(similarity.nearest_by_regions(points, 6, 0.2, pivots=30, block=25)) == wanted
    assert rows(similarity.nearest_by_regions(points, 6, 0.2, pivots=1)) == wanted
    regions = similarity.Regions(points, 30, 25)
    own = regions.inside(6, 0.2)
    asked = regions.open(own, 6, 0.2).groupBy("other").count().collect()
    products = int((regions.sizes**2).sum()) + sum(r["count"] * int(regions.sizes[r["other"]]) for r in asked)
    assert products < 600 * 600 / 4
    monkeypatch.setattr(similarity, "BLOCK", 100)
    assert rows(similarity.nearest(points, 6, 0.2, unit=True)) == wanted


def test_points_without_clusters_go_by_blocks(spark, monkeypatch):
    """Regions pass by nothing here: no table may hold a copy of a point for each of them."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(700, 24))
    x[40:60] = x[40]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(int(i), row.tolist()) for i, row in enumerate(x)], "id long, u array<double>").repartition(4)
    rows = lambda f: sorted((r["id"], r["rank"], r["other"], round(r["sim"], 8)) for r in f.collect())
    wanted = rows(similarity.nearest(points, 6, 0.2))
    monkeypatch.setattr(similarity, "BLOCK", 300)
    monkeypatch.setattr(similarity.Regions, "open", lambda *_: pytest.fail("copies for every region"))
    assert rows(similarity.nearest(points, 6, 0.2, unit=True)) == wanted


def test_asked_regions_are_counted_as_they_are_listed(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(int(i), row.tolist()) for i, row in enumerate(x)], "id long, u array<double>").coalesce(1)
    regions = similarity.Regions(points, 64, 500)
    own = checkpointed(regions.inside(4, -1.0))
    opened = regions.open(own, 4, -1.0)
    assert opened.count() == int(regions.asked(own, 4, -1.0).sum()) > 2000 * 32


def test_a_cell_is_taken_apart_as_it_comes(spark):
    """Its batches are used up one by one, and each strip's rows leave at once."""
    import pyarrow as pa

    draw = np.random.default_rng(5)
    x = draw.normal(size=(900, 4))
    ids = draw.permutation(900)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("is_first", pa.bool_()), ("id", pa.int64()), ("u", pa.list_(pa.float64()))])
    batches = (
        pa.RecordBatch.from_arrays([pa.array([0] * 100, pa.int32()), pa.array([1] * 100, pa.int32()), pa.array((ids[at : at + 100] % 2 == 0).tolist()), pa.array(ids[at : at + 100]), pa.array(x[ids[at : at + 100]].tolist())], schema=schema)
        for at in range(0, 900, 100)
    )
    first, second, own = similarity._sides(batches)
    assert not own and first[0].tolist() == list(range(0, 900, 2)) and np.allclose(second[1], x[1::2])
    found = similarity._best(first, second, 2, -1.0)
    assert next(found).num_rows == 2 * similarity.STRIP


def test_copies_of_one_vector_are_put_in_order_a_part_at_a_time():
    """All products are equal: what is held beside the product doesn't grow with their number."""
    import tracemalloc

    n = 8192
    ids, x = np.arange(n) * 3, np.tile(np.eye(4)[1], (n, 1))
    tracemalloc.start()
    parts = [(b.column("id").to_numpy(), b.column("other").to_numpy()) for b in similarity._best((ids[:300], x[:300]), (ids, x), 3, -1.0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = np.stack([np.concatenate(c) for c in zip(*parts)], axis=1).tolist()
    assert got == [[i * 3, j * 3] for i in range(300) for j in [c for c in range(4) if c != i][:3]]
    assert peak < 20e6


def test_a_vector_is_measured_once_and_not_for_each_component(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]), (7, [1.0, None]), (8, [-2.0])]
    units = similarity.unit_vectors(spark.createDataFrame(rows, "id long, embedding array<float>"))
    assert sorted((r["id"], r["u"]) for r in units.collect()) == [(1, [0.6, 0.8]), (8, [-1.0])]
    plan = units._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("sqrt(") == 1  # a second one stood in the function of the components
