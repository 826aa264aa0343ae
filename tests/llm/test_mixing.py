"""Water-filling against a plain loop, and mixes against what they promise."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from noema.llm import mixing, queries
from tests.compare import differences, duck

SCHEMA = "doc_id long, text string, source string, size string, whole long, repetition string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 9, "y") for i, t, s in rows], SCHEMA).repartition(3)


def plain_level(sizes, weights, percent, epochs):
    """Targets by clamping whole sources until nothing lies above its cap."""
    budget, open_, target = percent * sum(sizes.values()) / 100, {s for s in sizes if weights.get(s, 0) > 0 and sizes[s]}, dict.fromkeys(sizes, 0.0)
    while open_:
        level = budget / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > epochs * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        for s in over:
            target[s] = float(epochs * sizes[s])
            budget -= target[s]
        open_ -= over
    return target


def plain_taken(rows, target, seed):
    """Documents of a source in the order of hash, id and size, until the rest of the target is used up."""
    taken = {}
    for source, want in target.items():
        own = [(int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16), i, n) for i, s, n in rows if s == source]
        size = sum(n for _, _, n in own)
        whole = int(want // size) if size else 0
        rest = int(want + 0.5) - whole * size
        for _, i, n in sorted(own):
            taken[i] = whole * n + min(n, rest)
            rest -= min(n, rest)
    return taken


def test_sql(spark, sf_dir):
    assert differences(spark, duck(sf_dir), sf_dir, queries.op12_source_mix, queries.oracle_sql()["op12_source_mix"]) == ""


@pytest.mark.parametrize("percent,epochs", [(150, 2), (40, 1), (500, 2)])
def test_against_plain_loop(spark, percent, epochs):
    rows = [(i, "w " * (1 + (i * i) % 37), f"s{i % 7 if i % 3 else 0}") for i in range(400)]
    weights = {f"s{k}": (k * 3) % 5 for k in range(7)}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = plain_level(sizes, weights, percent, epochs)
    settings = mixing.Settings(percent=percent, epochs=epochs, seed=5)
    given = spark.createDataFrame(list(weights.items()), "source string, weight long")
    made = {r["doc_id"]: r for r in mixing.mix(table(spark, rows), given, settings).collect()}
    want = plain_taken([(i, s, len(t.split())) for i, t, s in rows], target, 5)
    for i, t, s in rows:
        assert made[i]["target"] == pytest.approx(target[s]) and made[i]["source_size"] == sizes[s]
        assert made[i]["taken"] == want[i] and made[i]["taken"] <= epochs * made[i]["size"]


def test_without_broadcast(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 5}") for i in range(200)]
    docs = table(spark, rows)
    weights = mixing.cyclic_weights(docs, (3, 1, 2))
    few, many = (sorted(map(tuple, mixing.mix(docs, weights, mixing.Settings(broadcast_rows=n)).collect())) for n in (100_000, 0))
    assert few == many


def test_odd_rows(spark):
    """Null sources, texts and ids, blank texts, repeated rows, empty tables, clashing columns."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t ", "b"), (4, "x y z", None), (5, "x y z", None), (None, "p q", "c"), (None, "p q", "c"), (None, "p", "c"), (7, "only", "a"), (7, "only", "a")]
    docs = table(spark, rows)
    weights = mixing.cyclic_weights(docs, (3, 1, 2))
    assert {r["source"]: r["weight"] for r in weights.collect()} == {"a": 3, "b": 1, "c": 2, None: 3}
    made = mixing.mix(docs, weights).collect()
    assert len(made) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in made)
    by = defaultdict(list)
    for r in made:
        by[r["source"]].append(r)
    for rows_ in by.values():
        assert abs(sum(r["taken"] for r in rows_) - rows_[0]["target"]) <= len(rows_)
    assert {r["taken"] for r in by["b"]} == {0} and by["b"][0]["target"] == 0.0
    none = docs.where("false")
    assert mixing.mix(none, mixing.cyclic_weights(none, (3, 1, 2))).count() == 0
    assert {r["taken"] for r in mixing.mix(docs, weights.where("false")).collect()} == {0}


def test_hot_source_and_reruns(spark):
    rows = [(i, "w " * 10, "hot" if i % 3 else f"s{i % 11}") for i in range(3000)]
    docs = table(spark, rows)
    weights = mixing.cyclic_weights(docs, (3, 1, 2))
    first = sorted(map(tuple, mixing.mix(docs, weights).collect()))
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(7), weights).collect()))
    sums = mixing.mix(docs, weights).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.count_if(F.col("part").between(1, F.col("size") - 1)).alias("cut"))
    for r in sums.collect():
        assert abs(r["t"] - r["w"]) <= 0.5 + 1e-6 and r["cut"] <= 1


def test_mixed_documents(spark):
    rows = [(i, " ".join(f"{i}.{k}" for k in range(1 + i % 6)) + "  ", f"s{i % 3}") for i in range(60)]
    docs = table(spark, rows)
    weights = mixing.cyclic_weights(docs, (3, 1, 2))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, weights).collect()}
    out = mixing.mixed_documents(docs, weights)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["text"])
    texts = {i: t for i, t, _ in rows}
    for i, n in taken.items():
        assert sum(len(t.split()) for t in got[i]) == n
        assert all(texts[i].split()[: len(t.split())] == t.split() for t in got[i])
