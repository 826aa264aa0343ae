"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from noema.llm import lexical, queries
from tests.compare import differences, duck

TERM = re.compile(lexical.TERM)
A_TO_Z = {ord(c): ord(c) + 32 for c in lexical.UPPER}
SCHEMA = "doc_id long, text string, n long, score string, item_id string"


def brute(docs, items, k):
    counts = [(i, Counter(TERM.findall((t or "").translate(A_TO_Z)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + 25 * c.total() * total // length
            score = 0
            for t, q in Counter(TERM.findall((text or "").translate(A_TO_Z))).items():
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += q * w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def made(spark, docs, items, settings):
    d = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], SCHEMA).repartition(5)
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in lexical.search(d, b, settings).collect()), key=repr)


def test_sql(spark, sf_dir):
    assert differences(spark, duck(sf_dir), sf_dir, queries.op11_lexical_search, queries.oracle_sql()["op11_lexical_search"]) == ""


@pytest.mark.parametrize("settings", [lexical.Settings(k=4, probes=6, chunk_rows=8, group_rows=16), lexical.Settings(k=20, block_items=3), lexical.Settings(k=1, probes=1, group_rows=1)])
def test_against_every_document(spark, settings):
    draw = random.Random(3)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(80)]
    text = lambda n: " ".join(draw.choice(common if draw.random() < 0.6 else rare) for _ in range(n))
    docs = [(i, text(draw.randint(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties
    items = [(i, docs[i * 5][1] if i % 2 else text(15)) for i in range(8)]
    assert made(spark, docs, items, settings) == brute(docs, items, settings.k)


def test_odd_rows(spark):
    """Nulls, empty and blank texts, any letters, repeated rows and ids, items without a match, a term in all documents."""
    docs = [(1, None), (2, ""), (3, " .,;- "), (4, "Ünïcode ÉCOLE x"), (4, "ünïcode x"), (5, "x y"), (5, "x y"), (None, "x y"), (6, "don't-stop x\x00y"), (7, "x " * 5000 + "y"), (8, "ab abc abcd x"), (9, "中文 x")]
    items = [(1, "x Y y"), (2, None), (3, "..."), (4, "absent"), (5, "ÉCOLE ünïcode"), (5, "abc"), (None, "中文 T stop"), (1, "x Y y")]
    for block in (256, 2):
        assert made(spark, docs, items, lexical.Settings(block_items=block)) == brute(docs, items, 20)
    assert made(spark, [], items, lexical.Settings()) == [] and made(spark, docs, [], lexical.Settings()) == []
    assert made(spark, [(1, "  "), (2, None)], items, lexical.Settings()) == []


def test_thresholds_spare_postings(spark):
    """The threshold keeps lists of common terms out of what is fetched."""
    docs = [(i, "common " * (1 + i % 5) + f"word{i} filler{i % 9}") for i in range(400)] + [(900 + i, "common special rare thing") for i in range(5)]
    items = [(1, "special rare thing common")]
    block = lexical.Block([(0, ["special", "rare", "thing", "common"])])
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id as row", "doc_id", "text")
    sent = spark.sparkContext.broadcast(block)
    counts = lexical.term_counts(rows, sent)
    lists = lexical.postings(counts, lexical.np.array([1, 5000, 5000, 5000]), lexical.np.ones(4, dtype=int), 405, 1500)
    near = lexical.fetched(lists, sent, lexical.np.array([4_000_000]), lexical.np.full(4, 10**7), 2, 4)
    assert {r["row"] for r in near.collect()} == {900 + i for i in range(5)}
    assert made(spark, docs, items, lexical.Settings(k=4)) == brute(docs, items, 4)
