"""Exact quantiles and canonical JSON against plain Python."""

import json
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noema.functions.canonical import canonical_row
from noema.operators.selection import quantiles


def test_quantiles_of_spread_values_with_ties_and_nulls(spark):
    draw = random.Random(1)
    values = [draw.choice([draw.gauss(0, 1), 0.5, -1.0]) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(5)
    fractions = (0.0, 0.15, 0.25, 0.5, 0.75, 1.0)
    n, found = quantiles(frame, "x", fractions)
    assert n == 500 and np.allclose(found, np.quantile(values, fractions))
    _, lower = quantiles(frame, "x", fractions, between=False)
    assert lower == [sorted(values)[math.floor(499 * f)] for f in fractions]
    assert quantiles(frame.where("false"), "x", (0.5,)) == (0, [None])
    assert quantiles(frame.limit(1), "x", (0.3, 0.9))[0] == 1


TREE = st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=4), st.text(st.characters(codec="utf-8"), max_size=6), max_size=4)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(TREE, st.lists(st.one_of(st.none(), st.integers(-9, 9)), max_size=3), st.one_of(st.none(), st.booleans())), min_size=1, max_size=4))
def test_json_is_that_of_python(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, zeta map<string,string>, alpha array<int>, b boolean")
    made = frame.select("i", F.col("zeta"), F.struct("b", "alpha").alias("inner"))
    got = {r["i"]: r["c"] for r in made.select("i", canonical_row(made, "zeta", "inner").alias("c")).collect()}
    for i, (tree, numbers, yes) in enumerate(rows):
        value = {"zeta": tree, "inner": {"alpha": numbers, "b": yes}}
        assert got[i] == json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
