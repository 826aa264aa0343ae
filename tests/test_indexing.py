"""Runs of an index one after another: only what is pending is embedded, faults go, orphans go."""

from pyspark.sql import functions as F

from noema.operators import indexing


def test_runs_follow_each_other(spark):
    nodes = spark.createDataFrame([(i, "s", f"title {i}", f"content {i}", i) for i in range(6)], "id long, source string, title string, content string, created_at int")
    points = spark.createDataFrame([], "id long, source string, fingerprint string, vector array<double>")
    marks = spark.createDataFrame([], "id long, fingerprint string, status string, attempts int")
    asked = []

    def embed(bad):
        def run(texts):
            asked.append(sorted(r["id"] for r in texts.collect()))
            return texts.select("id", F.when(F.col("id") == bad, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("vector"))

        return run

    first = indexing.index_run(nodes, points, marks, F.lit(4), embed(2), 2)
    assert asked[-1] == [0, 1, 2, 3, 4]
    assert {r["id"]: (r["status"], r["attempts"]) for r in first.marks.collect()} == {i: ("failed" if i == 2 else "indexed", 1) for i in range(5)}
    assert sorted(r["id"] for r in first.points.collect()) == [0, 1, 3, 4]
    assert [tuple(r) for r in first.faults.collect()] == [(2, "not indexed")]

    # node 0 is gone, node 1 has changed, node 5 is due now
    later = nodes.where("id > 0").withColumn("content", F.when(F.col("id") == 1, "other").otherwise(F.col("content")))
    second = indexing.index_run(later, first.points, first.marks.where("id > 0"), F.lit(9), embed(None), 2)
    assert asked[-1] == [1, 2, 5]
    assert sorted(r["id"] for r in second.points.collect()) == [1, 2, 3, 4, 5]
    assert {r["id"]: r["attempts"] for r in second.marks.collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1}
    assert second.faults.isEmpty()
    assert indexing.index_run(later.limit(0), second.points, second.marks, F.lit(9), embed(None), 2).points.isEmpty()
