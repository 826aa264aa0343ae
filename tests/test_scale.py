"""Plans in which no long text is sorted or travels more often than once."""

from noema.operators import analysis
from noema.plans.registry import QUERIES


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString(), frame._jdf.queryExecution().sparkPlan().toString()


def test_ends_of_jobs_are_not_sorted(spark, sf_dir):
    _, physical = plan(QUERIES["job_finish"](spark, sf_dir))
    assert "SortMergeJoin" not in physical


def test_a_document_is_not_copied_for_each_passage(spark, sf_dir):
    logical, _ = plan(QUERIES["chunk_text_invariants"](spark, sf_dir))
    assert "Window" not in logical


def test_texts_of_passages_travel_once(spark, tmp_path):
    """No text is grouped, and tables between are compressed files, not checkpoints."""
    rows = [(1, i, 9 * i, 9 * i + 8, f"passage{i % 3}") for i in range(9)]
    spark.createDataFrame(rows, "source long, passage int, start int, end int, text string").write.parquet(f"file://{tmp_path}/new")
    new = spark.read.parquet(f"file://{tmp_path}/new")
    stored = new.where("passage < 6").withColumn("id", new["passage"].cast("string"))
    made = analysis.aligned_passages(new, stored, "2")
    logical, _ = plan(made)
    assert "first(text" not in logical and "LogicalRDD" not in logical
    assert made.where("state = 'kept'").count() == 6 and made.where("state = 'new'").count() == 3
