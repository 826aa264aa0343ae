"""Passages that keep their ids, runs that resume, and one generation of findings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from noema.operators import analysis, chunking
from noema.sources import generations

PASSAGES = "id string, source long, passage long, text string"


def cut(sources):
    made = chunking.chunk_texts(sources, chunking.Limits(target=30, most=40), key="source")
    return made.select("source", "passage", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "text")


def first_import(spark, rows):
    sources = spark.createDataFrame(rows, "source long, text string")
    none = spark.createDataFrame([], "id string, source long, passage int, start int, end int, text string")
    return analysis.prepared(sources, none, spark.createDataFrame([], "source long, mark string"), cut, "1")


def test_an_edit_keeps_all_other_ids(spark):
    draw = random.Random(1)
    lines = [" ".join(f"w{draw.randint(0, 500)}" for _ in range(25)) + "." for _ in range(30)]
    before, same, gone = "\n\n".join(lines), "\n\n".join(lines[:4]), "\n\n".join(lines[5:8])
    stored = first_import(spark, [(1, before), (2, same), (3, gone), (4, None)]).drop("state").cache()
    known = spark.createDataFrame([(1, before), (2, same), (3, gone)], "source long, text string").select("source", F.md5("text").alias("mark"))
    lines[12] = "a new line that says something else altogether. " * 2
    after = spark.createDataFrame([(1, "\n\n".join(lines)), (2, same), (5, same)], "source long, text string")
    cuts = []
    rows = analysis.prepared(after, stored, known, lambda s: cuts.append(s) or cut(s), "2").collect()
    assert {r["source"] for r in cuts[0].collect()} == {1, 5}
    old = {(r["source"], r["text"]): r["id"] for r in stored.collect()}
    for r in rows:
        if r["source"] in (1, 2) and r["state"] != "new":
            assert old[r["source"], r["text"]] == r["id"]
        if r["source"] == 1 and (r["source"], r["text"]) in old:
            assert r["state"] in ("kept", "moved", "retired")
    assert {r["state"] for r in rows if r["source"] == 2} == {"kept"} and {r["state"] for r in rows if r["source"] == 3} == {"retired"}
    assert {r["state"] for r in rows if r["source"] == 5} == {"new"}
    changed = [r for r in rows if r["source"] == 1 and r["state"] == "new"]
    assert 1 <= len(changed) <= 3 and len({r["id"] for r in rows if r["state"] != "retired"}) == sum(r["state"] != "retired" for r in rows)


def test_repeated_texts_keep_ids_on_both_sides(spark):
    schema = "source long, passage int, start int, end int, text string"
    table = lambda texts: spark.createDataFrame([(1, i, 2 * i, 2 * i + 1, t) for i, t in enumerate(texts)], schema)
    stored = table("abaca").withColumn("id", F.concat(F.lit("p"), "passage"))
    rows = {r["passage"]: r for r in analysis.aligned_passages(table("axbaca"), stored, "2").where("state <> 'retired'").collect()}
    assert [rows[i]["id"] if rows[i]["state"] != "new" else "new" for i in range(6)] == ["p0", "new", "p1", "p2", "p3", "p4"]
    rows = analysis.aligned_passages(table("aaa"), stored, "3").collect()
    assert sorted(r["id"] for r in rows if r["state"] != "retired") == ["p0", "p2", "p4"] and {r["id"] for r in rows if r["state"] == "retired"} == {"p1", "p3"}
    assert analysis.aligned_passages(table("a").where("false"), stored.where("false"), "1").count() == 0


def test_a_killed_run_resumes(spark, tmp_path):
    passages = spark.createDataFrame([(f"{s}.{p}", s, p, f"text {s} {p}") for s in range(3) for p in range(4)], PASSAGES)
    good, calls = F.col("payload").startswith("ok"), []

    def generate(wave, dies=()):
        ids = sorted(r["id"] for r in wave.collect())
        calls.append(ids)
        if set(ids) & set(dies):
            raise RuntimeError("killed")
        return wave.select("id", F.concat(F.lit("ok "), "text").alias("payload"))

    folder = f"file://{tmp_path}/run"
    with pytest.raises(RuntimeError):
        analysis.analysis_run(passages, folder, lambda w: generate(w, ("1.2",)), good)
    state = {r["id"]: (r["status"], r["attempts"]) for r in analysis.analysis_state(passages, f"{folder}/log", good).collect()}
    assert {i: s for i, s in state.items() if i.endswith((".0", ".1"))} == {f"{s}.{p}": ("completed", 1) for s in range(3) for p in (0, 1)}
    assert {state[f"{s}.2"] for s in range(3)} == {("running", 1)} and {state[f"{s}.3"] for s in range(3)} == {("pending", 0)}
    calls.clear()
    done = {r["id"]: (r["status"], r["attempts"]) for r in analysis.analysis_run(passages, folder, generate, good).collect()}
    assert calls == [["0.2", "1.2", "2.2"], ["0.3", "1.3", "2.3"]]
    assert done == {f"{s}.{p}": ("completed", 2 if p == 2 else 1) for s in range(3) for p in range(4)}
    calls.clear()
    assert analysis.analysis_run(passages, folder, generate, good).count() == 12 and calls == []
    # another text is another task; a rule that became stricter too
    edited = passages.withColumn("text", F.when(F.col("id") == "2.0", "other").otherwise(F.col("text")))
    again = {r["id"]: (r["status"], r["attempts"]) for r in analysis.analysis_run(edited, folder, generate, good, at_once=3).collect()}
    assert calls == [["2.0"]] and again["2.0"] == ("completed", 2)


def test_a_source_stops_at_its_failure_and_others_go_on(spark, tmp_path):
    passages = spark.createDataFrame([(f"{s}.{p}", s, p, f"text {s} {p}") for s in range(2) for p in range(5)], PASSAGES)
    good, folder = F.length("payload") > 2, f"file://{tmp_path}/run"
    bad = lambda w: w.where("id <> '1.3'").select("id", F.when(F.col("id") == "0.1", "no").otherwise(F.col("text")).alias("payload"))
    state = {r["id"]: r["status"] for r in analysis.analysis_run(passages, folder, bad, good, at_once=2).collect()}
    assert [state[f"0.{p}"] for p in range(5)] == ["completed", "failed", "pending", "pending", "pending"]
    assert [state[f"1.{p}"] for p in range(5)] == ["completed", "completed", "completed", "failed", "pending"]
    none = passages.where("false")
    assert analysis.analysis_run(none, f"file://{tmp_path}/none", bad, good).count() == 0


def test_findings_refuse_what_would_be_doubled_or_unfounded(spark):
    facts = spark.createDataFrame([(1, "T", "c", ["x", "y"], [0, 1]), (1, "t", "C", ["z"], [1]), (2, "T", "c", ["x"], [0]), (3, "T", "c", ["new"], [0, 9])], "source long, title string, content string, tags array<string>, passages array<int>")
    passages = spark.createDataFrame([(f"{s}-{p}", s, p, 0, 3, f"ex {p}") for s in (1, 2, 3) for p in (0, 1)], "id string, source long, passage int, start int, end int, text string")
    held = spark.createDataFrame([("n", 2)], "node string, source long")
    made = analysis.findings(facts, passages, held, spark.createDataFrame([("x",)], "name string"))
    assert [(r["source"], r["reason"]) for r in made.refused.orderBy("source").collect()] == [(2, "has nodes"), (3, "passage is missing")]
    assert made.nodes.count() == 1 and sorted(r["name"] for r in made.node_tags.collect()) == ["x", "y", "z"]
    assert {(r["name"], r["origin"]) for r in made.tags.collect()} == {("x", "existing"), ("y", "created"), ("z", "created")}
    assert sorted((r["place"], r["passage_id"], r["excerpt"]) for r in made.evidence.collect()) == [(0, "1-0", "ex 0"), (1, "1-1", "ex 1")]


def test_two_writers_cannot_share_a_generation(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    assert generations.newest(spark, root) == 0
    assert generations.publish(spark, {"t": spark.range(3)}, root) == 1
    assert generations.publish(spark, {"t": spark.range(4)}, root, base=1) == 2
    with pytest.raises(generations.Conflict):
        generations.publish(spark, {"t": spark.range(5)}, root, base=1)
    assert generations.read(spark, "t", root).count() == 4 and generations.read(spark, "t", root, 1).count() == 3
    (tmp_path / "g" / "published" / "3").touch()  # a writer that died
    assert generations.newest(spark, root) == 2
    with pytest.raises(generations.Conflict):
        generations.publish(spark, {"t": spark.range(5)}, root)


def test_texts_travel_apart_from_places(spark, monkeypatch):
    """What is placed and joined has marks of texts only."""
    seen, placed = [], analysis._placed
    monkeypatch.setattr(analysis, "_placed", lambda rows: seen.append(rows.columns) or placed(rows))
    new = spark.createDataFrame([(1, 0, 0, 1, "a"), (1, 1, 2, 3, "b")], "source long, passage int, start int, end int, text string")
    stored = spark.createDataFrame([("x", 1, 0, 0, 1, "a"), ("y", 1, 1, 2, 3, "c")], "id string, source long, passage int, start int, end int, text string")
    rows = {(r["state"], r["text"]) for r in analysis.aligned_passages(new, stored, "1").collect()}
    assert rows == {("kept", "a"), ("new", "b"), ("retired", "c")}
    assert seen and not any("text" in columns for columns in seen)
