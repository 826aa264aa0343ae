"""Operators whose rows SQL can't give, against plain Python."""

from __future__ import annotations

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noema.operators import answers, chunking, graph, knowledge, tree
from noema.operators.cluster import average_linkage, best_partition, hierarchy
from noema.sources import generations, subtitles
from noema.streaming import queue


def estimate(text):
    text = text.strip()
    return max(1, math.ceil(max(len(text) / 4, 1.25 * len(re.findall(r"\w+|[^\w\s]", text))))) if text else 0


def greedy(text, target, most):
    """Passages by trying every next unit on the text itself."""
    spans, at = [], 0
    for m in [*re.finditer(r"(?:\r?\n[ \t]*){2,}", text), None]:
        part = text[at : m.start() if m else len(text)]
        if part.strip():
            a = at + len(part) - len(part.lstrip())
            spans.append((a, a + len(part.strip())))
        at = m.end() if m else at
    out, now = [], None
    for a, b in spans:
        assert estimate(text[a:b]) <= most  # the texts below have short paragraphs only
        if now and (estimate(text[now[0] : now[1]]) >= target or estimate(text[now[0] : b]) > most):
            out.append(now)
            now = None
        now = (now[0] if now else a, b)
    return out + ([now] if now else [])


def test_passages(spark):
    draw = random.Random(1)
    texts = ["\n\n".join(" ".join(draw.choices(["word", "a-b", "long" * 3, "end."], k=draw.randint(1, 12))) for _ in range(draw.randint(1, 25))) for _ in range(40)]
    limits = chunking.Limits(target=30, most=45)
    rows = chunking.chunk_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limits).collect()
    for i, text in enumerate(texts):
        own = sorted((r["passage"], r["char_start"], r["char_end"], r["tokens"], r["text"]) for r in rows if r["doc_id"] == i)
        wanted = greedy(text, 30, 45)
        assert own == [(k, a, b, estimate(text[a:b]), text[a:b]) for k, (a, b) in enumerate(wanted)]


def test_long_words_and_sentences_are_cut_within_the_limit():
    limits = chunking.Limits(target=5, most=8)
    text = "x" * 100 + " " + "Short. " * 5 + "y-z" * 40
    spans = list(chunking.text_passages(text, limits))
    assert all(estimate(text[a:b]) == n <= 8 for a, b, n in spans)
    assert "".join(text[a:b] for a, b, _ in spans).replace(" ", "") == text.replace(" ", "")


def test_cues_break_at_pauses_and_carry_over():
    cues = [(1, "one two three.", 0, 1000), (2, "four five six.", 1000, 2000), (3, "seven eight nine.", 9000, 10000), (4, "ten", 10000, 11000)]
    found = [[c for c, _ in p] for p in chunking.cue_passages(cues, chunking.Limits(target=12, most=40, overlap=1))]
    assert found == [[1, 2], [2, 3], [3, 4]] or found[0] == [1, 2]


def test_degree_bound_is_the_greedy_choice(spark):
    draw = random.Random(2)
    edges = {}
    for _ in range(300):
        a, b = sorted(draw.sample(range(40), 2))
        edges[a, b] = (draw.random() < 0.4, round(draw.random(), 4), round(draw.random(), 4))
    degree, kept = {}, set()
    for (a, b), (mutual, score, cosine) in sorted(edges.items(), key=lambda e: (not e[1][0], -e[1][1], -e[1][2], e[0])):
        if degree.get(a, 0) < 3 and degree.get(b, 0) < 3:
            kept.add((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    frame = spark.createDataFrame([(a, b, *v) for (a, b), v in edges.items()], "a long, b long, mutual boolean, score double, cosine double")
    assert {(r["a"], r["b"]) for r in graph.degree_bounded(frame, 3).collect()} == kept


def turn(degrees, third=0.0):
    x = math.radians(degrees)
    length = math.sqrt(1 + third * third)
    return [math.cos(x) / length, math.sin(x) / length, third / length]


def test_two_groups_are_found(spark):
    points = [(1, turn(0)), (2, turn(4)), (3, turn(8)), (4, turn(90)), (5, turn(94)), (6, turn(98))]
    frame = spark.createDataFrame(points, "id long, u array<double>")
    found = best_partition(frame, 4, 2, 0.1)
    assert found[0] == 2
    groups = {}
    for r in found[1].collect():
        groups.setdefault(r["grp"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6]]
    levels = {r["id"]: (r["domain"], r["theme"]) for r in hierarchy(frame, 4, 2, 0.1).collect()}
    assert {levels[i][0] for i in (1, 2, 3)} != {levels[i][0] for i in (4, 5, 6)} and len({v[0] for v in levels.values()}) == 2


def test_dendrogram_is_that_of_merging_one_pair_at_a_time(spark):
    draw = random.Random(3)
    points = [(i, turn(draw.uniform(0, 180), draw.uniform(-1, 1))) for i in range(12)]
    groups = {i: [u] for i, u in points}
    wanted = []
    while len(groups) > 1:
        sim = lambda a, b: sum(sum(x * y for x, y in zip(u, v)) for u in groups[a] for v in groups[b]) / len(groups[a]) / len(groups[b])
        value, a, b = max((sim(a, b), a, b) for a in groups for b in groups if a < b)
        groups[a] += groups.pop(b)
        wanted.append(round(value, 9))
    merges = average_linkage(spark.createDataFrame(points, "id long, u array<double>"))
    assert sorted(round(r["sim"], 9) for r in merges.collect()) == sorted(wanted)


def test_trees_of_any_depth_and_cycles(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(40)]
    frame = spark.createDataFrame([*chain, ("x", "y"), ("y", "x")], "id string, parent string")
    assert {r["id"]: r["depth"] for r in tree.paths(frame).collect()} == {str(i): i for i in range(40)}
    assert {r["id"]: r["depth"] for r in tree.descendants(frame, "x").collect()} == {"x": 0, "y": 1}
    assert tree.ancestor_at(tree.paths(frame), 30).count() == 10


def test_template_needs_all_values():
    with pytest.raises(ValueError):
        answers.render("{{a}} {{b}}", {"a": F.lit("x")})


def test_reduction_goes_over_levels_and_ends_or_fails(spark):
    rows = spark.createDataFrame([(1, i, "word " * 60) for i in range(30)] + [(2, 0, "one")], "source long, ord long, text string")
    shorter = lambda g: g.withColumn("text", F.substring("text", 1, 40))
    found = {r["source"]: r["summary"] for r in answers.reduced(rows, shorter, 100).collect()}
    assert set(found) == {"1", "2"} and found["2"] == "one" and len(found["1"]) == 40
    with pytest.raises(RuntimeError):
        answers.reduced(rows, lambda g: g, 20, levels=2)


def test_files_are_read_and_decoded(spark, tmp_path):
    texts = {"a.txt": "é".encode(), "b.txt": b"\xff\xfe" + "é".encode("utf-16-le"), "c.txt": "“é”".encode("cp1252"), "d.txt": b"", "e.txt": b"x" * 50}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    rows = subtitles.read_files(spark, f"file://{tmp_path}", 20).withColumn("text", subtitles.decode(F.col("data"))).collect()
    found = {r["path"].rsplit("/", 1)[1]: (r["verdict"], r["text"]) for r in rows}
    # Spark's reader passes empty files by
    assert found == {"a.txt": ("ok", "é"), "b.txt": ("ok", "é"), "c.txt": ("ok", "“é”"), "e.txt": ("too large", None)}


def test_generations_are_published_whole(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    assert generations.publish(spark, {"nodes": spark.range(3)}, root) == 1
    assert generations.publish(spark, {"nodes": spark.range(5)}, root) == 2
    assert generations.read(spark, "nodes", root).count() == 5


def test_streams(spark, tmp_path):
    schema = "key string, at timestamp"
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("b", "2024-01-01 00:01:00"), ("a", "2024-01-01 02:00:00")]
    frame = spark.createDataFrame(rows, "key string, at string").withColumn("at", F.col("at").cast("timestamp"))
    frame.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = queue.job_stream(spark, f"file://{tmp_path}/in", schema)

    def run(out, name, mode="append"):
        out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert len(run(queue.unique_requests(stream, "key", "at", "1 hour"), "requests")) == 2
    beats = run(queue.heartbeats(stream, "key", "at", "0 seconds", "1 hour"), "beats", "complete")
    assert sorted((r["key"], r["events"]) for r in beats) == [("a", 1), ("a", 2), ("b", 1)]
    parts = run(queue.sessions(stream, "key", "at", "0 seconds", "10 minutes"), "parts", "complete")
    assert sorted((r["key"], r["events"]) for r in parts) == [("a", 1), ("a", 2), ("b", 1)]
    queue.drain(stream, lambda b: b.groupBy("key").count(), f"file://{tmp_path}/done", f"file://{tmp_path}/mark").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/done").agg(F.sum("count")).first()[0] == 4


@pytest.mark.parametrize("overhead,zeros", [(2, 11), (0, 2)])
def test_bins_with_nulls_and_hot_group(spark, overhead, zeros):
    """A group over several ranges and Arrow batches, a null group, null tokens and items above the budget."""
    made = random.Random(5)
    rows = [(None if i % 5 == 0 else "hot" if i % 5 < 4 else f"g{i % 7}", i, None if i % zeros == 0 or 300 < i < 480 and not overhead else made.randrange(40)) for i in range(900)]
    want = {}
    for grp in {r[0] for r in rows}:
        number, used = 0, 0
        for _, i, n in (r for r in rows if r[0] == grp):
            if used and used + (n or 0) + overhead > 30:
                number, used = number + 1, 0
            used += (n or 0) + overhead
            want[i] = (grp, number)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        frame = spark.createDataFrame(rows, "grp string, ord long, tokens long").repartition(3)
        got = {r.ord: (r.grp, r.bin) for r in knowledge.bin_groups(frame, 30, overhead).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_facts_are_folded_in_small_batches(spark, monkeypatch):
    """What a worker holds doesn't grow with Spark's own 10,000 rows a batch of whole texts."""
    monkeypatch.setattr(knowledge, "FOLDED", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        rows = [(i, "T", f"É{i % 20}", ["a"], i) for i in range(60)]
        facts = spark.createDataFrame(rows, "ord long, title string, content string, tags array<string>, passage long").coalesce(1)
        assert {r["merged"] for r in knowledge.merge_facts(facts).collect()} == {3}
        sizes = facts.select("ord").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long")
        assert max(r["n"] for r in sizes.collect()) == 7
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
