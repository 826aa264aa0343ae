"""A fingerprint log that outlives a run."""

from __future__ import annotations

import random

from noema.llm import substrings


def texts():
    draw = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    shared = [" ".join(draw.choices(words, k=60)) for _ in range(4)]
    out = []
    for i in range(30):
        own = " ".join(draw.choices(words, k=draw.choice([10, 80, 200])))
        out.append((i, f"{own} {shared[i % 4]} tail {i}" if i % 3 == 0 else own))
    # the same windows in runs that differ: part of a passage only
    out.append((30, "start " + " ".join(shared[0].split()[5:50]) + " other end"))
    return out


def rows(frame):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in frame.collect()}


def test_two_runs_equal_one(spark, tmp_path):
    every = texts()
    schema = "doc_id long, text string"
    whole = rows(substrings.dedup(spark.createDataFrame(every, schema)))
    assert sum(n for _, n, _ in whole.values()) > 500
    first, second, third = (spark.createDataFrame(part, schema) for part in (every[:12], every[12:22], every[22:]))
    folder = f"file://{tmp_path}/log"
    settings = substrings.Settings(tables=1)
    rows(substrings.dedup(first, settings, substrings.FingerprintLog(spark, folder, settings)))
    # opened anew for each batch
    log = substrings.FingerprintLog(spark, folder, settings)
    assert len(log.names) == 1
    rows(substrings.dedup(second, settings, log, first))
    log = substrings.FingerprintLog(spark, folder, settings)
    found = rows(substrings.dedup(third, settings, log, first.union(second)))
    assert found == {i: whole[i] for i, _ in every[22:]}
    assert len(log.names) == 1  # compacted
    # what was written without a list of names doesn't count
    spark.range(1).write.parquet(f"{folder}/run-000000999")
    assert substrings.FingerprintLog(spark, folder, settings).names == log.names


def test_a_batch_again_repeats_everything(spark, tmp_path):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)))], "doc_id long, text string")
    folder = f"file://{tmp_path}/log"
    assert rows(substrings.dedup(docs, log=substrings.FingerprintLog(spark, folder)))[1][1] == 0
    assert rows(substrings.dedup(docs, log=substrings.FingerprintLog(spark, folder), history=docs))[1][1] == 50
