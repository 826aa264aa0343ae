"""The pipeline's stages against plain Python, and on rows of every odd kind."""

from __future__ import annotations

import hashlib
import struct
from itertools import combinations

import corpus_pipeline
from noema.llm import decontaminate, pii
from tests.llm.test_brute_force import _least, _plain_words, _shingles, components

import numpy as np


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = {}
    for name, apply in corpus_pipeline.STAGES:
        before = docs
        apply(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        held[name] = (before, docs)
    # clean documents of a language stay
    before, after = held["language"]
    plain = before.where("lang is not null and text rlike '[a-z]{3}'").count()
    assert after.columns == before.columns and after.count() >= 0.97 * plain
    # one document of each group of similarity 0.8 or more
    before, after = map(texts, held["near_duplicates"])
    sets = {i: _shingles(t or "") for i, t in before.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    groups = components(sets, links)
    assert links and set(after) == {i for i, c in groups.items() if i == c}
    # no document with a benchmark item
    before, after = map(texts, held["decontaminated"])
    settings, code = decontaminate.Settings(), {}
    number = lambda words: np.array([code.setdefault(w, len(code)) for w in words], dtype=int)
    items = [number(_plain_words(r["text"] or "")) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaky = set()
    for i, t in before.items():
        words = number(_plain_words(t or ""))
        own = set(words.tolist())
        for item in items:
            k = settings.budget(len(item))
            if len(item) and sum(w in own for w in item.tolist()) >= len(item) - k and _least(item.tolist(), words) <= k:
                leaky.add(i)
    assert set(after) == set(before) - leaky
    # every text without its spans
    before, after = held["without_personal_data"]
    spans = {r["doc_id"]: sorted((x["start"], x["end"], x["kind"]) for x in r["all_spans"]) for r in pii.find(before).collect()}
    masked, n_chars = texts(after), {r["doc_id"]: r["n_chars"] for r in after.collect()}
    for i, t in texts(before).items():
        for start, end, kind in reversed(spans[i]):
            t = t[:start] + f"<{kind.upper()}>" + t[end:]
        assert masked[i] == t
        assert not pii.base_spans(t or "")
        if spans[i]:
            assert n_chars[i] == len(t)
    # the library's ids
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r["doc_id"]: r for r in held["encoded"][1].collect()}
    assert set(rows) == set(masked)
    for i, t in masked.items():
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        assert rows[i]["ids"] == ids and rows[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_stages_on_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _key int, _id int, ids string, rejected int"
    rows = [
        (None, "the of and to in was his", "en", None, None, 1.5, "mine", 1, 2, "x", 7), (1, None, "en", "s", 0, None, None, None, None, None, None), (2, "", None, "s", 0, 1.0, "m", 1, 2, "x", 7),
        *[(10 + i, f"the and of to in that was his with for number {i} " * 3, "en", "s", 3, 1.0, "m", 1, 2, "x", 7) for i in range(30)],
        (10, "the and of to in that was his with for number 0 " * 3, "en", "s", 3, 1.0, "m", 1, 2, "x", 7),
        (60, "und der die das ist nicht mit auf " * 4000 + " ann@example.org", "de", "s", 3, 1.0, "m", 1, 2, "x", 7), (61, "und der die das ist ein", "de", "s", 3, 1.0, "m", 1, 2, "x", 7),
    ]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        for name, apply in corpus_pipeline.STAGES:
            out = apply(spark, frame, sf_dir)
            kept = out.collect()
            if name != "encoded":
                assert out.columns == docs.columns
                assert all((r["score"], r["lang_pred"], r["rejected"], r["_key"], r["_id"]) in ((1.0, "m", 7, 1, 2), (1.5, "mine", 7, 1, 2), (None,) * 5) for r in kept)
            if name in ("without_personal_data", "encoded"):
                assert len(kept) == frame.count()
