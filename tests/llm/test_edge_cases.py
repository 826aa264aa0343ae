"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns for every operator."""

from __future__ import annotations

from array import array

import pytest

from noema.llm import decontaminate, html_text, langid, language_model, minhash, pieces, pii, substrings, toxicity, vectors
from noema.llm.graph import connected_components
from noema.llm.staging import Staging

WORDS = [f"w{(i * i + 7 * i) % 997}x{i % 13}" for i in range(3000)]
PASSAGE = " ".join(WORDS[:60])
#: Columns named as results of the operators must not disturb them.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, score string, spans string, lang_pred string"
TEXTS = {
    1: None, 2: "", 3: " \t\n ", 4: PASSAGE, 5: PASSAGE, 6: PASSAGE + " one more", 7: "a", 8: " ".join(WORDS),
    9: "mail me at ann@example.org or 10.0.0.1", 10: "ünïcode ☃ 中文 \x00 end", 11: "start " + PASSAGE,
}


def table(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 2 else "de", None, None, "x", "x", "x", "x", "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [*TEXTS.items(), (4, PASSAGE), (None, "no id")]).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def ids(frame):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in frame.select("doc_id").collect())


def test_minhash(docs, none):
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert ids(minhash.near_duplicates(docs)) == ids(docs)
    assert [rows[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 11)] == [1, 2, 3, 4, 4, 4, 4]
    assert rows[1]["n_shingles"] == 0 and rows[7]["n_shingles"] == 1 and rows[1]["kept"] and not rows[5]["kept"]
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_representatives(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 4, 7, 8, 9, 10}
    assert not {r["doc_id"] for r in kept.collect()} & {5, 6, 11}


def test_substrings(docs, none):
    rows = {r["doc_id"]: r for r in substrings.dedup(docs).collect()}
    assert ids(substrings.dedup(docs)) == ids(docs)
    assert (rows[1]["n_words"], rows[1]["kept_text"], rows[6]["kept_text"], rows[11]["kept_text"]) == (0, "", "one more", "start")
    assert rows[8]["n_removed"] == 60 and rows[7]["kept_text"] == "a"
    assert substrings.dedup(none).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE.upper(), "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (1, PASSAGE, "x")], "item_id long, text string, doc_id string")
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert found == {(i, 1, 0) for i in (4, 5, 6, 8, 11)}
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & {4, 5, 6, 8, 11}
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    # short items count too, as they are
    short = spark.createDataFrame([(7, "in Some"), (8, "needle"), (9, "one two three four five"), (10, "stack of hay")], "item_id long, text string")
    texts = table(spark, [(1, "put in some, needle"), (2, "one two three for five six"), (3, "a stack of straw and hay"), (4, "in")])
    assert {(r["doc_id"], r["item_id"], r["distance"], r["start_word"]) for r in decontaminate.find_leaks(texts, short).collect()} == {(1, 7, 0, 1), (1, 8, 0, 3), (2, 9, 1, 0)}
    # several blocks of items give what one does
    blocks = decontaminate.Settings(block_items=1)
    assert sorted(decontaminate.find_leaks(texts, short, blocks).collect()) == sorted(decontaminate.find_leaks(texts, short).collect())
    # an edited copy: one word replaced, one left out, one put in
    words = PASSAGE.split()
    edited = " ".join([*words[:10], "other", *words[11:30], *words[31:50], "new", *words[50:]])
    assert [r["distance"] for r in decontaminate.find_leaks(table(spark, [(1, "before " + edited + " after")]), items.where("item_id = 1").limit(1)).collect()] == [3]


def test_language_model(docs, none):
    rows = language_model.score(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1} and all(r["score"] < 0 for r in rows)
    assert language_model.score(none).count() == 0


def test_language_model_learns_from_all_texts(spark, monkeypatch):
    rows = table(spark, [(i, " ".join(WORDS[i : i + 20])) for i in range(300)]).repartition(3)
    made, average = [], language_model.average
    monkeypatch.setattr(language_model, "average", lambda *a: made.append(average(*a)))
    settings = language_model.Settings(sample_docs=20)
    training = rows.where(language_model.training_rows(rows.doc_id))
    model = language_model.fit(training, language_model.count_tokens(training, settings), settings)
    assert sum(made) == model.total == 21 * training.count()


def test_pieces(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r["doc_id"]: r for r in pieces.encode_documents(docs, path, keep_ids=True).collect()}
    assert rows[1]["ids"] == rows[2]["ids"] == [1, 2] and rows[1]["decoded"] == ""
    assert rows[10]["decoded"] == TEXTS[10] and rows[3]["decoded"] == TEXTS[3] and rows[8]["decoded"] == TEXTS[8]
    assert pieces.encode_documents(none, path).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, None if i == 9 else i % 2, "x") for i in TEXTS], "doc_id long, toxic int, text string")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(none, labels).count() == 0


def test_pii(docs, none):
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert ids(pii.find(docs)) == ids(docs)
    assert [(x["kind"], x["start"], x["end"]) for x in rows[9]["spans"]] == [("email", 11, 26), ("ip", 30, 38)]
    assert rows[1]["spans"] == [] and pii.find(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[9] == "mail me at <EMAIL> or <IP>" and clean[1] is None and clean[8] == TEXTS[8]


def test_pii_discovers_values_by_context(spark):
    known = [(i, f"Please call the office number: +1 555 010 {1000 + i} today") for i in range(8)]
    hidden = [(100 + i, f"Please call the office number: 0555-77{i}-901 today") for i in range(2)]
    rows = {r["doc_id"]: r["all_spans"] for r in pii.find(table(spark, [*known, *hidden])).collect()}
    assert [x["kind"] for x in rows[100]] == ["phone"]


def test_pii_discovers_values_by_discovered_values(spark):
    """Three generations: only the first pattern is seen with seeds, the others with what the one before revealed."""
    seeds = [f"Please call the office number: +1 555 010 {1000 + i} today" for i in range(90)]
    first, second, third = ([f"{name}-{i}-{7 * i}" for i in range(n)] for name, n in (("0555a", 30), ("0666b", 10), ("0777c", 3)))
    texts = [
        *seeds, *(f"Please call the office number: {v} today" for v in first), *(f"Reach us under {v} tonight" for v in first + second),
        *(f"Our desk answers {v} always" for v in second + third), *(f"The batch was {i}-{i}-part made" for i in range(100, 140)),
    ]
    rows = [r["all_spans"] for r in pii.find(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert all([x["kind"] for x in r] == ["phone"] for r in rows[:-40]) and not any(rows[-40:])


def test_pii_discovers_numbers_in_groups_and_long_values(spark):
    known = [f"Please call the office number: +1 555 010 {1000 + i} today" for i in range(40)]
    hidden = ["0171 555 0199", "555 010 1234", "(555) 010-1234", "0171.555 0198", "A12 345 678", "x" * 70 + "1"]
    texts = [*known, *(f"Please call the office number: {v} today" for v in hidden)]
    docs = table(spark, list(enumerate(texts)))
    clean = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert set(clean) == {"Please call the office number: <PHONE> today"}
    spans = [r["all_spans"] for r in pii.find(docs).orderBy("doc_id").collect()][len(known) :]
    assert [[(x["kind"], x["start"], x["end"]) for x in r] for r in spans] == [[("phone", 31, 31 + len(v))] for v in hidden]


def test_pii_tells_long_values_apart():
    texts = ["a" * 80 + f"{i}@example.org" for i in range(3)]
    assert len({o[3] for t in texts for o in pii.occurrences(t, pii.base_spans(t), pii.Settings())}) == 3


def test_html(spark):
    schema = "page_id long, url string, html string, text string"
    story = "<p>" + "A long sentence of the story goes on here. " * 8 + "</p>"
    page = f"<html><head><title>t</title><style>x{{}}</style></head><body><nav><a>Home</a><a>News</a></nav><article><h1>Head &amp; line</h1>{story}<p>End.</p></article><div class='comments'><p>me too</p></div><footer>c</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (3, None, page, "x"), (4, "u", "<b>broken <i", "x"), (5, "u", "<div>" * 3000 + "deep text", "x"), (3, None, page, "x")], schema)
    out = html_text.extract(rows).collect()
    assert len(out) == 6
    found = {r["page_id"]: r["text"] for r in out}
    assert found[1] == found[2] == "" and found[3].startswith("Head & line A long") and found[3].endswith("here. End.") and found[5] == "deep text"
    assert html_text.extract(rows.limit(0)).count() == 0


def test_langid(docs, none):
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and 1 not in {r["doc_id"] for r in kept.collect()}
    assert {(r["score"], r["lang_pred"]) for r in kept.collect()} == {("x", "x")}  # the rows' own columns
    assert langid.identify(none).count() == 0


def test_vectors(spark):
    a, b = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [(1, a, 1), (2, b, 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 1.0, 1.0], 1), (8, [], 1), (9, a, 1), (10, [1.0, None, 1.0], 1), (11, [1.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table).collect()}
    assert found == {1: (2, 1, True), 2: (2, 1, False), 9: (2, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11)}}
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(None, 1), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges, Staging(spark, "t")).collect()}
    assert found == {i: 0 for i in range(301)}


def test_pipeline_links_from_a_similarity_of_four_fifths(spark):
    import corpus_pipeline

    # 100 five-word shingles each, shared with 122 (0.82) and with 128 (0.78)
    pairs = [(1, WORDS[:104]), (2, WORDS[:126]), (3, WORDS[500:604]), (4, WORDS[500:632])]
    docs = table(spark, [(i, " ".join(words)) for i, words in pairs])
    assert ids(corpus_pipeline.near_duplicates(spark, docs, "")) == [(False, i) for i in (1, 3, 4)]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0.2 * docs.count() < out.count() < docs.count()
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)


def test_minhash_rows_of_one_id_are_one_node(spark):
    """An id with several texts joins the groups of all of them; a text that an id repeats costs one row."""
    a, b, c = (" ".join(WORDS[k : k + 50]) for k in (0, 100, 200))
    rows = [(3, a), (5, a), (5, b), (9, b + " tail"), (7, c), (8, None), (8, c), (2, None), (2, ""), *[(5, b)] * 40, (None, a)]
    made = {}
    for r in minhash.near_duplicates(table(spark, rows).repartition(4)).collect():
        made.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert made == {3: {3}, 5: {3}, 9: {3}, 7: {7}, 8: {7}, 2: {2}, None: {3}} or made == {3: {3}, 5: {3}, 9: {3}, 7: {7}, 8: {7}, 2: {2}, None: {None}}
    kept = ids(minhash.keep_representatives(table(spark, rows)))
    assert [i for missing, i in kept if not missing] == [2, 2, 3, 7]


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    import random

    from noema.llm import graph

    draw = random.Random(4)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(None, 3), (5, 5)]
    root = list(range(1100))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in edges:
        if x is not None and x != y:
            x, y = sorted((find(x), find(y)))
            root[y] = x
    want = {n: find(n) for e in edges if e[0] is not None and e[0] != e[1] for n in e}
    frame = spark.createDataFrame(edges, "a long, b long")
    for local in (1 << 20, 0):
        monkeypatch.setattr(graph, "LOCAL", local)
        stage = Staging(spark, "t")
        assert {r["node"]: r["component"] for r in graph.connected_components(frame, stage).collect()} == want
        stage.close()


def test_pieces_of_new_words_come_from_runs_of_one_kind():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        model = pieces.PieceModel(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("zugabel, zugabel. (zugabel) zugabel;\nzugabel", "m²). x²y 12½ 555-2358 a_b  ,  7", "x٣٤ \t▁▁, naïvé\U0001f4a5 "):
        ids = array("I", model.encode(text)).tolist()
        assert ids == [library.bos_id(), *library.encode(text), library.eos_id()]
        assert model.decode_parts(model.encode_parts(text)) == library.decode(ids)
    # five words, but their letters are encoded twice only: with the mark before them, and without
    assert {s for s in model.segments if "zugabel" in s} == {"▁zugabel", "zugabel"}
