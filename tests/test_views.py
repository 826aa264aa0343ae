"""What a view shows, ways to the root, templates, profiles and points, by small cases."""

import random

import pytest
from pyspark.sql import functions as F

from noema.operators import answers, indexing, tree, views
from noema.sources import subtitles

EDGES = [("k1", "k2", 0.9), ("k2", "k3", 0.2), ("k3", "k4", 0.5), ("k4", "c1", 0.7), ("k1", "k4", float("nan"))]


@pytest.fixture(scope="module")
def view(spark):
    nodes = spark.createDataFrame([(f"k{i}", "knowledge") for i in range(1, 6)] + [("c1", "cluster")], "id string, kind string")
    return nodes, spark.createDataFrame(EDGES, "source string, target string, score double")


def shown(frame, key="id"):
    return {r[key] if isinstance(key, str) else tuple(r[k] for k in key): (r["hidden"], r["highlighted"], r["dimmed"]) for r in frame.collect()}


def test_focus_and_mark_are_highlighted_and_never_hidden(view):
    found = shown(views.presentation(*view, "k1", "k5", "domains").nodes)
    assert found == {"k1": (False, True, False), "k2": (True, False, False), "k3": (True, False, True), "k4": (True, False, False), "k5": (False, True, True), "c1": (False, False, True)}
    assert shown(views.presentation(*view, "gone", None, "knowledge").nodes) == {i: (False, False, False) for i in ("k1", "k2", "k3", "k4", "k5", "c1")}


def test_edges_around_a_focus_or_over_a_cutoff(view):
    key = ("source", "target")
    found = shown(views.presentation(*view, "k4", None, "themes").edges, key)
    assert {k: v for k, v in found.items() if v[1]} == {("k3", "k4"): (False, True, False), ("k4", "c1"): (False, True, False), ("k1", "k4"): (False, True, False)}
    assert all(v == (True, False, True) for v in found.values() if not v[1])
    hidden = {k for k, v in shown(views.presentation(*view, None, None, "knowledge").edges, key).items() if v[0]}
    assert hidden == set()  # of four scores the one at floor(3 / 4) is the lowest
    assert not any(v[0] for v in shown(views.presentation(*view, None, None, "domains").edges, key).values())


def test_counts_of_relations_are_whole_and_at_least_one(spark, view):
    edges = spark.createDataFrame([("k1", "k2", 2.0, 2.9), ("k2", "k1", float("inf"), 0.2), ("k2", "k3", 0.1, None), ("k3", "k3", 1.0, 9.0), ("k3", "x", 1.0, 9.0)], "source string, target string, score double, relations double")
    found = {(r["source"], r["target"]): (r["score"], r["relations"]) for r in views.canonical_edges(edges, view[0]).collect()}
    assert found == {("k1", "k2"): (1.0, 2), ("k2", "k3"): (0.1, 1)}


def test_way_to_the_root(spark):
    rows = [("r", None, "Root", 0), ("a", "r", "A", 1), ("b", "a", "B", 2), ("x", "y", "X", 1), ("y", "x", "Y", 2), ("o", "gone", "O", 3)]
    frame = spark.createDataFrame(rows, "id string, parent string, label string, level int")
    way = lambda i: [r["label"] for r in tree.breadcrumb(frame, i, "All").orderBy("place").collect()]
    assert way("b") == ["All", "A", "B"] and way("y") == ["All", "X", "Y"] and way("o") == ["All", "O"]
    assert way(None) == way("none") == way("r") == ["All"]


def test_templates_and_label_blocks(spark):
    made = spark.range(1).select(answers.render("{{a}} {{ a }} {{A}} {{a1}} {{{a}}}", {"a": F.lit("{{a}}")}).alias("t")).first()["t"]
    assert made == "{{a}} {{ a }} {{A}} {{a1}} {{{a}}}"
    clusters = spark.createDataFrame([("c1", 1, 3, ["n2", "gone", "n1"]), ("c2", 2, 0, [])], "key string, level int, size int, representatives array<string>")
    nodes = spark.createDataFrame([("n1", "One", []), ("n2", "Two", ["x", "y"])], "id string, title string, tags array<string>")
    blocks = {r["key"]: r["block"].split("\n") for r in answers.label_contexts(clusters, nodes).collect()}
    assert blocks["c1"][0::1][:3] == ["[CLUSTER c1]", "Niveau: 1", "Membres: 3"] and blocks["c1"][4:] == ["- Titre: Two", "  Tags: x, y", "- Titre: One", "  Tags: aucun"]
    assert blocks["c2"][-1] == "- Aucune"


def test_profiles_fit_by_model_version_and_digest(spark):
    rows = spark.createDataFrame([("m", "d", 1), ("m:latest", None, 1), ("m:v2", "d", 1), ("m", "d", 2)], "name string, digest string, version int")
    fits = lambda name, digest: [r[0] for r in rows.select(indexing.profile_fits(F.col("name"), F.col("digest"), F.col("version"), name, digest, 1)).collect()]
    assert fits("m", "d") == [True, False, False, False] and fits("m:latest", None) == [True, True, False, False] and fits("m:v2", "d") == [False, False, True, False]


def test_eight_bit_sets_are_told_apart(spark):
    texts = {"cp1252": "L’été à Noël : « garçon » coûte 5 €", "cp1251": "Привет, это простой русский текст о погоде.", "cp1253": "Καλημέρα, αυτό είναι ένα απλό ελληνικό κείμενο."}
    rows = [(name, bytearray(text.encode(name))) for name, text in texts.items()] + [("utf8", bytearray("été".encode())), ("blank", bytearray(b" \n")), ("lost", bytearray("a�".encode()))]
    found = {r["name"]: r["text"] for r in spark.createDataFrame(rows, "name string, data binary").select("name", subtitles.decode(F.col("data")).alias("text")).collect()}
    assert found == texts | {"utf8": "été", "blank": None, "lost": None}


def test_short_texts_of_two_scripts_are_told_apart(spark):
    """Both scripts use the same bytes for most letters; more vowels don't make the likelier reading."""
    cyrillic = ["дие цхен пфен енсцхеин.", "ед, бле. ен реес.", "ин ерерон схен ербле ерхехахе.", "съезд", "жизнь"]
    greek = ["ίστ ύνδ δερ δεν.", "εδ, βλε. εν ρεεσ.", "ερστρερε όύστ τηε σκύμ σκύμ όνεν όφ.", "ερεδερρε όν ηεόν όνεδεν.", "έτσι"]
    rows = [(x, bytearray(x.encode("cp1251"))) for x in cyrillic] + [(x, bytearray(x.encode("cp1253"))) for x in greek]
    found = spark.createDataFrame(rows, "wanted string, data binary").select("wanted", subtitles.decode(F.col("data")).alias("text")).collect()
    assert [r["text"] for r in found] == [r["wanted"] for r in found]


def test_short_files_are_read_as_the_sure_ones_are_spelled(spark):
    """By its letters alone one of them is Cyrillic; the other files of the import tell that they are Greek words."""
    draw = random.Random(3)
    write = lambda words, n: " ".join(draw.choice(words) for _ in range(n)) + "."
    greek = ["εδρε", "ρερεδ", "ρεαεα", "ερε", "τηε", "θυεστιον", "ανσ", "δεν", "λαστ"]
    cyrillic = ["едно", "жизнь", "что", "этот", "погода", "холод", "вода", "дом"]
    rows = [("cp1253", write(greek, 200)) for _ in range(6)] + [("cp1251", write(cyrillic, 200)) for _ in range(6)] + [("cp1253", x) for x in ("εδρερε.", "ερεαεα.")] + [("cp1251", x) for x in ("едно.", "дом.")] + [("utf-8", "é"), ("cp1252", "naïve – 5 €")]
    frame = spark.createDataFrame([(i, text, bytearray(text.encode(name))) for i, (name, text) in enumerate(rows)], "id int, wanted string, data binary").repartition(3)
    assert [r for r in subtitles.decoded(frame).collect() if r["text"] != r["wanted"]] == []
    few = frame.where("id between 12 and 13")
    assert subtitles.decoded(few).columns == ["id", "wanted", "text"] and subtitles.decoded(few).where("text = wanted").count() == 1


def test_damaged_points(spark):
    rows = [(1, (1, "s", "f"), [1.0, 0.0]), (2, (3, "s", "f"), [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, (5, " ", "f"), [1.0, 0.0]), (6, (6, "s", None), [1.0, 0.0]), (7, (7, "s", "f"), None), (8, (8, "s", "f"), [1.0]), (9, (9, "s", "f"), [1.0, float("inf")]), (10, (10, "s", "f"), [0.0, 0.0]), (11, (11, "s", "f"), [1.0, 0.0]), (11, (11, "s", "f"), [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, payload struct<id: long, source: string, fingerprint: string>, vector array<double>")
    found = {r["id"]: r["fault"] for r in indexing.point_faults(frame, 2).collect()}
    assert found == {2: "other id in the payload", 4: "no payload", 5: "no source", 6: "no fingerprint", 7: "no vector", 8: "other dimensions", 9: "not finite", 10: "no length", 11: "repeated id"}
