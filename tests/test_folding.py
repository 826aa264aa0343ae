"""Forms of letters beyond ASCII, and the checks of tags that rest on them."""

import re
import unicodedata

from pyspark.sql import functions as F

from noema.functions import text as X
from noema.operators import knowledge

TEXTS = ["Straße  STRASSE", "ﬁn Ⅳ ｆｕｌｌ", "İstanbul", "ΣΊΣΥΦΟΣ", "Crème Brûlée", "Ça va", "ö ö", "Żółć ẞ", "plain TEXT", "", None, "한글 각", "K①²"]


def _got(spark, form):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    return [r["x"] for r in rows.select("i", form(F.col("t")).alias("x")).orderBy("i").collect()]


def _flat(text):
    return re.sub(r"\s+", " ", text).strip()


def test_identity(spark):
    assert _got(spark, X.identity_key) == [None if t is None else _flat(unicodedata.normalize("NFKC", t).casefold()) for t in TEXTS]


def test_search(spark):
    def form(t):
        return _flat("".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c)))

    assert _got(spark, X.search_form) == [None if t is None else form(t) for t in TEXTS]


def test_client(spark):
    got = _got(spark, X.client_form)
    assert got[4:6] == ["creme brulee", "ca va"] and got[6] == "o o" and got[9:11] == ["", None]


def test_tags(spark):
    lists = [["＃Ａ", "#a", " ﬁn ", None, ""], ["a#b", "c"], ["x" * 41], [], None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, t array<string>")
    got = rows.select("i", X.tag_names(F.col("t")).alias("n"), X.tag_fault(F.col("t")).alias("f"), X.clean_tags(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["n"] for r in got] == [["a", "fin"], ["a#b", "c"], ["x" * 41], [], None]
    assert [r["f"] for r in got] == [None, "inner #", "too long", None, None]
    assert [r["c"] for r in got] == [["a", "fin"], ["c"], [], [], None]


def test_searches_find_folded_words(spark):
    items = spark.createDataFrame([("fact", 1, "Crème brûlée", ["Été"]), ("fact", 2, "Plain", ["ete"]), ("fact", 3, "Vieil ami, crème", None)], "kind string, id long, label string, tags array<string>")
    assert [(r["id"], r["tier"]) for r in knowledge.text_search(items, "CRÈME", 9).collect()] == [(1, 1), (3, 2)]
    assert [(r["id"], r["tier"]) for r in knowledge.text_search(items, "bru cre", 9).collect()] == [(1, 4)]
    assert [(r["id"], r["score"]) for r in knowledge.client_search(items, "été", 9).collect()] == [(1, 48), (2, 48)]
