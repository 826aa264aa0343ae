"""Character models against plain Python, scripts, and calibrated rejection."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from noema.llm import langid

TEXTS = {"a": ["ab ba abba", "bab", "cab ab"], "b": ["xyz zyx", "ab xy"]}


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(t, x) for x, texts in TEXTS.items() for t in texts], "text string, lang string")
    # with 32 bits no symbol that was never seen meets the hash of one that was
    return langid.estimate(langid.count_fourgrams(rows), langid.Settings(hash_bits=32))


def plain(texts, discount=0.75):
    """P(symbol | context of three) by the textbook's formulas; 0 is the boundary."""
    grams = Counter()
    for text in texts:
        past = (0, 0, 0)
        for c in [ord(x) if x != " " else 0 for x in text + " "]:
            grams[(*past, c)] += 1
            past = (*past[1:], c)
    tables = {4: grams}
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    totals, kinds = defaultdict(Counter), defaultdict(Counter)
    for order, table in tables.items():
        for g, n in table.items():
            totals[order][g[:-1]] += n
            kinds[order][g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / langid.SYMBOLS
        order, context = len(g), g[:-1]
        total = totals[order][context]
        if not total:
            return p(g[1:])
        return max(tables[order][g] - discount, 0) / total + discount * kinds[order][context] / total * p(g[1:])

    return p


def key(gram):
    return sum(c << 16 * (3 - i) for i, c in enumerate(gram))


def test_probabilities_are_those_of_the_formulas(model):
    draw = random.Random(1)
    grams = [tuple(draw.choice([0, *map(ord, "abcxyz")]) for _ in range(4)) for _ in range(300)]
    found = model.probabilities(np.array([key(g) for g in grams], dtype=np.uint64))
    for j, lang in enumerate(model.langs):
        p = plain(TEXTS[lang])
        assert found[:, j] == pytest.approx([p(g) for g in grams], rel=1e-5)


def test_probabilities_sum_to_one(model):
    for context in ("", "a", "ab", "bab", "zzz", "xy"):
        start = ([0, 0, 0] + [ord(c) for c in context])[-3:]
        keys = np.uint64(key([*start, 0])) + np.arange(langid.SYMBOLS, dtype=np.uint64)
        assert model.probabilities(keys).astype(float).sum(0) == pytest.approx([1, 1], abs=2e-3)


def test_scripts(spark):
    draw = random.Random(2)
    words = {
        "en": "the of and to in that was his with for", "ru": "и в не на я быть он с что это", "bg": "и на да се от за са по че ще",
        "el": "και το να του η της με που την από", "pl": "się nie że jest na do jak tak był może", "zh": "的 一 是 不了 在人 有我 他这 中大 来上 个国",
        "hi": "के में है की और से को का एक यह",
    }
    rows = [(i, " ".join(draw.choices(words[x].split(), k=12)), x) for i, x in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert sum(found[i]["lang_pred"] == x for i, _, x in rows) >= 0.98 * len(rows)
    assert sum(found[i]["rejected"] for i, _, _ in rows) <= 0.02 * len(rows)
    # another script, noise, and letters that stand alone
    odd = [(1, "שלום עולם מה שלומך היום"), (2, "xqzvk wqxzj kkqzx vvxqj"), (3, "µ"), (4, "ª º"), (5, "12 ... 7")]
    model = langid.fit(docs)
    rows = {r["doc_id"]: r for r in langid.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert rows[1]["rejected"] and rows[2]["rejected"]
    assert rows[3]["lang_pred"] != "und" and rows[4]["lang_pred"] != "und" and rows[5]["lang_pred"] == "und"


def test_bounds_are_set_on_texts_the_model_has_not_learned_from(spark):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choices("abcdefgh ", k=draw.choice([20, 200]))), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs)
    assert found.where("rejected").count() <= 8
    # by length, texts of letters in the wrong order are out
    model = langid.fit(docs)
    far = spark.createDataFrame([(i, "".join(draw.choices("ijklmnop ", k=60))) for i in range(50)], "doc_id long, text string")
    assert langid.score(far, model).where("rejected").count() == 50


def test_a_language_without_kept_texts_rejects_nothing(spark):
    rows = [(i, "abc def", "en") for i in range(50)] + [(1000, "qqq www", "xx")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    if "xx" in model.langs:
        out = model.rejected(np.array([model.langs.index("xx")]), np.array([50.0]), np.array([5]))
        assert not out[0]
