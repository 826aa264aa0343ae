"""The language model's network against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from noema.llm import language_model as lm

SMALL = lm.Settings(head_classes=3, class_size=4, tail_classes=5, hidden=6, width=5, window=4, sample_docs=50)


def network():
    net = lm.Network(SMALL)
    rng = np.random.Generator(np.random.PCG64(5))
    for k, v in net.p.items():
        net.p[k] = v + (rng.standard_normal(v.shape) * 0.3).astype(np.float32)
    return net


def plain(net, ids):
    """Log probabilities of ids after each other, one multiplication at a time."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, SMALL.hidden
    sig = lambda x: 1 / (1 + np.exp(-x))
    state, last, out = np.zeros(h), net.begin, []
    for i in ids:
        x = p["e"][last] @ p["wx"] + p["bx"]
        rec = state @ p["u"]
        z, r = sig(x[:h] + rec[:h]), sig(x[h : 2 * h] + rec[h : 2 * h])
        new = np.tanh(x[2 * h :] + r * rec[2 * h :])
        state = (1 - z) * new + z * state
        top = np.exp(state @ p["wc"] + p["bc"])
        top /= top.sum()
        if i < SMALL.head:
            c = i // SMALL.class_size
            low = np.exp(state @ p["wi"][c] + p["bi"][c])
            out.append(np.log(top[c] * low[i % SMALL.class_size] / low.sum()))
        else:
            out.append(np.log(top[SMALL.head_classes + i - SMALL.head]))
        last = i
    return out


def test_scores_carry_the_state_over_windows():
    net = network()
    rng = np.random.Generator(np.random.PCG64(6))
    texts = [rng.integers(0, SMALL.head + SMALL.tail_classes, n) for n in (1, 3, 4, 9, 30)]
    found = net.score(np.concatenate(texts), np.concatenate([[0], np.cumsum(list(map(len, texts)))]))
    assert found == pytest.approx([sum(plain(net, t)) for t in texts], rel=1e-4)


def test_gradients_lower_the_loss_and_match_differences():
    net = network()
    ids = np.array([0, 5, 13, 2, 7, 11, 0, 16, 3, 3, 9, 1])
    bounds = np.array([0, 5, 12])
    taken = {}

    class Spy(lm.Adam):
        def step(self, p, g, rate):
            taken.update({k: v.copy() for k, v in g.items()})

    # one window over everything, so that truncation cuts nothing
    net.s = lm.replace(SMALL, window=20)
    net.learn(ids, bounds, 1, 0.01, Spy(net.p))
    loss = lambda: -net.score(ids, bounds).sum() / len(ids)
    for k in ("e", "u", "wc", "bi", "wx"):
        at = np.unravel_index(np.abs(taken[k]).argmax(), taken[k].shape)
        was, eps = net.p[k][at], 1e-2
        net.p[k][at] = was + eps
        up = loss()
        net.p[k][at] = was - eps
        down = loss()
        net.p[k][at] = was
        assert taken[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.03, abs=1e-4)


def test_probabilities_of_all_tokens_sum_to_one(spark):
    """After any beginning: all tokens of the training texts, and one place for an unseen token in each tail class."""
    texts = [" ".join(f"w{(i * k) % 23}{'abcde'[k % 5]}" for k in range(12)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    training = docs.where(lm.training_rows(docs.doc_id))
    counts = lm.count_tokens(training, SMALL).cache()
    model = lm.fit(training, counts, SMALL)
    known = {r["token"]: (r["class"], r["n"]) for r in counts.collect()}
    hashes = np.array(list(known), dtype=np.int64).view(np.uint64)
    classes = np.array([c for c, _ in known.values()], dtype=np.int32)
    n = np.array([n for _, n in known.values()])
    ids = model.ids(hashes, classes)
    for beginning in ([], [0, 1], list(ids[:7])):
        start = np.array(beginning, dtype=np.int64)
        before = model.net.score(start, np.array([0, len(start)]))[0]
        rows = np.concatenate([np.append(start, i) for i in ids])
        after = model.net.score(rows, np.arange(len(ids) + 1) * (len(start) + 1)) - before
        tail = ids >= SMALL.head
        share = np.where(tail, np.log10(n + 1.0) - model.tail_log[classes], 0.0) * np.log(10)
        total = np.exp(after + share).sum()
        # the places for unseen tokens
        for c in range(SMALL.tail_classes):
            p = model.net.score(np.append(start, SMALL.head + c), np.array([0, len(start) + 1]))[0] - before
            total += np.exp(p - model.tail_log[c] * np.log(10))
        assert total == pytest.approx(1, abs=1e-3)


def test_frequent_tokens(spark):
    rows = spark.createDataFrame([(i, 0, 1 + (i < 3) * 10 * i + (i == 5)) for i in range(100)], "token long, class int, n long")
    assert lm.frequent(rows, 10)["token"].tolist() == [2, 1, 5]
    assert len(lm.frequent(rows, 1000)) == 100


def test_tokens():
    first, last, hashes, classes, bounds = next(lm.tokens(pa.array(["A b a", None, ""]), 7))
    assert (first, last, bounds.tolist()) == (0, 3, [0, 4, 5, 6])
    assert hashes[0] == hashes[2] != hashes[1] and hashes[3] == hashes[4] == hashes[5] == lm.END
