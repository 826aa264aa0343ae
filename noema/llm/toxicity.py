"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 7).

A text is cut into overlapping windows of words, all of which are scored. A word enters by two vectors: one of its own
(hashed) and the mean of those of its character n-grams (hashed), so inflected and unseen forms of a known stem are
recognised. A gated recurrent layer in each direction reads the window; attention weighs the states into one vector
for the output unit. A text's score is that of its highest window, calibrated on the training texts.

Trained in numpy on the driver on a bounded sample of labelled texts (sample_docs a class, of sample_bytes at most): first all windows carry
their text's label, then a toxic text teaches by its highest windows only. Labels, language, source and id are no
inputs. Words are lower-cased and lose ASCII punctuation.

Null, empty or wordless texts are one empty window, whose score is what the network gives it. Without labelled rows
of both classes every score is 0. Repeated rows are scored alike; null labels teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noema.llm import textkit as K
from noema.llm.staging import prepare

F32 = np.float32


@dataclass(frozen=True)
class Settings:
    window: int = 32
    stride: int = 24
    #: Training texts a class, at most about; the sample is by a hash of the id.
    sample_docs: int = 1000
    #: Bytes of a training text, at most: longer ones are scored, but not drawn.
    sample_bytes: int = 1 << 16
    word_rows: int = 1 << 13
    gram_rows: int = 1 << 14
    width: int = 8
    hidden: int = 8
    epochs: int = 5
    batch: int = 512
    rate: float = 0.01
    decision: float = 0.3
    seed: int = 5


def training_rows(doc_id: Column) -> Column:
    """True for the documents to learn labels from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


@dataclass
class Inputs:
    """Windows over a chunk of texts: distinct words and, by window and place, their numbers (0: none)."""

    words: np.ndarray  # table row of each distinct word
    grams: np.ndarray  # table rows of the grams of all distinct words
    gram_owner: np.ndarray
    ids: np.ndarray  # windows by places: number of the distinct word plus one, 0 for none
    doc: np.ndarray  # text of each window
    unique: int = field(default=0)


def windows(texts: pa.Array, settings: Settings) -> Iterator[tuple[int, int, Inputs]]:
    offsets, data = K.utf8(texts)
    for first, last in K.chunks(offsets):
        part = K.LOWER[data[offsets[first] : offsets[last]]]
        if len(part) > 1:
            high = np.flatnonzero((part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)) + 1
            part[high] += 0x20
        keep = ~K.PUNCTUATION[part]
        offs = np.concatenate([[0], np.cumsum(keep)])[offsets[first : last + 1] - offsets[first]]
        part = part[keep]
        starts, ends, rows = K.words(offs, part)
        bounds = K.row_bounds(rows, last - first)
        hashes = K.word_hashes(part, starts, ends)
        distinct, at, number = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends = starts[at], ends[at]
        # grams: the beginnings of 3, 4 and 5 bytes and all stretches of 4, each kind with hashes of its own
        spans = K.Spans(K._BYTE[part], K.BASES[1])
        size = ends - starts
        grams, owner = [], []
        for n in (3, 4, 5):
            own = np.flatnonzero(size >= n)
            grams.append(spans.of(starts[own], starts[own] + n) ^ np.uint64(n))
            owner.append(own)
        count = np.maximum(size - 3, 0)
        own = np.repeat(np.arange(len(size)), count)
        begin = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + starts[own]
        grams.append(spans.of(begin, begin + 4))
        owner.append(own)
        # windows: every stride words, the last one up to the end of the text
        n = np.diff(bounds)
        made = np.maximum(1, 1 + -(-(n - settings.window) // settings.stride))
        doc = np.repeat(np.arange(len(n)), made)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)) * settings.stride
        where = place[:, None] + np.arange(settings.window)
        inside = where < n[doc][:, None]
        ids = np.zeros(where.shape, dtype=np.int64)
        ids[inside] = number[(where + bounds[:-1][doc][:, None])[inside]] + 1
        yield first, last, Inputs(
            (distinct >> np.uint64(32)).astype(np.int64) % settings.word_rows,
            (np.concatenate(grams) >> np.uint64(32)).astype(np.int64) % settings.gram_rows, np.concatenate(owner), ids, doc, len(distinct),
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes of the network. Direction 1 reads the window from its end."""

    def __init__(self, settings: Settings):
        rng = np.random.Generator(np.random.PCG64(settings.seed))
        e, h = settings.width, settings.hidden
        self.h = h
        self.platt = (1.0, 0.0)

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(F32)

        self.p = {
            "word": draw(settings.word_rows, e, scale=0.1), "gram": draw(settings.gram_rows, e, scale=0.3),
            "wx": draw(2, 2 * e, 3 * h, scale=0.3), "bx": np.zeros((2, 1, 3 * h), F32), "u": draw(2, h, 3 * h, scale=0.3),
            "a": draw(2 * h, h, scale=0.3), "v": draw(h, scale=0.3), "w": draw(2 * h, scale=0.3), "b": np.zeros(1, F32),
        }

    def word_vectors(self, x: Inputs, drop: np.ndarray | None = None) -> np.ndarray:
        """Inputs of all distinct words, after a zero row for no word."""
        p = self.p
        e = p["word"].shape[1]
        out = np.zeros((x.unique + 1, 2 * e), F32)
        out[1:, :e] = p["word"][x.words]
        if drop is not None:
            out[1:, :e] *= drop
        n = np.bincount(x.gram_owner, minlength=x.unique)
        for j in range(e):
            out[1:, e + j] = np.bincount(x.gram_owner, weights=p["gram"][x.grams, j], minlength=x.unique) / np.maximum(n, 1)
        return out

    def forward(self, vectors: np.ndarray, ids: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Logits of windows. With a tape, what the backward pass needs is appended to it."""
        p, h = self.p, self.h
        n, t = ids.shape
        inputs = np.matmul(vectors[None], p["wx"]) + p["bx"]
        state = np.zeros((2, n, h), F32)
        states = np.zeros((t, 2, n, h), F32)
        mask = ids > 0
        for s in range(t):
            sides = (s, t - 1 - s)
            x = np.stack([inputs[d][ids[:, sides[d]]] for d in (0, 1)])
            rec = np.matmul(state, p["u"])
            gates = _sigmoid(x[:, :, : 2 * h] + rec[:, :, : 2 * h])
            z, r = gates[:, :, :h], gates[:, :, h:]
            new = np.tanh(x[:, :, 2 * h :] + r * rec[:, :, 2 * h :])
            on = np.stack([mask[:, sides[0]], mask[:, sides[1]]])[:, :, None]
            before = state
            state = np.where(on, new + z * (before - new), before)
            if tape is not None:
                tape.append((before, z, r, new, rec[:, :, 2 * h :], on))
            states[s, 0], states[t - 1 - s, 1] = state[0], state[1]
        both = states.transpose(2, 0, 1, 3).reshape(n, t, 2 * h)
        hid = np.tanh(both @ p["a"])
        score = np.where(mask, hid @ p["v"], F32(-1e9))
        score = score - score.max(1, keepdims=True)
        weight = np.exp(score)
        weight /= weight.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, both)
        if tape is not None:
            tape.append((both, hid, weight, pooled))
        return pooled @ p["w"] + p["b"][0]

    def gradients(self, x: Inputs, vectors: np.ndarray, ids: np.ndarray, slope: np.ndarray, tape: list, drop: np.ndarray) -> dict:
        """Gradients of all parameters from those of the logits."""
        p, h = self.p, self.h
        n, t = ids.shape
        both, hid, weight, pooled = tape.pop()
        g = {"w": pooled.T @ slope, "b": np.array([slope.sum()], F32)}
        d_pooled = slope[:, None] * p["w"]
        d_weight = np.einsum("nth,nh->nt", both, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_hid = d_score[:, :, None] * p["v"] * (1 - hid**2)
        g["v"] = np.einsum("nt,nth->h", d_score, hid)
        g["a"] = np.einsum("ntk,nth->kh", both, d_hid)
        d_both = weight[:, :, None] * d_pooled[:, None, :] + d_hid @ p["a"].T
        d_states = d_both.reshape(n, t, 2, h).transpose(1, 2, 0, 3)
        d_state = np.zeros((2, n, h), F32)
        g["u"] = np.zeros_like(p["u"])
        d_steps = np.zeros((2, t, n, 3 * h), F32)
        for s in range(t - 1, -1, -1):
            before, z, r, new, rec_n, on = tape.pop()
            d_state = d_state + np.stack([d_states[s, 0], d_states[t - 1 - s, 1]])
            moved = np.where(on, d_state, F32(0))
            d_new = moved * (1 - z) * (1 - new**2)
            d_z = moved * (before - new) * z * (1 - z)
            d_r = d_new * rec_n * r * (1 - r)
            d_rec = np.concatenate([d_z, d_r, d_new * r], 2)
            d_x = np.concatenate([d_z, d_r, d_new], 2)
            g["u"] += np.matmul(before.transpose(0, 2, 1), d_rec)
            d_state = np.where(on, moved * z, d_state) + np.matmul(d_rec, p["u"].transpose(0, 2, 1))
            d_steps[0, s], d_steps[1, t - 1 - s] = d_x[0], d_x[1]
        flat = ids.T.ravel()
        order = np.argsort(flat, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        d_inputs = np.zeros((2, len(vectors), 3 * h), F32)
        d_inputs[:, flat[order][at]] = np.add.reduceat(d_steps.reshape(2, t * n, 3 * h)[:, order], at, axis=1)
        d_inputs[:, 0] = 0
        g["bx"] = d_inputs.sum(1, keepdims=True)
        g["wx"] = np.matmul(vectors.T[None], d_inputs)
        d_vectors = np.matmul(d_inputs, p["wx"].transpose(0, 2, 1)).sum(0)[1:]
        e = p["word"].shape[1]
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        for j in range(e):
            g["word"][:, j] = np.bincount(x.words, weights=d_vectors[:, j] * drop[:, 0], minlength=len(p["word"]))
        count = np.maximum(np.bincount(x.gram_owner, minlength=x.unique), 1)
        share = d_vectors[:, e:] / count[:, None]
        for j in range(e):
            g["gram"][:, j] = np.bincount(x.grams, weights=share[x.gram_owner, j], minlength=len(p["gram"]))
        return g

    def logits(self, x: Inputs) -> np.ndarray:
        vectors = self.word_vectors(x)
        return np.concatenate([self.forward(vectors, x.ids[i : i + 4096]) for i in range(0, len(x.ids), 4096)])

    def scores(self, texts: pa.Array, settings: Settings) -> np.ndarray:
        out = [np.zeros(0)]
        for first, last, x in windows(texts, settings):
            best = np.full(last - first, -np.inf)
            np.maximum.at(best, x.doc, self.logits(x))
            out.append(best)
        return np.concatenate(out)

    def probabilities(self, texts: pa.Array, settings: Settings) -> np.ndarray:
        return _sigmoid(self.scores(texts, settings) * self.platt[0] + self.platt[1]).astype(float)


def _pick(x: Inputs, chosen: np.ndarray) -> Inputs:
    """The inputs of some windows, with only their words."""
    used = np.unique(x.ids[chosen])
    used = used[used > 0]
    number = np.zeros(x.unique + 1, dtype=np.int64)
    number[used] = np.arange(1, len(used) + 1)
    own = number[x.gram_owner + 1] > 0
    return Inputs(x.words[used - 1], x.grams[own], number[x.gram_owner[own] + 1] - 1, number[x.ids[chosen]], x.doc[chosen], len(used))


def evidence(rows: np.ndarray, docs: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Signed root of the likelihood ratio statistic of each table row's document frequencies in the two classes, less
    what chance gives to a row seen in a few texts only."""
    pairs = np.unique(rows * np.int64(len(labels)) + docs)
    rows, toxic = pairs // len(labels), labels[pairs % len(labels)] == 1
    a, b = np.bincount(rows[toxic], minlength=size).astype(float), np.bincount(rows[~toxic], minlength=size).astype(float)
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels != 1).sum()))
    expect1, expect0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    ratio = a * np.log(np.maximum(a, 1) / np.maximum(expect1, 1e-9)) + b * np.log(np.maximum(b, 1) / np.maximum(expect0, 1e-9))
    return np.sign(a - expect1) * np.maximum(np.sqrt(2 * np.maximum(ratio, 0)) - 2.5, 0)


def begin(net: Network, parts: list[tuple[int, Inputs]], labels: np.ndarray, settings: Settings) -> None:
    """Word and gram vectors start with what their frequencies say in their first component, so that few texts
    suffice to find the words that matter."""
    words, grams = [], []
    for first, x in parts:
        window, place = np.nonzero(x.ids)
        word, doc = x.ids[window, place] - 1, first + x.doc[window]
        words.append((x.words[word], doc))
        pairs = np.unique(word * np.int64(len(labels)) + doc)
        word, doc = pairs // len(labels), pairs % len(labels)
        order = np.argsort(x.gram_owner, kind="stable")
        edge = np.searchsorted(x.gram_owner[order], np.arange(x.unique + 1))
        n = np.diff(edge)[word]
        at = np.repeat(edge[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        grams.append((x.grams[order][at], np.repeat(doc, n)))
    for name, found, scale in (("word", words, 4.0), ("gram", grams, 2.0)):
        rows, docs = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        net.p[name][:, 0] = np.clip(evidence(rows, docs, labels, len(net.p[name])) / scale, -3, 3)


def train(texts: pa.Array, labels: np.ndarray, settings: Settings = Settings()) -> Network:
    """A network from whole texts and labels 0 or 1, by Adam."""
    net = Network(settings)
    rng = np.random.Generator(np.random.PCG64(settings.seed + 1))
    parts = [(first, x) for first, _, x in windows(texts, settings)]
    begin(net, parts, labels, settings)
    rate_pos = max(1e-3, float(labels.mean()))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(settings.epochs):
        jobs = []
        for k, (first, x) in enumerate(parts):
            own = labels[first + x.doc]
            if epoch < 1:
                chosen = np.arange(len(own))
            else:  # a toxic text's windows that score near its highest, and a clean text's hardest and some others
                logit = net.logits(x)
                top = np.full(x.doc.max() + 1, -np.inf)
                np.maximum.at(top, x.doc, logit)
                near = logit >= top[x.doc] - 1e-6
                chosen = np.flatnonzero(np.where(own == 1, near | (logit > 1), near | (rng.random(len(own)) < 0.5)))
            rng.shuffle(chosen)
            jobs += [(k, chosen[i : i + settings.batch]) for i in range(0, len(chosen), settings.batch)]
        rng.shuffle(jobs)
        for k, chosen in jobs:
            first, whole = parts[k]
            x = _pick(whole, chosen)
            y = labels[first + x.doc].astype(F32)
            drop = (rng.random((x.unique, 1)) > 0.3).astype(F32)
            vectors, tape = net.word_vectors(x, drop), []
            prob = _sigmoid(net.forward(vectors, x.ids, tape))
            weight = np.where(y == 1, 0.5 / rate_pos, 0.5 / (1 - rate_pos + 1e-3)).astype(F32)
            g = net.gradients(x, vectors, x.ids, ((prob - y) * weight / len(y)).astype(F32), tape, drop)
            step += 1
            rate = settings.rate * (1 - 0.8 * (epoch / settings.epochs))
            for name, value in g.items():
                m, v = moment[name]
                value = np.clip(value, -1, 1)
                m += 0.1 * (value - m)
                v += 0.01 * (value * value - v)
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(F32)
                if name in ("word", "gram"):
                    net.p[name] *= F32(1 - 2e-4)
    return net


def calibrate(net: Network, scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Platt's scaling of text scores, by Newton steps on weighted labels."""
    a, b = 1.0, 0.0
    target = np.where(labels == 1, 0.995, 0.005)
    for _ in range(50):
        p = _sigmoid(a * scores + b)
        g = np.array([np.sum(weights * (p - target) * scores) + 1e-3 * (a - 1), np.sum(weights * (p - target))])
        s = weights * p * (1 - p) + 1e-9
        hess = np.array([[np.sum(s * scores**2) + 1e-3, np.sum(s * scores)], [np.sum(s * scores), np.sum(s) + 1e-6]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    net.platt = (max(a, 1e-3), b)


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network | None:
    """A network from documents(doc_id, text) and labels(doc_id, toxic): a bounded hash sample of either class.

    The sample is drawn from the labels, so its ids (sample_docs a class, about) are broadcast and texts don't move.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = {c: min(1.0, settings.sample_docs / n) for c, n in counts.items()}
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, int(share[1] * 1e6) + 1).otherwise(int(share[0] * 1e6) + 1)
    bound = 4 * settings.sample_docs
    ids = F.broadcast(rows.where(picked).limit(bound))
    found = documents.select("doc_id", "text").where(F.octet_length("text") <= settings.sample_bytes).join(ids, "doc_id")
    sample = found.select("text", "toxic", F.xxhash64("doc_id", F.lit(1)).alias("order")).limit(bound).toArrow().sort_by("order")
    if len(sample.column("toxic").unique()) < 2:
        return None
    texts, labels = sample.column("text").combine_chunks(), sample.column("toxic").to_numpy().astype(np.int64)
    own = np.arange(len(labels)) % 5 != 0  # a fifth is kept from training, for the calibration
    net = train(texts.filter(pa.array(own)), labels[own], settings)
    if 0 < labels[~own].sum() < len(labels[~own]):
        held = labels[~own]
        weights = np.where(held == 1, 1 / share[1], 1 / share[0])
        calibrate(net, net.scores(texts.filter(pa.array(~own)), settings), held, weights / weights.mean())
    return net


def score(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    prepare(documents.sparkSession)
    net = fit(documents, labels.where(training_rows(F.col("doc_id"))), settings)
    sent = documents.sparkSession.sparkContext.broadcast(net)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows) if sent.value is None else sent.value.probabilities(batch.column("text"), settings)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= settings.decision).cast("int").alias("predicted")
    )
