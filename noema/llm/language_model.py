"""Gated recurrent language model with a class-factored softmax (operator 4).

Tokens are lower-cased words and one end token a text. Spark counts the tokens of all training texts; the counts
give the unigram base and parts of the model. The most frequent tokens (the head) are in classes of equal size by
rank; all others are in tail classes by their last letters. A token's probability is that of its class given the
state, times that of the token in its class: a second softmax on the state for the head, smoothed counts of the whole
corpus for the tail, with one place for an unseen token in each tail class. The probabilities of all tokens and
these places add up to one.

The network is trained in numpy by truncated backpropagation; the state goes on from window to window, in training as
in scoring, and is zero where a text begins. It starts on the driver with a bounded hash sample of training texts and
then learns from all of them: each text belongs to one round, in which every task goes on from the common network with
the texts of its own partition, and the networks of all tasks are averaged, weighted by their tokens. Scoring reads whole texts
of any length; a task scores many texts in step, so that few long ones don't leave it with small matrices.

The start's sample is of bounded number and size; longer texts enter in the rounds. Counts of the most frequent tokens are broadcast (known_tokens of them at most); those of rarer ones are joined.
A null or empty text is its end token. Repeated rows are scored alike. Columns other than doc_id and text are
ignored. Without training texts all probabilities are those of an untrained network.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noema.llm import textkit as K
from noema.llm.staging import Staging

F32 = np.float32
#: Stands for the end token among word hashes.
END = np.uint64(0x0123456789ABCDEF)


@dataclass(frozen=True)
class Settings:
    head_classes: int = 32
    class_size: int = 32
    tail_classes: int = 32
    hidden: int = 16
    width: int = 16
    window: int = 32
    #: Start of training: texts of the sample (about) and bytes of each at most, parallel streams, passes, step size.
    sample_docs: int = 800
    sample_bytes: int = 1 << 15
    streams: int = 64
    epochs: int = 3
    rate: float = 0.01
    #: Training on all texts: rounds, each with its share of them, parallel streams in a task, step size.
    rounds: int = 3
    task_streams: int = 1024
    task_rate: float = 0.01
    known_tokens: int = 1 << 17
    #: Text bytes that a task scores, or learns from, in step.
    group_bytes: int = 24_000_000
    seed: int = 3

    @property
    def head(self) -> int:
        return self.head_classes * self.class_size


def training_rows(doc_id: Column) -> Column:
    """True for the documents to learn from: crc32 of the id as text, modulo 7, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2


def tokens(texts: pa.Array, tail_classes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, token hashes, tail classes, bounds by row); every row ends in the end token."""
    offsets, data = K.utf8(texts)
    for first, last in K.chunks(offsets):
        part = K.LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, rows = K.words(offsets[first : last + 1] - offsets[first], part)
        bounds = K.row_bounds(rows, last - first)
        n = len(bounds) - 1
        place = np.arange(len(starts)) + rows
        hashes = np.full(len(starts) + n, END, dtype=np.uint64)
        hashes[place] = K.word_hashes(part, starts, ends)
        classes = np.zeros(len(hashes), dtype=np.int32)
        if len(starts):
            last_byte, before = part[ends - 1].astype(np.int64), part[np.maximum(ends - 2, starts)].astype(np.int64)
            third = part[np.maximum(ends - 3, starts)].astype(np.int64)
            classes[place] = (last_byte * 7 + before * 31 + third * 3) % tail_classes
        yield first, last, hashes, classes, bounds + np.arange(n + 1)


def count_tokens(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(token, class, n) over all texts; tasks add up their own counts chunk by chunk first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged():
            token = np.concatenate([x[0] for x in held])
            token, at, number = np.unique(token, return_index=True, return_inverse=True)
            kind = np.concatenate([x[1] for x in held])[at]
            n = np.bincount(number, weights=np.concatenate([x[2] for x in held])).astype(np.int64)
            return token, kind, n

        def out():
            token, kind, n = merged()
            for i in range(0, len(token), 1 << 16):
                own = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(token[own].view(np.int64)), pa.array(kind[own]), pa.array(n[own])], ["token", "class", "n"])

        for batch in batches:
            for _, _, hashes, classes, _ in tokens(batch.column("text"), settings.tail_classes):
                token, at, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((token, classes[at], n))
                size += len(token)
                if size > 1 << 21:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    parts = documents.select("text").mapInArrow(run, "token long, class int, n long")
    return parts.groupBy("token").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials of logits, and their sums by row; states lie in [-1, 1], so logits beyond the bound don't occur in
    practice."""
    e = np.exp(np.minimum(x, F32(60)))
    return e, e @ np.ones(e.shape[1], F32)


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        self.turn = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.turn += 1
        for k, value in g.items():
            m, v = self.moment[k]
            value = np.clip(value, -0.5, 0.5)
            m += 0.1 * (value - m)
            v += 0.01 * (value * value - v)
            p[k] -= (rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.99**self.turn)) + 1e-8)).astype(F32)


class Network:
    """Input ids: head tokens by rank, then tail classes, then the beginning of a text."""

    def __init__(self, settings: Settings):
        self.s = settings
        rng = np.random.Generator(np.random.PCG64(settings.seed))
        h, e, n = settings.hidden, settings.width, settings.head + settings.tail_classes

        def draw(*shape, scale=0.2):
            return (rng.standard_normal(shape) * scale).astype(F32)

        classes = settings.head_classes + settings.tail_classes
        self.p = {
            "e": draw(n + 1, e), "wx": draw(e, 3 * h), "bx": np.zeros(3 * h, F32), "u": draw(h, 3 * h),
            "wc": draw(h, classes), "bc": np.zeros(classes, F32),
            "wi": draw(settings.head_classes, h, settings.class_size), "bi": np.zeros((settings.head_classes, settings.class_size), F32),
        }

    @property
    def begin(self) -> int:
        return self.s.head + self.s.tail_classes

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.s.head, ids // self.s.class_size, self.s.head_classes + ids - self.s.head)

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        h = self.s.hidden
        rec = state @ self.p["u"]
        gates = _sigmoid(x[:, : 2 * h] + rec[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * rec[:, 2 * h :])
        return new + z * (state - new), z, r, new, rec[:, 2 * h :]

    def _by_class(self, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(class, places) of the head's classes that occur."""
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(self.s.head_classes + 1))
        for c in np.flatnonzero(np.diff(edges)):
            yield c, order[edges[c] : edges[c + 1]]

    def log_probabilities(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of the class's probability, and for the head of the token's in its class."""
        kind = self.classes_of(ids)
        top = states @ self.p["wc"] + self.p["bc"]
        out = np.minimum(top[np.arange(len(ids)), kind], F32(60)).astype(np.float64) - np.log(_exp(top)[1])
        for c, own in self._by_class(kind):
            low = states[own] @ self.p["wi"][c] + self.p["bi"][c]
            out[own] += np.minimum(low[np.arange(len(own)), ids[own] % self.s.class_size], F32(60)) - np.log(_exp(low)[1])
        return out

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sum of natural log probabilities of each text ids[bounds[i]:bounds[i + 1]], its state carried all along."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        start, size = bounds[:-1][order], size[order]
        inputs = self.p["e"] @ self.p["wx"] + self.p["bx"]
        state = np.zeros((len(size), self.s.hidden), F32)
        total = np.zeros(len(size))
        last = np.full(len(size), self.begin)
        w = self.s.window
        # texts that have a token at each place
        alive = len(size) - np.cumsum(np.bincount(size, minlength=int(size[0]) + w + 1)) if len(size) else size
        every = np.arange(len(size))
        for base in range(0, int(size[0]) if len(size) else 0, w):
            states, targets, owners = [], [], []
            for t in range(base, base + w):
                n = int(alive[t])
                if not n:
                    break
                state[:n] = self.step(inputs[last[:n]], state[:n])[0]
                last[:n] = ids[start[:n] + t]
                states.append(state[:n].copy())
                targets.append(last[:n].copy())
                owners.append(every[:n])
            owner, states, targets = np.concatenate(owners), np.concatenate(states), np.concatenate(targets)
            for i in range(0, len(owner), 1 << 15):
                part = slice(i, i + (1 << 15))
                total += np.bincount(owner[part], weights=self.log_probabilities(states[part], targets[part]), minlength=len(total))
        out = np.zeros(len(size))
        out[order] = total
        return out

    def train(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Some passes over texts, with a falling step size."""
        s, adam = self.s, Adam(self.p)
        for epoch in range(s.epochs if len(ids) else 0):
            self.learn(ids, bounds, s.streams, s.rate * (1 - 0.7 * epoch / s.epochs), adam)

    def learn(self, ids: np.ndarray, bounds: np.ndarray, streams: int, rate: float, adam: Adam) -> None:
        """One pass of truncated backpropagation over streams of texts."""
        s, h = self.s, self.s.hidden
        fresh = np.zeros(len(ids), dtype=bool)
        fresh[bounds[:-1]] = True
        before = np.where(fresh, self.begin, np.roll(ids, 1))
        length = max(s.window, -(-len(ids) // streams))
        take = np.arange(streams)[:, None] * length + np.arange(length)
        real = take < len(ids)
        take = np.minimum(take, len(ids) - 1)
        ids, before, fresh = ids[take], before[take], fresh[take]
        state = np.zeros((streams, h), F32)
        for base in range(0, length, s.window):
            part = slice(base, min(base + s.window, length))
            x_ids, y, new_text, valid = before[:, part], ids[:, part], fresh[:, part], real[:, part]
            steps = x_ids.shape[1]
            x_flat = x_ids.T.ravel()
            inputs = ((self.p["e"] @ self.p["wx"] + self.p["bx"])[x_flat]).reshape(steps, streams, 3 * h)
            tape, states = [], np.zeros((steps, streams, h), F32)
            for t in range(steps):
                state = np.where(new_text[:, t : t + 1], F32(0), state)
                was = state
                state, *parts = self.step(inputs[t], state)
                tape.append((was, *parts))
                states[t] = state
            flat, target, on = states.reshape(-1, h), y.T.ravel(), valid.T.ravel()
            kind = self.classes_of(target)
            weight = (on / max(1, int(on.sum()))).astype(F32)
            d_top, total = _exp(flat @ self.p["wc"] + self.p["bc"])
            d_top *= (weight / total)[:, None]
            d_top[np.arange(len(kind)), kind] -= weight
            g = {k: np.zeros_like(v) for k, v in self.p.items()}
            g["wc"], g["bc"] = flat.T @ d_top, d_top.sum(0)
            d_flat = d_top @ self.p["wc"].T
            for c, own in self._by_class(kind):
                d_low, total = _exp(flat[own] @ self.p["wi"][c] + self.p["bi"][c])
                d_low *= (weight[own] / total)[:, None]
                d_low[np.arange(len(own)), target[own] % s.class_size] -= weight[own]
                g["wi"][c], g["bi"][c] = flat[own].T @ d_low, d_low.sum(0)
                d_flat[own] += d_low @ self.p["wi"][c].T
            d_states = d_flat.reshape(steps, streams, h)
            d_state = np.zeros((streams, h), F32)
            d_inputs = np.empty((steps, streams, 3 * h), F32)
            for t in range(steps - 1, -1, -1):
                was, z, r, new, rec_n = tape[t]
                d_state = d_state + d_states[t]
                d_new = d_state * (1 - z) * (1 - new**2)
                d_z = d_state * (was - new) * z * (1 - z)
                d_r = d_new * rec_n * r * (1 - r)
                d_x = d_inputs[t]
                d_x[:, :h], d_x[:, h : 2 * h], d_x[:, 2 * h :] = d_z, d_r, d_new
                d_rec = d_x.copy()
                d_rec[:, 2 * h :] *= r
                g["u"] += was.T @ d_rec
                d_state = (d_state * z + d_rec @ self.p["u"].T) * ~new_text[:, t : t + 1]
            rows = d_inputs.reshape(-1, 3 * h)
            g["bx"], g["wx"] = rows.sum(0), self.p["e"][x_flat].T @ rows
            d_e = rows @ self.p["wx"].T
            at = (x_flat[:, None] * s.width + np.arange(s.width)).ravel()
            g["e"] = np.bincount(at, weights=d_e.ravel(), minlength=g["e"].size).reshape(g["e"].shape).astype(F32)
            adam.step(self.p, g, rate)


@dataclass
class Model:
    settings: Settings
    total: int  # N
    distinct: int  # V
    head_tokens: np.ndarray  # sorted hashes of the head
    head_ids: np.ndarray
    known: np.ndarray  # sorted hashes of the tokens whose counts are held here
    known_log: np.ndarray  # log10(count + 1)
    tail_log: np.ndarray  # by tail class: log10(N + V + 1) of its tokens
    net: Network | None = None

    def ids(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = self.settings.head + classes.astype(np.int64)
        if len(self.head_tokens):
            at = np.minimum(np.searchsorted(self.head_tokens, hashes), len(self.head_tokens) - 1)
            own = self.head_tokens[at] == hashes
            out[own] = self.head_ids[at[own]]
        return out


def frequent(counts: DataFrame, most: int):
    """token, class and n of the tokens above a count that at most so many tokens reach, most frequent first. Sizes are
    tallied first (some hundred rows), so that only these tokens reach the driver, and none is sorted in one task."""
    size = F.floor(F.log2("n") * 16)
    least, held = None, 0
    for row in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("tokens")).collect(), key=lambda r: -r["size"]):
        held += row["tokens"]
        if held > most:
            break
        least = row["size"]
    top = counts.where(size >= F.lit(least)) if least is not None else counts.limit(0)
    return top.select("token", "class", "n").toPandas().sort_values(["n", "token"], ascending=[False, True], ignore_index=True)


def fit(training: DataFrame, counts: DataFrame, settings: Settings = Settings()) -> Model:
    """training(doc_id, text) and the counts of its tokens."""
    s = settings
    sums = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    top = frequent(counts, s.known_tokens)
    token, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    head = token[: s.head]
    tail_n, tail_v = np.zeros(s.tail_classes), np.zeros(s.tail_classes)
    tail_n[sums["class"]], tail_v[sums["class"]] = sums["n"], sums["v"]
    np.subtract.at(tail_n, top["class"].to_numpy()[: s.head], n[: s.head])
    np.subtract.at(tail_v, top["class"].to_numpy()[: s.head], 1)
    order, by_hash = np.argsort(token), np.argsort(head)
    model = Model(
        s, int(sums["n"].sum()), int(sums["v"].sum()), head[by_hash], by_hash, token[order],
        np.log10(n[order] + 1.0), np.log10(tail_n + tail_v + 1.0),
    )
    model.net = Network(s)
    rows = max(1, training.count())
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, s.sample_docs / rows) * 1_000_000) + 1
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= s.sample_bytes  # longer ones are learned from in the rounds
    sample = training.where(picked & short).select(F.xxhash64("doc_id", F.lit(1)).alias("order"), "text").limit(2 * s.sample_docs).toArrow().sort_by("order")
    ids, sizes = [np.zeros(0, dtype=np.int64)], []
    for _, _, hashes, classes, bounds in tokens(sample.column("text").combine_chunks(), s.tail_classes) if len(sample) else ():
        ids.append(model.ids(hashes, classes))
        sizes += np.diff(bounds).tolist()
    model.net.train(np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    for turn in range(s.rounds):
        own = training.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(s.rounds)) == turn)
        average(own, model, s.task_rate * (1 - 0.7 * turn / s.rounds))
    return model


def average(training: DataFrame, model: Model, rate: float) -> int:
    """Replace the network by the mean of those that tasks make of it with all texts of their partitions; the number
    of tokens learned from."""
    s, net = model.settings, model.net
    none = np.zeros(0)
    context = training.sparkSession.sparkContext
    sent = context.broadcast(replace(model, known=none, known_log=none))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        own = copy.deepcopy(m.net)
        adam, total = Adam(own.p), 0

        def learn(held: list[pa.RecordBatch]) -> int:
            ids, sizes = [], []
            for batch in held:
                for _, _, hashes, classes, bounds in tokens(batch.column("text"), s.tail_classes):
                    ids.append(m.ids(hashes, classes))
                    sizes += np.diff(bounds).tolist()
            own.learn(np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), s.task_streams, rate, adam)
            return sum(sizes)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= s.group_bytes:
                total += learn(held)
                held, size = [], 0
        if held:
            total += learn(held)
        if total:
            flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * total), pa.array(np.full(len(flat), total, dtype=np.int64))], ["at", "x", "n"]
            )

    made = training.select("text").mapInArrow(run, "at int, x double, n long")
    sums = made.groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas().sort_values("at")  # a row a parameter
    sent.destroy()
    if not len(sums):
        return 0
    flat, at = (sums["x"] / sums["n"]).to_numpy(), 0
    for k in sorted(net.p):
        net.p[k] = flat[at : at + net.p[k].size].reshape(net.p[k].shape).astype(F32)
        at += net.p[k].size
    return int(sums["n"].iloc[0])


def score(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = documents.sparkSession
    stage = Staging(spark, "lm")
    documents = documents.select("doc_id", "text")
    training = documents.where(training_rows(F.col("doc_id")))
    counts = stage.save(count_tokens(training, settings), "counts")
    model = fit(training, counts, settings)
    sent = spark.sparkContext.broadcast(model)  # head, known tokens and network: of fixed size

    def group(batch_list: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        ids, sizes, rest = [np.zeros(0, dtype=np.int64)], [], []
        for batch in batch_list:
            known, sums, tails, tail_terms = [], [], [], []
            rare_tokens, rare_n, rare_sizes = [], [], []
            for first, last, hashes, classes, bounds in tokens(batch.column("text"), m.settings.tail_classes):
                n = last - first
                row = np.repeat(np.arange(n), np.diff(bounds))
                own = m.ids(hashes, classes)
                ids.append(own)
                sizes += np.diff(bounds).tolist()
                at = np.minimum(np.searchsorted(m.known, hashes), max(len(m.known) - 1, 0))
                found = m.known[at] == hashes if len(m.known) else np.zeros(len(hashes), dtype=bool)
                value = np.where(found, m.known_log[at] if len(m.known) else 0.0, 0.0)
                tail = own >= m.settings.head
                known.append(np.bincount(row[found], minlength=n))
                sums.append(np.bincount(row, weights=value, minlength=n))
                tails.append(np.bincount(row[tail], weights=value[tail], minlength=n))
                tail_terms.append(np.bincount(row[tail], weights=m.tail_log[classes[tail]], minlength=n))
                # tokens that are not held here, once a text with their number
                r, token = row[~found], hashes[~found]
                order = np.lexsort((token, r))
                r, token = r[order], token[order]
                new = np.ones(len(r), dtype=bool)
                new[1:] = (r[1:] != r[:-1]) | (token[1:] != token[:-1])
                edge = np.flatnonzero(new)
                rare_tokens.append(token[edge].view(np.int64))
                rare_n.append(np.diff(np.append(edge, len(r))).astype(np.int32))
                rare_sizes.append(np.bincount(r[edge], minlength=n))
            if not known:
                continue
            offs = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(rare_sizes))]).astype(np.int32))
            rest.append((batch.column("doc_id"), *(np.concatenate(x) for x in (known, sums, tails, tail_terms)), offs, np.concatenate(rare_tokens), np.concatenate(rare_n)))
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        found = m.net.score(np.concatenate(ids), bounds) / np.log(10)
        at = 0
        for doc_id, known, sums, tails, terms, offs, rare, rare_n in rest:
            own = slice(at, at + len(doc_id))
            at += len(doc_id)
            yield pa.RecordBatch.from_arrays(
                [
                    doc_id, pa.array(np.array(sizes[own], dtype=np.int64)), pa.array(known.astype(np.int64)), pa.array(sums),
                    pa.array(found[own] + tails - terms), pa.ListArray.from_arrays(offs, pa.array(rare)), pa.ListArray.from_arrays(offs, pa.array(rare_n)),
                ],
                ["doc_id", "n_tokens", "known", "sums", "score", "rare", "rare_n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= settings.group_bytes:
                yield from group(held)
                held, size = [], 0
        if held:
            yield from group(held)

    made = documents.mapInArrow(
        run, "doc_id long, n_tokens long, known long, sums double, score double, rare array<long>, rare_n array<int>"
    ).withColumn("row", F.monotonically_increasing_id())
    scored = stage.save(made, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.rare_n").alias("times"))
    more = (
        rare.join(counts.select("token", "n"), "token").groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more"), F.sum("times").alias("more_known"))
        .withColumnRenamed("row", "_row")
    )
    norm = float(np.log10(model.total + model.distinct + 1))
    extra = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "rare_n").join(more, F.col("row") == F.col("_row"), "left").select(
        "doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("sums") + extra - F.col("n_tokens") * norm).alias("base_score"), (F.col("score") + extra).alias("score"),
    )
