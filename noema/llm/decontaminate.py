"""Benchmark decontamination by CGK embeddings and bit sampling (operator 3).

A benchmark item occurs in a text if some window of words is within the item's edit budget (word insertions,
deletions, replacements). Words are lowered and lose ASCII punctuation. The random walk of Chakraborty, Goldenberg
and Koucky reads a word sequence into a longer one: in each step it writes the current word and moves on or not by
a random bit of step and word. Sequences at small edit distance get embeddings at small Hamming distance, so few
sampled coordinates agree with fair probability. Each repetition walks with its own bits and looks the sampled
words up among the items' own; the number of repetitions follows from the target recall. Every candidate is
confirmed by the exact edit distance of the item within its place (bit-parallel, any length).

Windows start at every word, but those that the q-gram lemma rules out (each edit spoils at most q q-grams of an
item, so a window within budget keeps the others) are not embedded; the lemma loses nothing. Short items are filtered by
shorter grams, so that every budget leaves at least one gram whole.

The benchmark is a stated query set: it is read in blocks of at most block_items items, each broadcast, applied in a pass
over the documents whose results are a table, and freed before the next one. Null or empty texts and items match nothing;
items of any length from one word count, and of under five words only exact occurrences are within budget. Repeated
items each report; repeated documents too. Extra columns of either table are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm import textkit as K
from noema.llm.staging import Staging, fresh


@dataclass(frozen=True)
class Settings:
    #: Edits allowed, as a share of the item's words.
    ratio: float = 0.2
    #: Words of a gram, where items are long enough.
    q: int = 3
    #: Sampled coordinates a repetition, the least probability that one agrees within budget, and the recall aimed at.
    sampled: int = 2
    agreement: float = 0.4
    recall: float = 0.999
    block_items: int = 20_000
    block_chars: int = 16_000_000

    def budget(self, n: int) -> int:
        """Edits allowed in an item of n words."""
        return math.floor(n * self.ratio)

    def gram(self, n: int) -> int:
        """The longest grams, up to q words, of which the budget leaves an item of n words one whole."""
        return next(q for q in range(min(self.q, n), 0, -1) if q == 1 or n - q + 1 - q * self.budget(n) >= 1)

    @property
    def repetitions(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.agreement**self.sampled))


def normal_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, bounds by row) of lowered words without ASCII punctuation."""
    offsets, data = K.utf8(texts)
    for first, last in K.chunks(offsets):
        part = K.LOWER[data[offsets[first] : offsets[last]]]
        if len(part) > 1:  # upper-case letters of Latin-1
            high = np.flatnonzero((part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)) + 1
            part[high] += 0x20
        keep = ~K.PUNCTUATION[part]
        offs = np.concatenate([[0], np.cumsum(keep)])[offsets[first : last + 1] - offsets[first]]
        part = part[keep]
        starts, ends, rows = K.words(offs, part)
        yield first, last, K.word_hashes(part, starts, ends), K.row_bounds(rows, last - first)


def _qgrams(words: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(words) - q + 1)
    at = np.arange(n)
    return K.Spans(words, K.BASES[1]).of(at, at + q)


def walk(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, salt: int, wanted: list[int]) -> list[np.ndarray]:
    """The wanted coordinates of the CGK embeddings of all windows words[start:end]; zeros past the end. words ends in
    one zero more than the windows reach."""
    at, out = starts.copy(), {}
    for step in range(steps):
        inside = at < ends
        symbol = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        if step in wanted:
            out[step] = symbol
        key = np.uint64((0x9E3779B97F4A7C15 * (salt * 4099 + step + 1)) & (1 << 64) - 1)
        at = at + ((K.mix(symbol ^ key) & np.uint64(1)) != 0)
    return [out[step] for step in wanted]


class Grams:
    """The grams of q words that a block's items have, behind a coarse table of bits."""

    def __init__(self, lists: list[np.ndarray], q: int):
        self.q = q
        self.grams = np.unique(np.concatenate([_qgrams(w, q) for w in lists]))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which places begin a gram of some item."""
        grams = _qgrams(words, self.q)
        hit = self.filter[(grams >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(hit)
        hit[at] = self.grams[np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)] == grams[at]
        for back in range(1, self.q):  # a gram over the end of a row is none
            cut = bounds[1:-1] - back
            hit[cut[(cut >= 0) & (cut < len(hit))]] = False
        return hit


class Items:
    """A block of items, with one table of sampled embeddings for each length class and repetition."""

    def __init__(self, ids: list[int], words: list[np.ndarray], settings: Settings):
        self.settings = settings
        self.ids, self.words, self.lists = ids, words, [w.tolist() for w in words]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        gram = np.array([settings.gram(int(n)) for n in sizes])
        self.grams = [Grams([words[i] for i in np.flatnonzero(gram == q)], int(q)) for q in np.unique(gram)]
        rng = np.random.Generator(np.random.PCG64(7))
        self.classes = []
        for c, q in sorted({(int(n).bit_length(), int(g)) for n, g in zip(sizes, gram)}):
            own = np.flatnonzero([int(n).bit_length() == c and g == q for n, g in zip(sizes, gram)])
            least, most = int(sizes[own].min()), int(sizes[own].max())
            need = min(int(n) - q + 1 - q * settings.budget(int(n)) for n in set(sizes[own].tolist()))
            flat = np.concatenate([*(words[i] for i in own), np.zeros(1, dtype=np.uint64)])
            ends = np.cumsum(sizes[own])
            starts = ends - sizes[own]
            tables = []
            for r in range(settings.repetitions if settings.budget(most) else 1):
                # without a budget the window is the item, whose first word is at the first coordinate
                among = max(settings.sampled, least + least // 2) if settings.budget(most) else 1
                wanted = sorted(rng.choice(among, size=min(settings.sampled, among), replace=False).tolist())
                salt = c * 1009 + r
                key = self._key(walk(flat, starts, ends, wanted[-1] + 1, salt, wanted))
                order = np.argsort(key, kind="stable")
                tables.append((salt, wanted, key[order], own[order]))
            self.classes.append((most + settings.budget(most), max(1, need), q, tables))

    @staticmethod
    def _key(symbols: list[np.ndarray]) -> np.ndarray:
        key = np.zeros(len(symbols[0]), dtype=np.uint64)
        for s in symbols:
            key = K.mix(key * np.uint64(K.BASES[0]) + s)
        return key

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sorted distinct (row, item, start) of the windows whose sampled coordinates agree with an item's."""
        none = np.zeros((0, 3), dtype=np.int64)
        if not len(words):
            return none
        hit = {g.q: g.hits(words, bounds) for g in self.grams}
        sums = {q: np.concatenate([[0], np.cumsum(h)]) for q, h in hit.items()}
        end_of = np.repeat(bounds[1:], np.diff(bounds))
        padded = np.append(words, np.uint64(0))
        found = []
        for span, need, q, tables in self.classes:
            n = len(hit[q])
            if not sums[q][-1]:
                continue
            begin = np.arange(n)
            stop = np.minimum(np.minimum(begin + span - q + 1, end_of[:n]), n)
            starts = np.flatnonzero(sums[q][np.maximum(stop, begin)] - sums[q][:-1] >= need)
            if not len(starts):
                continue
            ends = end_of[starts]
            for salt, wanted, keys, owner in tables:
                key = self._key(walk(padded, starts, ends, wanted[-1] + 1, salt, wanted))
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                many = hi - lo
                place = np.repeat(starts, many)
                if len(place):
                    item = owner[np.repeat(lo, many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)]
                    found.append(np.unique(np.stack([np.searchsorted(bounds, place, "right") - 1, item, place], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else none


def least_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance between item and any part of text, and where that part ends (exclusive)."""
    n = len(item)
    peq: dict[int, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, where = n, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, where = score, j + 1
    return best, where


def _confirmed(items: Items, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, distance, the word of the row at which it starts); the best place of each pair."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for row, item, start in items.candidates(words, bounds).tolist():
        m = len(items.words[item])
        k = items.settings.budget(m)
        if start < done.get((row, item), -1):
            continue  # inside a place that was looked at
        lo, hi = max(bounds[row], start - m), min(bounds[row + 1], start + 3 * m + k)
        done[row, item] = start + m
        wanted, there = items.lists[item], words[lo:hi].tolist()
        if sum(map(set(there).__contains__, wanted)) < m - k:
            continue  # every word that is missing costs an edit
        distance, where = least_distance(wanted, there)
        if distance <= k:
            # read backwards from its end, the item ends where it starts
            size = least_distance(wanted[::-1], there[max(0, where - m - k) : where][::-1])[1]
            best[row, item] = min(best.get((row, item), (m + 1, 0)), (distance, int(lo + where - size - bounds[row])))
    for (row, item), (distance, start) in best.items():
        yield row, item, distance, start


def _blocks(benchmark: DataFrame, settings: Settings) -> Iterator[Items]:
    """The items in blocks of bounded size, one in memory at a time."""
    held_ids, held, size = [], [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        _, _, words, _ = next(normal_words(pa.array([row["text"]])), (0, 0, np.zeros(0, dtype=np.uint64), None))
        if not len(words):
            continue
        held_ids.append(row["item_id"])
        held.append(words)
        size += len(row["text"])
        if len(held) >= settings.block_items or size >= settings.block_chars:
            yield Items(held_ids, held, settings)
            held_ids, held, size = [], [], 0
    if held:
        yield Items(held_ids, held, settings)


def find_leaks(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start_word): every document and item that occurs in it."""
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, distance int, item_words int, start_word long"

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items: Items = held.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                out = []
                for first, _, words, bounds in normal_words(batch.column("text")):
                    for row, item, distance, start in _confirmed(items, words, bounds):
                        out.append((ids[first + row], items.ids[item], distance, len(items.words[item]), start))
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))],
                    ["doc_id", "item_id", "distance", "item_words", "start_word"],
                )

        return run

    source, stage, out = documents.select("doc_id", "text"), Staging(spark, "leaks"), None
    for block in _blocks(benchmark, settings):
        sent = spark.sparkContext.broadcast(block)
        found = stage.save(source.mapInArrow(search(sent), schema), "found")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """documents in which no benchmark item occurs.

    Columns of any name stay as they are, and rows come as often as they did; of rows with one id, each is judged by its
    own text. Null and empty texts stay.
    """
    key = fresh(documents.columns, "key")
    mark = F.xxhash64("doc_id", "text")
    # the search sees the mark of id and text instead of the id
    found = find_leaks(documents.select(mark.alias("doc_id"), "text"), benchmark, settings)
    leaks = found.select(F.col("doc_id").alias(key)).distinct()
    return documents.join(leaks, mark == F.col(key), "left_anti")
