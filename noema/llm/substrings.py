"""Substring dedup with a log-structured fingerprint index (operator 2).

A window is 35 consecutive words of one document. Each window is filed under its anchor, the least of the hashes
of the 5-word grams inside it (the leftmost on ties), so equal windows have equal anchors at equal places. The
windows that share one anchor are a run, and one row stands for it: the anchor's hash and a digest of all words the
run covers. About one word in 16 is an anchor.

The index is a log of immutable tables in a folder, each sorted by anchor and digest: a batch's runs are grouped,
merge-joined with the sorted tables of earlier batches, written as a table of their own, and tables are compacted into one
when there are more than a few. A small table of names says which tables count, so what a lost driver left half written
doesn't, and the next run opens the log where the last one ended. Equal rows are equal runs: all of their windows repeat.
Runs with equal anchors and different digests may share some windows; of each different run one place is read again and
verified window by window. Words are equal where a 64-bit polynomial hash and 64 bits of BLAKE2 of the words themselves
are. Nothing is compared in pairs, so a passage in thousands of documents costs as many rows, not their square.

Null, empty and short texts have no windows. Repeated rows repeat each other's windows. Columns other than doc_id and
text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.llm import textkit as K
from noema.llm.staging import Staging, delete, listed


#: What tells runs apart.
RUN = ["anchor", "digest", "check"]


@dataclass(frozen=True)
class Settings:
    window: int = 35
    gram: int = 5
    #: Batches in which a table without a history is ingested, and tables of the log before compaction.
    batches: int = 3
    tables: int = 2


def row_key() -> Column:
    """Names a row by id and text, so that rows with one id stay apart."""
    return F.xxhash64("doc_id", "text")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of the given width, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Words:
    """The words of a chunk of texts: hashes, row bounds, and all words joined by one space."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        starts, ends, rows = K.words(offsets, data)
        self.hashes = K.word_hashes(data, starts, ends)
        self.bounds = K.row_bounds(rows, len(offsets) - 1)
        self.at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        joined = np.full(self.at[-1], 0x20, dtype=np.uint8)
        inside = np.arange((ends - starts).sum()) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        joined[np.repeat(self.at[:-1], ends - starts) + inside] = data[np.repeat(starts, ends - starts) + inside]
        self.joined = memoryview(joined.tobytes())

    def digests(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits of BLAKE2 of the words begin to end."""
        joined, make = self.joined, hashlib.blake2b
        found = [make(joined[a:b], digest_size=8).digest() for a, b in zip(self.at[begin].tolist(), self.at[end].tolist())]
        return np.frombuffer(b"".join(found), dtype=np.int64)


def runs(words: Words, settings: Settings) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, digest, check) of all runs; window numbers are word positions in the row."""
    hashes, bounds = words.hashes, words.bounds
    none = np.zeros(0, dtype=np.int64)
    n, w, k = len(hashes), settings.window, settings.gram
    if n < w:
        return (none,) * 6
    at = np.arange(n - k + 1)
    grams = K.Spans(hashes, K.BASES[0]).of(at, at + k)
    # the low 30 bits hold the position in the chunk, so ties go to the left; a string has no 2**30 words
    place = np.uint64((1 << 30) - 1)
    least = _least((grams & ~place) | at.astype(np.uint64), w - k + 1)
    anchor = (least & place).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    good = row[: n - w + 1] == row[w - 1 :]
    start = np.flatnonzero(good)
    if not len(start):
        return (none,) * 6
    anchor, owner = anchor[start], row[start]
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(start)))
    begin = start[first]
    digest = K.Spans(hashes, K.BASES[1]).of(begin, begin + size + w - 1)
    digest = K.mix(digest + (anchor[first] - begin).astype(np.uint64))
    check = words.digests(begin, begin + size + w - 1)
    return owner[first], begin - bounds[owner[first]], size, grams[anchor[first]].view(np.int64), digest.view(np.int64), check


def _words(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    offsets, data = K.utf8(texts)
    for first, last in K.chunks(offsets):
        yield first, last, Words(offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]])


def fingerprints(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, start, size, anchor, digest, check): every run of windows of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, _, words in _words(batch.column("text")):
                row, start, size, *marks = runs(words, settings)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first + row]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), *map(pa.array, marks)],
                    ["key", "start", "size", *RUN],
                )

    return documents.select(row_key().alias("key"), "text").mapInArrow(run, "key long, start int, size int, anchor long, digest long, check long")


class FingerprintLog:
    """Sorted immutable tables of (anchor, digest, check, n, place) in a folder: n runs seen, and the place of one.

    Opened on a folder that holds a log, it goes on with that. What counts are the tables named in the newest complete
    list of names; one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings()):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings
        lists = sorted(p for p in listed(spark, f"{self.folder}/names-*/_SUCCESS"))
        newest = lists[-1].rsplit("/", 1)[0] if lists else None
        self.names = sorted(r["name"] for r in spark.read.parquet(newest).collect()) if newest else []
        self.count = max([0, *(int(p.rstrip("/").rsplit("-", 1)[1]) for p in listed(spark, f"{self.folder}/*-*"))])

    def tables(self) -> list[DataFrame]:
        return [self.spark.read.schema(_ROWS).parquet(f"{self.folder}/{name}") for name in self.names]

    def _write(self, rows: DataFrame, keep: list[str]) -> None:
        """Write a sorted table, then the list of names that makes it count, then delete what counts no more."""
        self.count += 1
        name = f"run-{self.count:09d}"
        rows.sortWithinPartitions(*RUN).write.parquet(f"{self.folder}/{name}")
        names = [*keep, name]
        self.spark.createDataFrame([(x,) for x in names], "name string").coalesce(1).write.parquet(f"{self.folder}/names-{self.count:09d}")
        gone = [x for x in self.names if x not in names]
        self.names = names
        for path in [f"{self.folder}/{x}" for x in gone] + [p.rsplit("/", 1)[0] for p in listed(self.spark, f"{self.folder}/names-*/_SUCCESS") if f"{self.count:09d}" not in p]:
            delete(self.spark, path)

    def ingest(self, batch: DataFrame, stage: Staging) -> DataFrame:
        """Add a batch of fingerprints; the RUN columns of its runs that repeat in it or in what came before."""
        old = self.tables()
        self._write(batch.groupBy(*RUN).agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "size")).alias("place")), self.names)
        new = self.tables()[-1]
        repeated = new.where("n > 1").select(*RUN)
        for table in old:
            repeated = repeated.union(new.select(*RUN).join(table.select(*RUN), RUN))
        repeated = stage.save(repeated.distinct(), "repeated")
        if len(self.names) > self.settings.tables:
            self.compact()
        return repeated

    def merged(self) -> DataFrame:
        """All tables as one, grouped anew only if there are several."""
        first, *others = self.tables()
        for table in others:
            first = first.union(table)
        return first.groupBy(*RUN).agg(F.sum("n").alias("n"), F.min("place").alias("place")) if others else first

    def compact(self) -> None:
        if len(self.names) > 1:
            self._write(self.merged(), [])


_ROWS = "anchor long, digest long, check long, n long, place struct<key:long,start:int,size:int>"


def _windows(candidates: DataFrame, documents: DataFrame, settings: Settings) -> DataFrame:
    """(w1, w2, key, start) of every window of the candidate runs (key, start, size)."""
    places = candidates.groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("places"))
    both = documents.select(row_key().alias("key"), "text").join(places, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = settings.window
        for batch in batches:
            keys = batch.column("key").to_numpy()
            lists = batch.column("places")
            offs = lists.offsets.to_numpy()
            flat = lists.values
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            for first, last, words in _words(batch.column("text")):
                hashes, bounds = words.hashes, words.bounds
                own = slice(offs[first], offs[last])
                counts = np.diff(offs[first : last + 1])
                base = np.repeat(bounds[:-1], counts) + start[own]
                n = size[own].astype(np.int64)
                at = np.repeat(base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(np.repeat(np.arange(last - first), counts), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(K.Spans(hashes, K.BASES[0]).of(at, at + w).view(np.int64)), pa.array(words.digests(at, at + w)),
                        pa.array(keys[first + row]), pa.array((at - bounds[row]).astype(np.int32)),
                    ],
                    ["w1", "w2", "key", "start"],
                )

    return both.select("key", "text", "places").mapInArrow(run, "w1 long, w2 long, key long, start int")


def repeated_windows(documents: DataFrame, settings: Settings = Settings(), log: FingerprintLog | None = None, history: DataFrame | None = None) -> DataFrame:
    """(key, start, size): stretches of window starts whose windows also start elsewhere.

    With a log, documents are its next batch, elsewhere includes all that the log has seen, and history holds the
    documents of earlier batches (read only where runs with one anchor differ). Without, a log is made for these
    documents alone, in a few batches.
    """
    stage = Staging(documents.sparkSession, "substrings")
    batches = 1 if log else settings.batches
    log = log or FingerprintLog(documents.sparkSession, f"{stage.root}/log", settings)
    prints = stage.save(fingerprints(documents, settings).withColumn("batch", F.pmod("key", F.lit(batches)).cast("int")), "prints", "batch")
    repeated = None
    for batch in range(batches):
        new = log.ingest(prints.where(F.col("batch") == batch).drop("batch"), stage)
        repeated = new if repeated is None else repeated.union(new)
    # a table, so that a run with many places is an ordinary skewed partition of the join, which Spark splits
    repeated = stage.save(repeated.distinct(), "all_repeated")
    whole = stage.save(prints.drop("batch").join(repeated, RUN).select("key", "start", "size"), "whole")
    index = log.merged()
    own = stage.save(prints.select("anchor").distinct(), "anchors")
    stage.drop(prints)
    shared = index.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").join(own, "anchor").select("anchor")
    candidates = stage.save(index.join(stage.save(shared, "shared"), "anchor").select("place.*"), "candidates")
    both = documents.select("doc_id", "text")
    both = both if history is None else both.unionByName(history.select("doc_id", "text"))
    windows = stage.save(_windows(candidates, both, settings), "windows")
    twice = stage.save(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "twice")
    single = stage.save(windows.join(twice, ["w1", "w2"]).select("key", "start", F.lit(1).alias("size")), "single")
    stage.drop(windows)
    return whole.union(single)


def dedup(documents: DataFrame, settings: Settings = Settings(), log: FingerprintLog | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every document: words in repeated windows are removed. With a log,
    documents are its next batch, and windows count as repeated if they occur in an earlier one too."""
    places = repeated_windows(documents, settings, log, history).groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("places"))
    both = documents.select("doc_id", row_key().alias("key"), "text").join(places, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            offs = lists.offsets.to_numpy()
            start, size = lists.values.field("start").to_numpy(), lists.values.field("size").to_numpy()
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            n, gone, kept = [], [], []
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                removed = 0
                if valid[i] and offs[i + 1] > offs[i]:
                    own = slice(offs[i], offs[i + 1])
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, start[own], 1)
                    np.add.at(edge, start[own] + size[own] + settings.window - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    removed = int(len(words) - keep.sum())
                    words = compress(words, keep.tolist())
                gone.append(removed)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return both.select("doc_id", "text", "places").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
