"""Alignment of two tokenizers' tokens through distinct segments (operator 13).

A byte-level BPE (A) and a sentencepiece BPE (B) encode the same text; tokens whose byte ranges overlap are linked, and
byte offsets where tokens of both end cut them into groups. Texts repeat few different words, so the work is done once
for each different segment of the corpus: a text, with one space before it, is cut before every run of spaces that follows
a character that isn't white. There no token of either vocabulary can cross the cut, which Pair verifies when it
loads: no entry of A or B holds a space after anything but white characters, and A's splits are those of a byte-level
pre-tokenizer, which always splits there and looks ahead only within a run. If that can't be verified, each text is
one segment, which is slow and right. So a text's tokens are those of its segments, and so are its links and groups.

Blocks of texts keep a dictionary of their own segments, so what is shuffled is a row a block and different segment,
not one a word. Distinct segments are encoded and aligned once; their alignments are joined back to the dictionaries, and
texts are composed block by block. How often an id pair is linked in the whole corpus follows from the segments' totals,
less those of texts that have no tokens.

Null and empty texts have no tokens: zeros and an empty digest. So have texts one of whose encodings doesn't give back the
text (with U+2581 in them, for one). Repeated rows come out as often as they go in and count each; ids
may be null or repeat. Of ids with equal counts all are best. A text without spaces is one segment of any
length. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noema.llm.staging import Staging, delete

MARK = "▁"
_CUT = re.compile(r"(?<=\S)(?= )")
#: Where a space doesn't begin a segment, in a text with a space before it.
_WITHIN = re.compile(r"\s ")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@dataclass(frozen=True)
class Settings:
    #: Characters of text that share a dictionary, unless one text is longer.
    block_chars: int = 32 << 20
    #: The table of linked id pairs is broadcast up to so many rows, and joined by shuffles beyond.
    broadcast_rows: int = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: visible Latin-1 ones stand for themselves, the others
    follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _spaced(entry: str) -> bool:
    """Whether a space follows something that isn't white."""
    return _CUT.search(entry) is not None


class Pair:
    """Both tokenizers, the bytes of their tokens, and what they make of a segment."""

    def __init__(self, json_a: bytes, model_b: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocabulary.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE_PIECE.fullmatch(p)) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(MARK)
        if b"".join(self.bytes_b[i] for i in self.b.encode("a  b ")) != b" a  b ":
            raise ValueError("the sentencepiece model doesn't keep spaces")
        self.cuts = self._cuts_hold(json.loads(json_a))

    def _cuts_hold(self, spec: dict) -> bool:
        before = spec.get("pre_tokenizer") or {}
        regular = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        # bytes outside UTF-8 become a visible character, so a piece of a longer character counts as not white
        whole = (t.decode(errors="replace") for t in self.bytes_a.values())
        return bool(regular) and not any(map(_spaced, whole)) and not any(_spaced(t.decode(errors="replace")) for t in self.bytes_b)

    def segments(self, text: str) -> list[str]:
        """The segments of a text without their first space; with it, joined they are a space and the text."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        whole = " " + text
        return [x[1:] for x in _CUT.split(whole)] if _WITHIN.search(whole) else text.split(" ")

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of segments (without their first space), as they are inside a text."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + x for x in segments], add_special_tokens=False)]
        b = self.b.encode(segments, num_threads=1)
        return a, [x or [self.space] for x in b]

    def align(self, segment: str, a: list[int], b: list[int]) -> tuple[str, list[int], list[int]] | None:
        """Groups as text and the ids of the links, A's and B's; None if the tokens don't give the segment back."""
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(parts_a) != (whole := (" " + segment).encode()) or b"".join(parts_b) != whole:
            return None
        if len(a) == 1 or len(b) == 1:
            return f"{','.join(map(str, a))}|{','.join(map(str, b))}", a * len(b), b * len(a)
        left, right, groups, i, j, from_a, from_b = [], [], [], 0, 0, 0, 0
        gap = len(parts_a[0]) - len(parts_b[0])  # where A's token ends, less where B's does
        while True:
            left.append(a[i])
            right.append(b[j])
            if not gap:
                i, j = i + 1, j + 1
                groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                if i == len(a):
                    return ";".join(groups), left, right
                from_a, from_b = i, j
                gap = len(parts_a[i]) - len(parts_b[j])
            elif gap < 0:
                i += 1
                gap += len(parts_a[i])
            else:
                j += 1
                gap -= len(parts_b[j])


class Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        return at


_loaded: dict[str, Pair] = {}


def _pair(key: str, blobs) -> Pair:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pair(*blobs.value)
    return _loaded[key]


def _tables(documents: DataFrame, key: str, blobs, settings: Settings) -> DataFrame:
    """Rows of two kinds: texts (kind 0: block, doc_id, segs: places in the block's dictionary) and dictionaries
    (kind 1: block, idx, segment, n)."""
    kinds = {"kind": pa.int32(), "block": pa.int64(), "doc_id": None, "segs": pa.list_(pa.int32()), "idx": pa.int32(), "segment": pa.string(), "n": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, id_type = _pair(key, blobs), TaskContext.get().partitionId() << 32, None
        ids, segs, bounds, places, size = [], array("i"), array("i", [0]), Numbers(), 0

        def made() -> Iterator[pa.RecordBatch]:
            flat = np.frombuffer(segs, dtype=np.int32)
            texts = {"doc_id": pa.chunked_array(ids).combine_chunks(), "segs": pa.ListArray.from_arrays(pa.array(np.frombuffer(bounds, dtype=np.int32)), pa.array(flat))}
            words = {"idx": pa.array(np.arange(len(places), dtype=np.int32)), "segment": pa.array(places, pa.string()), "n": pa.array(np.bincount(flat, minlength=len(places)))}
            for kind, own in enumerate((texts, words)):
                m = len(next(iter(own.values())))
                own |= {"kind": pa.array(np.full(m, kind, dtype=np.int32)), "block": pa.array(np.full(m, block))}
                whole = pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(m, t or id_type) for c, t in kinds.items()], list(kinds))
                yield from (whole.slice(at, 1 << 16) for at in range(0, m, 1 << 16))

        for batch in batches:
            id_type, first = batch.column("doc_id").type, 0
            for row, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                segs.extend(map(places.__getitem__, pair.segments(text)))
                bounds.append(len(segs))
                size += len(text)
                if size >= settings.block_chars:
                    ids.append(batch.column("doc_id").slice(first, row + 1 - first))
                    yield from made()
                    block, first = block + 1, row + 1
                    ids, segs, bounds, places, size = [], array("i"), array("i", [0]), Numbers(), 0
            if first < batch.num_rows:
                ids.append(batch.column("doc_id").slice(first))
        if ids:
            yield from made()

    schema = f"kind int, block long, doc_id {documents.schema['doc_id'].dataType.simpleString()}, segs array<int>, idx int, segment string, n long"
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def _aligned(segments: DataFrame, key: str, blobs) -> DataFrame:
    """segments(segment, total) encoded and aligned: n_a, n_b, n_groups, groups (null where the tokens don't give the
    segment back), and the links' ids as two lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(key, blobs)
        for batch in batches:
            texts = batch.column("segment").to_pylist()
            ids_a, ids_b = pair.encode(texts)
            found = [pair.align(*x) or (None, [], []) for x in zip(texts, ids_a, ids_b)]
            sizes = (np.fromiter(map(len, x), dtype=np.int64, count=len(texts)) for x in (ids_a, ids_b))
            groups = [f[0] for f in found]
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(f[1]) for f in found])]).astype(np.int32))
            links = (pa.ListArray.from_arrays(bounds, pa.array(np.fromiter((i for f in found for i in f[k]), dtype=np.int32))) for k in (1, 2))
            columns = [*map(pa.array, sizes), pa.array([g.count(";") + 1 if g else 0 for g in groups], pa.int64()), pa.array(groups, pa.string()), *links]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("total"), *columns], ["segment", "total", "n_a", "n_b", "n_groups", "groups", "link_a", "link_b"])

    return segments.mapInArrow(run, "segment string, total long, n_a long, n_b long, n_groups long, groups string, link_a array<int>, link_b array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The links of a batch of segments as one number each, and their bounds by segment."""
    a, b = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("link_a", "link_b"))
    return a << 32 | b, np.concatenate([[0], np.cumsum(batch.column("link_a").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def pair_counts(segments: DataFrame) -> DataFrame:
    """(pair, b, count, best): how often each id pair is linked in the corpus, and whether no other with that B id is
    linked more often. Tasks add up their own segments first, in parts of bounded size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, bounds = _flat(batch)
            pairs, at = np.unique(links, return_inverse=True)
            count = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(count, at, np.repeat(batch.column("total").to_numpy(), np.diff(bounds)))
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(count)], ["pair", "count"])

    sums = segments.select("total", "link_a", "link_b").mapInArrow(add, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    sums = sums.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = sums.groupBy("b").agg(F.max("count").alias("most"))
    return sums.join(most, "b").select("pair", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


_VALUES = ["segment", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]


def _valued(segments: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """segments with the number of their links, of those that are best, and the sum of the links' counts."""
    if pairs.count() > settings.broadcast_rows:
        links = segments.select("segment", F.explode(F.arrays_zip("link_a", "link_b")).alias("x"))
        links = links.select("segment", (F.shiftleft(F.col("x.link_a").cast("long"), 32).bitwiseOR(F.col("x.link_b").cast("long"))).alias("pair"))
        sums = links.join(pairs, "pair").groupBy("segment").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        return segments.join(sums, "segment").select(*_VALUES)
    known = pairs.select("pair", "count", "best").orderBy("pair").toArrow()
    sent = segments.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "count", "best")))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, best = sent.value
        for batch in batches:
            links, bounds = _flat(batch)
            at = np.searchsorted(names, links)
            sums = (np.concatenate([[0], np.cumsum(x[at])]) for x in (best, counts))
            columns = [np.diff(bounds), *(x[bounds[1:]] - x[bounds[:-1]] for x in sums)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _VALUES[:5]), *map(pa.array, columns)], _VALUES)

    return segments.mapInArrow(value, "segment string, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long")


def _composed(texts: DataFrame, words: DataFrame, keep_groups: bool) -> DataFrame:
    """One row a text from the alignments of its segments; a block's texts and dictionary meet in one task."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def compose(docs: pa.Table, own: pa.Table) -> pa.Table:
        at = own.column("idx").to_numpy()
        values = np.zeros((len(COUNTS), int(at.max(initial=-1)) + 1), dtype=np.int64)
        groups = [""] * values.shape[1]
        for k, c in enumerate(COUNTS):
            values[k, at] = own.column(c).to_numpy()
        for k, g in zip(at.tolist(), own.column("groups").to_pylist()):
            groups[k] = g
        sums, digests, whole = np.zeros((len(COUNTS), docs.num_rows), dtype=np.int64), [], []
        for r, segs in enumerate(docs.column("segs")):
            places = segs.values.to_numpy() if segs.is_valid else np.zeros(0, dtype=np.int64)
            text = ";".join(map(groups.__getitem__, places.tolist()))
            sums[:, r] = values[:, places].sum(1)
            digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
            if keep_groups:
                whole.append(text)
        out = {"doc_id": docs.column("doc_id")} | {c: pa.array(x) for c, x in zip(COUNTS, sums)} | {"groups_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"groups": pa.array(whole, pa.string())} if keep_groups else {}))

    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string" + (", groups string" if keep_groups else "")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(compose, schema)


def align(documents: DataFrame, json_path: str, model_path: str, settings: Settings = Settings(), keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with keep_groups the groups themselves
    (`a1,a2|b1;a3|b2,b3`) of every text of documents(doc_id, text).

    n_best counts the links whose id pair is linked at least as often in the corpus as any other with the same B id;
    count_sum adds up how often each link's pair is. The two files are read on the driver and broadcast: their
    size doesn't depend on the data.
    """
    spark = documents.sparkSession
    blobs = tuple(open(p, "rb").read() for p in (json_path, model_path))
    key = hashlib.sha256(b"".join(blobs)).hexdigest()
    sent = spark.sparkContext.broadcast(blobs)
    stage = Staging(spark, "alignment")
    both = stage.save(_tables(documents, key, sent, settings), "blocks", partition_by="kind", codec="zstd")
    texts = both.where("kind = 0").select("block", "doc_id", "segs")
    words = both.where("kind = 1").select("block", "idx", "segment", "n")
    segments = stage.save(_aligned(words.groupBy("segment").agg(F.sum("n").alias("total")), key, sent), "segments", codec="zstd")

    bad = segments.where("groups is null").select("segment")
    if not bad.isEmpty():
        # texts that hold such a segment have no tokens, and what they hold doesn't count
        held = words.join(bad, "segment", "left_semi").groupBy("block").agg(F.collect_set("idx").alias("bads"))
        marked = stage.save(texts.join(held, "block", "left").withColumn("bad", F.coalesce(F.arrays_overlap("segs", "bads"), F.lit(False))).drop("bads"), "texts")
        texts = marked.select("block", "doc_id", F.when(~F.col("bad"), F.col("segs")).alias("segs"))
        lost = marked.where("bad").select("block", F.explode("segs").alias("idx")).groupBy("block", "idx").agg(F.count("*").alias("lost"))
        lost = lost.join(words, ["block", "idx"]).groupBy("segment").agg(F.sum("lost").alias("lost"))
        less = stage.save(segments.join(lost, "segment", "left").withColumn("total", F.col("total") - F.coalesce("lost", F.lit(0))).drop("lost"), "segments", codec="zstd")
        stage.drop(segments)
        segments = less

    counted = segments.where("groups is not null and total > 0")
    pairs = stage.save(pair_counts(counted), "pairs")
    # a table, so that the files of this shuffle are gone before the next one
    named = stage.save(words.select("block", "idx", "segment").join(_valued(counted, pairs, settings), "segment").drop("segment"), "dictionaries", codec="zstd")
    stage.drop(segments)
    delete(spark, f"{both._staged_path}/kind=1")
    return _composed(texts, named, keep_groups)
