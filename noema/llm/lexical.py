"""Ranked lexical search by three-phase uniform thresholds over term-partitioned postings (operator 11).

Scores are sums over an item's terms, so each term is a list of postings (row, contribution), dealt out by term, best
first. An item's k best documents are found in three phases:

1. Heads: the k best postings of every list. Documents that the heads favour for an item are looked up in full; the k-th
   best of their exact scores is a lower bound of the item's k-th score.
2. Threshold: with m lists, a document none of whose contributions reaches bound / m can't reach the bound. All
   postings at or above it are fetched and summed by document. A document's sum is a lower bound of its score; with what
   each list that was not fetched for it may give at most, it is an upper one. The k-th best sum is the next bound.
3. Lookup: documents whose upper bound reaches it are scored exactly, and the k best are ranked.

All sums are whole numbers and bounds are inclusive, so the result, ties included, is that of scoring every
document. Only A-Z are lowered; a term is a maximal run of ASCII letters, digits and any other characters than ASCII.

Items are a stated query set: they are read in blocks of at most block_items, and postings are made of a block's terms
only; the block's vocabulary (its size is that of the block's texts) is broadcast and freed before the next. A list is
cut into chunks by row, so a term that most documents hold is spread over tasks like any other.

Every row of documents is a document of its own, so repeated rows and ids are ranked each; so is every row of items.
Null and empty texts have no terms: such documents are never found, such items find nothing. Equal scores rank by
ascending doc_id, null last. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from noema.llm import textkit as K
from noema.llm.staging import Staging
from noema.operators.relational import numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SOLID = np.ones(256, dtype=bool)
_SOLID[[b for b in range(128) if not chr(b).isalnum()]] = False


@dataclass(frozen=True)
class Settings:
    #: Documents of an item's ranking, and how many that the heads favour are looked up for its first bound.
    k: int = 20
    probes: int = 200
    block_items: int = 256
    #: Rows of a chunk of a list, and documents whose fetched postings are summed in one group.
    chunk_rows: int = 16_384
    group_rows: int = 4_096


class Block:
    """Items of one block: their terms, and by term the items that hold it."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        counts = [Counter(terms) for _, terms in items]
        self.numbers = np.array([i for i, _ in items], dtype=np.int64)
        vocabulary = sorted({t.encode() for c in counts for t in c})
        place = {t: k for k, t in enumerate(vocabulary)}
        self.size = len(vocabulary)
        self.bytes = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in vocabulary], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.base = next(b for b in K.BASES if len(np.unique(K.word_hashes(self.bytes, self.starts, self.ends, b))) == self.size)
        hashes = K.word_hashes(self.bytes, self.starts, self.ends, self.base)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        item, term, q = zip(*((k, place[t.encode()], n) for k, c in enumerate(counts) for t, n in c.items()))
        by_item = np.lexsort((term, item))
        self.item, self.term, self.q = (np.array(x, dtype=np.int64)[by_item] for x in (item, term, q))
        self.lists = np.bincount(self.item, minlength=len(items))  # m of each item
        self.bounds = np.concatenate([[0], np.cumsum(self.lists)])
        self.by_term = np.argsort(self.term, kind="stable")
        self.term_bounds = np.searchsorted(self.term[self.by_term], np.arange(self.size + 1))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms of the block, and which ones. Equal hashes are confirmed byte by byte."""
        hashes = K.word_hashes(data, starts, ends, self.base)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        hit = np.flatnonzero(self.hashes[spot] == hashes)
        term = self.order[spot[hit]]
        length = ends[hit] - starts[hit]
        same = length == self.ends[term] - self.starts[term]
        hit, term, length = hit[same], term[same], length[same]
        if len(hit):
            first = np.cumsum(length) - length
            inside = np.arange(first[-1] + length[-1])
            equal = data[np.repeat(starts[hit] - first, length) + inside] == self.bytes[np.repeat(self.starts[term] - first, length) + inside]
            same = np.logical_and.reduceat(equal, first)
            hit, term = hit[same], term[same]
        return hit, term

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the terms and each item that holds it: the place among terms, and that among (item, term)."""
        many = self.term_bounds[term + 1] - self.term_bounds[term]
        owner = np.repeat(np.arange(len(term)), many)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return owner, self.by_term[self.term_bounds[term][owner] + inside]


def _runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every term; rows never share one."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = _SOLID[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def term_counts(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """row, doc_id, n (terms with repeats) and the block's terms with their occurrences, of rows(row, doc_id, text) with terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        for batch in batches:
            offsets, data = K.utf8(batch.column("text"))
            for first, last in K.chunks(offsets):
                offs, part = offsets[first : last + 1] - offsets[first], K.LOWER[data[offsets[first] : offsets[last]]]
                starts, ends, row = _runs(offs, part)
                n = np.bincount(row, minlength=last - first)
                hit, term = block.find(part, starts, ends)
                keys, tf = np.unique(row[hit] * block.size + term, return_counts=True)
                some = np.flatnonzero(n)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(keys // block.size, minlength=last - first)[some])]).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (keys % block.size, tf))
                own = pa.array(some)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, last - first).take(own) for c in ("row", "doc_id")] + [pa.array(n[some].astype(np.int64)), *lists], ["row", "doc_id", "n", "terms", "tfs"])

    fields = [rows.schema["row"], rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(count, T.StructType(fields))


def contributions(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 75 + 25 * n * documents // length
    return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of term counts: the place in the batch, term and occurrences of every posting."""
    terms = batch.column("terms")
    size = terms.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), terms.flatten().to_numpy().astype(np.int64), batch.column("tfs").flatten().to_numpy().astype(np.int64)


def postings(counts: DataFrame, weight: np.ndarray, chunks: np.ndarray, documents: int, length: int) -> DataFrame:
    """term, chunk, row and s (contribution): lists dealt out by term and chunk, the best first."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, term, tf = _flat(batch)
            row, n = batch.column("row").to_numpy()[at], batch.column("n").to_numpy()[at]
            chunk = (K.mix(row.view(np.uint64)) % chunks[term].astype(np.uint64)).astype(np.int32)
            s = contributions(tf, n, weight[term], documents, length)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(chunk), pa.array(row), pa.array(s)], ["term", "chunk", "row", "s"])

    made = counts.select("row", "n", "terms", "tfs").mapInArrow(make, "term int, chunk int, row long, s long")
    return made.repartition("term", "chunk").sortWithinPartitions("term", F.col("s").desc())


def lookup(pairs: DataFrame, counts: DataFrame, sent: Broadcast, weight: np.ndarray, documents: int, length: int) -> DataFrame:
    """item, row, doc_id and score: exact scores of the pairs (item, row); an item is its place in the block."""
    wanted = pairs.groupBy("row").agg(F.collect_set("item").alias("items"))  # at most all items of a block

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        for batch in batches:
            at, term, tf = _flat(batch)
            s = contributions(tf, batch.column("n").to_numpy()[at], weight[term], documents, length)
            bounds = np.searchsorted(at, np.arange(batch.num_rows + 1))
            place, item, total = [], [], []
            for r, items in enumerate(batch.column("items")):
                have, value = term[bounds[r] : bounds[r + 1]], s[bounds[r] : bounds[r + 1]]
                for i in items.as_py():
                    own = slice(block.bounds[i], block.bounds[i + 1])
                    spot = np.minimum(np.searchsorted(have, block.term[own]), len(have) - 1)
                    total.append(int(np.sum(np.where(have[spot] == block.term[own], value[spot] * block.q[own], 0))) if len(have) else 0)
                    place.append(r)
                    item.append(i)
            own = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column("row").take(own), batch.column("doc_id").take(own), pa.array(total, pa.int64())], ["item", "row", "doc_id", "score"])

    fields = [T.StructField("item", T.IntegerType()), counts.schema["row"], counts.schema["doc_id"], T.StructField("score", T.LongType())]
    return wanted.join(counts, "row").select("row", "doc_id", "n", "terms", "tfs", "items").mapInArrow(score, T.StructType(fields))


def _kth(scores: DataFrame, by: str, k: int, items: int) -> np.ndarray:
    """The k-th highest value of every item, 0 where there are fewer; one number an item comes to the driver."""
    window = Window.partitionBy("item").orderBy(F.col(by).desc(), "row")
    ranked = scores.select("item", "row", by).withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)
    out = np.zeros(items, dtype=np.int64)
    for r in ranked.where(F.col("place") == k).select("item", by).collect():
        out[r["item"]] = r[by]
    return out


def fetched(lists: DataFrame, sent: Broadcast, bound: np.ndarray, most: np.ndarray, groups: int, k: int) -> DataFrame:
    """item, row, low and high: bounds of the scores of documents with a posting at or above the uniform threshold,
    but for those whose upper bound lies below the item's bound or the k-th sum in their group. bound: by item; most: by term, the best contribution."""
    block: Block = sent.value
    m, q = block.lists[block.item], block.q
    # a list of an item counts from bound / m on; so a posting that isn't fetched gives under it
    least = -(-bound[block.item] // (m * q))
    rest = np.minimum(np.maximum(bound[block.item] - 1, 0) // m, q * most[block.term])
    total = np.bincount(block.item, weights=None, minlength=len(bound)) * 0
    np.add.at(total, block.item, rest)
    threshold = np.full(block.size, np.iinfo(np.int64).max)
    np.minimum.at(threshold, block.term, least)
    spark = lists.sparkSession
    bounds = spark.createDataFrame(pa.table({"term": pa.array(np.arange(block.size, dtype=np.int32)), "least": pa.array(threshold)}))
    near = lists.join(F.broadcast(bounds), "term").where("s >= least").select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("grp"), "row", "term", "s")

    def add(table: pa.Table) -> pa.Table:
        own: Block = sent.value
        table = table.combine_chunks()
        row, s, term = (table.column(c).to_numpy() for c in ("row", "s", "term"))
        rows, at = np.unique(row, return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, s, term = at[order], s[order], term[order].astype(np.int64)
        items, out = len(bound), []
        best: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * items
        step = max(1, (1 << 20) // items)
        for first in range(0, len(rows), step):
            part = slice(*np.searchsorted(at, [first, first + step]))
            owner, pair = own.spread(term[part])
            keep = s[part][owner] >= least[pair]
            owner, pair = owner[keep], pair[keep]
            cell = (at[part][owner] - first) * items + own.item[pair]
            low, high = np.zeros(step * items, dtype=np.int64), np.tile(total, step)
            np.add.at(low, cell, s[part][owner] * own.q[pair])
            np.subtract.at(high, cell, rest[pair])
            cells = np.unique(cell)
            out.append((cells % items, rows[cells // items + first], low[cells], low[cells] + high[cells]))
            for i in np.unique(out[-1][0]):  # the k best sums so far
                now = np.concatenate([best[i], out[-1][2][out[-1][0] == i]])
                best[i] = np.partition(now, len(now) - k)[len(now) - k :] if len(now) > k else now
            floor = np.maximum(bound, [b.min() if len(b) == k else 0 for b in best])
            out[-1] = tuple(x[out[-1][3] >= floor[out[-1][0]]] for x in out[-1])
        item, row, low, high = (np.concatenate(x) for x in zip(*out))
        keep = high >= floor[item]
        return pa.table({"item": pa.array(item[keep].astype(np.int32)), "row": pa.array(row[keep]), "low": pa.array(low[keep]), "high": pa.array(high[keep])})

    return near.groupBy("grp").applyInArrow(add, "item int, row long, low long, high long")


def _search_block(rows: DataFrame, items: list[tuple[int, list[str]]], settings: Settings, stage: Staging) -> DataFrame | None:
    """i, doc_id, score and rank of a block's items; None if no document has terms."""
    spark: SparkSession = rows.sparkSession
    block = Block(items)
    sent = spark.sparkContext.broadcast(block)
    counts = stage.save(term_counts(rows, sent), "counts")
    documents, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return None
    df = np.zeros(block.size, dtype=np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a number a term of the block
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    lists = stage.save(postings(counts, weight, np.maximum(1, -(-df // settings.chunk_rows)), documents, length), "postings")

    best = Window.partitionBy("term").orderBy(F.col("s").desc(), "row")
    heads = stage.save(lists.withColumn("place", F.row_number().over(best)).where(F.col("place") <= settings.k), "heads")
    most = np.zeros(block.size, dtype=np.int64)
    for r in heads.where("place = 1").select("term", "s").collect():
        most[r["term"]] = r["s"]
    pairs = spark.createDataFrame(pa.table({"term": pa.array(block.term.astype(np.int32)), "item": pa.array(block.item.astype(np.int32)), "q": pa.array(block.q)}))
    sums = heads.join(F.broadcast(pairs), "term").groupBy("item", "row").agg(F.sum(F.col("q") * F.col("s")).alias("low"))
    favoured = Window.partitionBy("item").orderBy(F.col("low").desc(), "row")
    probes = sums.withColumn("place", F.row_number().over(favoured)).where(F.col("place") <= settings.probes).select("item", "row")
    bound = _kth(lookup(probes, counts, sent, weight, documents, length), "score", settings.k, len(items))

    groups = max(1, -(-documents // settings.group_rows))
    near = stage.save(fetched(lists, sent, bound, most, groups, settings.k), "fetched")
    bound = np.maximum(bound, _kth(near, "low", settings.k, len(items)))
    bounds = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(items), dtype=np.int32)), "i": pa.array(block.numbers), "bound": pa.array(bound)}))
    left = near.join(F.broadcast(bounds), "item").where("high >= bound").select("item", "row")
    exact = lookup(left, counts, sent, weight, documents, length).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k)
    found = stage.save(ranked.join(F.broadcast(bounds), "item").select("i", "doc_id", "score", "rank"), "found")
    for used in (counts, lists, heads, near):
        stage.drop(used)
    sent.destroy()
    return found


def search(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id and score: of every item the k highest-scoring documents with a score above 0.

    documents has doc_id and text, items has item_id and text. N documents have terms, L terms in all, n in one; a term
    in df documents weighs w = floor(1000 ln((2N + 2) / (2df + 1))) and gives w * (10^9 tf div (1000 tf + 12 m)) for each time
    an item holds it, where m = 75 + (25 n N div L).
    """
    spark = documents.sparkSession
    stage = Staging(spark, "lexical")
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = numbered(items.select("item_id", terms.alias("terms"), F.monotonically_increasing_id().alias("i")).where("size(terms) > 0"), F.col("i")).drop("i")
    asked = stage.save(asked.withColumn("block", F.floor(F.col("number") / settings.block_items)), "items")
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    blocks, found = asked.agg(F.max("block")).first()[0], []
    for b in range(0 if blocks is None else blocks + 1):
        own = asked.where(F.col("block") == b).select("number", "terms").collect()  # a block of the query set
        part = _search_block(rows, [(r["number"], r["terms"]) for r in own], settings, stage)
        if part is not None:
            found.append(part)
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {documents.schema['doc_id'].dataType.simpleString()}, score long"
    if not found:
        return spark.createDataFrame([], schema)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.join(asked.select(F.col("number").alias("i"), "item_id"), "i").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
