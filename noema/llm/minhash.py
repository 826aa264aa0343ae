"""MinHash near-duplicates by fast similarity sketching (operator 5).

A sketch has t coordinates ("bins"). In round i < t every shingle is thrown by its own hash into one bin with a
value above all earlier rounds' values; in round t + b every shingle falls into bin b. A bin keeps the least
value it gets, so rounds are needed only until all bins are full: one or two for long texts, and at most 2 t for
any. Unlike one-permutation hashing, no bin is filled by copying, hence the concentration bounds of independent
hashing (Dahlgaard, Knudsen, Thorup 2017).

Bands of coordinates are bucket keys. Texts with equal shingle sets are one class first, so exact copies cost one
sketch row and no pair. In each bucket all members are compared with one pivot. Buckets that still hold
several components get another pivot; what then still lies apart is compared in blocks of bounded size, inside tasks
that return only the links that join components. All links are confirmed on full texts.
At similarity 0.85 one of 24 bands of 4 is shared with probability 1 - 2e-8.

Null, empty and blank texts have no shingles and link with nothing. Rows with one doc_id are one node, whatever their texts:
it is linked with all that any of them is linked with. Repeated rows come out as often as they go in; rows without an id are
no node. Columns other than doc_id and text are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm import textkit as K
from noema.llm.graph import connected_components
from noema.llm.staging import Staging, fresh


@dataclass(frozen=True)
class Settings:
    width: int = 5
    bands: int = 24
    rows: int = 4
    #: A pair links if 100 * intersection >= percent * union.
    percent: int = 85
    #: Turns in which each bucket gets another pivot, before what still lies apart is compared in full.
    turns: int = 1
    #: Texts in a block of that comparison, and the least share of equal coordinates that is verified there: at
    #: similarity 0.85 fewer agree with probability 3e-6.
    block: int = 128
    agreement: float = 0.69

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def _round_hash(values: np.ndarray, i: int) -> np.ndarray:
    return K.mix(values ^ np.uint64((0x5851F42D4C957F2D * (i + 1)) & (1 << 64) - 1))


def sketch(values: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Sketches (sets by t, uint64) of the non-empty sets values[bounds[i]:bounds[i + 1]]; empty sets: all ones."""
    n, full = len(bounds) - 1, np.uint64((1 << 64) - 1)
    out = np.full((n, t), full, dtype=np.uint64)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    open_sets = sizes > 0
    for i in range(2 * t):
        if not open_sets.any():
            break
        if not open_sets[owner].all():
            keep = open_sets[owner]
            values, owner = values[keep], owner[keep]
        h = _round_hash(values, i)
        # the round in the high bits puts a later round's values above all earlier ones
        value = (h >> np.uint64(16)) | np.uint64(i) << np.uint64(48)
        at = owner * t + ((h & np.uint64(0xFFFF)) * np.uint64(t) >> np.uint64(16)).astype(np.int64) if i < t else owner * t + (i - t)
        np.minimum.at(out.reshape(-1), at, value)
        open_sets &= (out == full).any(axis=1)
    return out


def band_keys(sketches: np.ndarray, settings: Settings) -> np.ndarray:
    parts = sketches.reshape(len(sketches), settings.bands, settings.rows)
    key = np.tile(np.arange(settings.bands, dtype=np.uint64), (len(sketches), 1))
    for r in range(settings.rows):
        key = K.mix(key * np.uint64(K.BASES[0]) + parts[:, :, r])
    return key.view(np.int64)


def signatures(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set and the band keys of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, values, bounds in K.shingles(batch.column("text"), settings.width):
                sizes = np.diff(bounds)
                digest = []
                for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
                    sums = np.zeros(len(values) + 1, dtype=np.uint64)
                    np.cumsum(K.mix(values ^ np.uint64(salt)), out=sums[1:])
                    digest.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                keys = band_keys(sketch(values, bounds, settings.coordinates), settings)
                filled = sizes > 0
                offsets = np.concatenate([[0], np.cumsum(filled * settings.bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(sizes.astype(np.int64)), *map(pa.array, digest), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[filled].reshape(-1)))],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return documents.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. Each text of b travels once a pair; the text
    of a is met at its pairs' place, whose skew Spark may split."""
    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # an id may have several texts
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(len(a), dtype=bool)
            at = 0
            for first, end, values, bounds in K.shingles(batch.column("text_b"), settings.width):
                for i in range(first, end):
                    if last != (now := (a[i], batch.column("text_a")[i].as_py())):
                        last = now
                        own = next(K.shingles(batch.column("text_a").slice(i, 1), settings.width))[2]
                    other = values[bounds[i - first] : bounds[i - first + 1]]
                    spot = np.minimum(np.searchsorted(own, other), max(len(own) - 1, 0))
                    common = int(np.count_nonzero(own[spot] == other)) if len(own) else 0
                    keep[i] = common > 0 and 100 * common >= settings.percent * (len(own) + len(other) - common)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def _compare_blocks(members: DataFrame, texts: DataFrame, stage: Staging, settings: Settings) -> DataFrame:
    """Links (a, b) between components among members(bucket, rep, component), enough to join all that are linked.

    Members that hang together by buckets are a cluster, cut into blocks of about settings.block texts. A cell holds
    two blocks (or one), so a task's memory is bounded whatever the size of a cluster. In a cell, pairs of different
    components whose sketches agree are verified on full sets; a link that joins nothing new isn't returned.
    """
    stars = members.groupBy("bucket").agg(F.min("rep").alias("a"))
    cluster = connected_components(members.join(stars, "bucket").select("a", F.col("rep").alias("b")), stage)
    nodes = stage.save(members.select("rep", F.col("component").alias("own")).distinct().join(cluster.withColumnRenamed("component", "cluster"), F.col("rep") == F.col("node")).select("rep", "own", "cluster"), "nodes")
    sizes = nodes.groupBy("cluster").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("blocks"), F.min("own").alias("least"), F.max("own").alias("most"))
    placed = nodes.join(sizes.where("least <> most").select("cluster", "blocks"), "cluster").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    cells = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", F.col("rep").alias("doc_id")
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, own, block = (table.column(c).to_numpy().copy() for c in ("doc_id", "own", "block"))
        both = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        sets, coarse = [], []
        for _, _, values, bounds in K.shingles(table.column("text"), settings.width):
            coarse.append((sketch(values, bounds, settings.coordinates) >> np.uint64(8)).astype(np.uint16))
            sets += [values[bounds[k] : bounds[k + 1]] for k in range(len(bounds) - 1)]
        coarse, sizes = np.concatenate(coarse), np.array(list(map(len, sets)))
        found = []
        for x in range(len(ids)):
            near = (own != own[x]) & (np.minimum(sizes, sizes[x]) * 100 >= np.maximum(sizes, sizes[x]) * settings.percent)
            near &= (block != block[x]) if both else (np.arange(len(ids)) > x)
            near = np.flatnonzero(near)
            near = near[(coarse[near] == coarse[x]).mean(1) >= settings.agreement] if len(near) else near
            for y in near:
                if own[y] == own[x]:
                    continue
                spot = np.minimum(np.searchsorted(sets[x], sets[y]), len(sets[x]) - 1)
                common = int(np.count_nonzero(sets[x][spot] == sets[y]))
                if 100 * common >= settings.percent * (sizes[x] + sizes[y] - common):
                    found.append((ids[x], ids[y]))
                    own[own == own[y]] = own[x]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.join(texts, "doc_id").groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    stage = Staging(documents.sparkSession, "minhash")
    signed = stage.save(signatures(documents, settings), "signed")
    # classes of equal shingle sets, named by their smallest document
    classes = stage.save(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2")
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
        .select("d1", "d2", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands")),
        "classes",
    )
    texts = documents.select("doc_id", "text")
    repeated = stage.save(signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    several = not repeated.isEmpty()
    if several:  # each text of an id once, however often it is repeated
        again = texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("mark")).agg(F.first("text").alias("text"))
        texts = texts.join(repeated, "doc_id", "left_anti").unionByName(stage.save(again.select("doc_id", "text"), "texts"))
    rows = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("pivot")).where("members > 1")
    # a table, so that a bucket of many members is an ordinary skewed partition of the join, which Spark splits
    shared = stage.save(shared, "shared")
    members = stage.save(rows.join(shared, "bucket").select("bucket", "rep", "n", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "members")

    def close(x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * settings.percent

    pairs = (
        members.where((F.col("rep") != F.col("pivot")) & close("n", "pivot_n"))
        .select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    )
    tested = stage.save(pairs, "pairs")
    edges = stage.save(verify(tested, texts, settings), "links")
    component = stage.save(connected_components(edges, stage), "components")
    for turn in range(settings.turns + 1):
        placed = stage.save(
            members.join(component, members.rep == component.node, "left")
            .select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component")),
            "placed",
        )
        sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("m"), F.count("*").alias("kinds")).where("kinds > 1")
        main = stage.save(main.select("bucket", F.col("m.component").alias("main")), "main")
        members = stage.save(placed.join(main, "bucket"), "open")
        stage.drop(placed)
        if members.isEmpty():
            break
        if turn == settings.turns:
            break
        # another pivot in each bucket that still holds several components, against the other components
        chosen = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(turn)).alias("order"), "rep", "n", "component")).alias("p"))
        chosen = stage.save(chosen, "chosen")
        pairs = (
            members.join(chosen, "bucket").where((F.col("component") != F.col("p.component")) & close("n", "p.n"))
            .select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()
        )
        pairs = stage.save(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = stage.save(verify(pairs, texts, settings), "links")
        if not more.isEmpty():
            edges = edges.union(more)
            component = stage.save(connected_components(edges, stage), "components")
        tested = tested.union(pairs)
        members = members.drop("component", "main")
    if not members.isEmpty():
        # the rest: what hangs together by open buckets is compared block by block
        more = stage.save(_compare_blocks(members, texts, stage, settings), "links")
        if not more.isEmpty():
            component = stage.save(connected_components(edges.union(more), stage), "components")
    named = classes.join(component, classes.rep == component.node, "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    found = (
        signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
    )
    if several:  # what the texts of one id belong to is one group
        found = stage.save(found, "found")
        same = connected_components(found.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), stage)
        found = found.join(stage.save(same, "same"), F.col("component_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id.

    Columns of any name stay as they are. Rows that repeat an id stay or go together; null, empty and blank texts stay,
    as do rows without an id.
    """
    key = fresh(documents.columns, "kept")
    kept = near_duplicates(documents, settings).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return documents.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
