"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact reranking (operator 1).

Rotations learned by iterative quantisation (Gong and Lazebnik) turn centred vectors into binary codes whose bits are
balanced and far from their thresholds. A code is cut into substrings; each is a table keyed by label and substring, and
vectors that share an entry of some table and whose codes are near are candidates (multi-index hashing; Norouzi, Punjani
and Fleet). How near two linked vectors' codes are depends on how far they lie from the centre: unit vectors of cosine c
are at most sqrt(2 - 2 c) apart, so from a centre at distance r or more they are seen under an angle of at most twice
arcsin(sqrt(2 - 2 c) / (2 r)). Vectors are therefore placed in zones by r. Each zone has a substring length and a number
of tables that follow from its angle, its size and the miss probability aimed at; a vector also stands in the zones
below, as far as a partner may lie there. Vectors of the innermost zone, where angles say nothing, and those of another
length than most are compared in full. Embeddings with a strong common direction thus cost more tables, not links.

Candidates hang together in clusters, and inside a cluster all vectors are compared by their original components in
double precision, block by block. A block pair returns how many links each vector has there, and links enough to join
what is linked; pairs are never listed. So a link is only missed if no chain of candidates joins its vectors.

The rotations are fitted on a hash sample of about sample_rows rows (a bounded, documented number); all rows are
indexed. Equal vectors of a label are one node with a multiplicity, so copies cost no comparison. Vectors that are null,
empty, zero or hold null or non-finite components, and rows with a null label, link with nothing; vectors of
different length never link. Repeated rows count as different vectors. Labels may be of any type that can be text.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.graph import connected_components
from noema.llm.staging import Staging


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.98
    sample_rows: int = 4096
    iterations: int = 15
    #: Inner distances of the zones; what lies nearer than the last is compared in full.
    zones: tuple[float, ...] = (0.65, 0.45, 0.3, 0.2)
    #: Probability aimed at that a linked pair at its zone's inner distance shares no entry, and deviations that the
    #: distance of two codes may exceed its mean by.
    miss: float = 1e-3
    deviations: float = 5.0
    #: Bits of a code that are compared, members of a table's entry in one comparison, and vectors in a block.
    compared: int = 128
    cell: int = 4096
    block: int = 1024

    @property
    def apart(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)


@dataclass
class Zone:
    number: int
    share: float  # of bits that differ at the zone's widest angle
    bits: int
    tables: int


def plan(counts: dict[int, int], settings: Settings) -> list[Zone]:
    """The zones that hold vectors; counts has the most vectors of one label by zone."""
    out = []
    for z, inner in enumerate(settings.zones):
        if not counts.get(z):
            continue
        share = 2 * math.asin(min(1.0, settings.apart / (2 * inner))) / math.pi
        tables = lambda b: math.ceil(math.log(settings.miss) / math.log(1 - (1 - share) ** b))
        # a row of a table costs about as much as comparing twenty members of an entry
        bits = min(range(6, 49), key=lambda b: tables(b) * (1 + counts[z] / 2**b / 20))
        out.append(Zone(z, share, bits, tables(bits)))
    return out


@dataclass
class Rotations:
    mean: np.ndarray
    axes: np.ndarray  # dimension by at most 64 principal axes
    turns: list[np.ndarray]  # each 64 columns

    def distances(self, unit: np.ndarray) -> np.ndarray:
        return np.linalg.norm((unit - self.mean) @ self.axes, axis=1)

    def bits(self, unit: np.ndarray) -> np.ndarray:
        flat = (unit - self.mean) @ self.axes
        return np.hstack([flat @ turn >= 0 for turn in self.turns])


def principal(unit: np.ndarray) -> Rotations:
    d = unit.shape[1]
    mean = unit.mean(0) if len(unit) else np.zeros(d)
    _, _, axes = np.linalg.svd((unit - mean).T @ (unit - mean) + 1e-9 * np.eye(d))
    return Rotations(mean, axes[:64].T, [])


def iterative_quantisation(flat: np.ndarray, seed: int, iterations: int) -> np.ndarray:
    """The rotation (or for under 64 dimensions the frame) that brings centred vectors closest to their signs."""
    k = flat.shape[1]
    turn = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((64, k)))[0].T
    for _ in range(iterations if len(flat) else 0):
        left, _, right = np.linalg.svd(flat.T @ np.where(flat @ turn >= 0, 1.0, -1.0), full_matrices=False)
        turn = left @ right
    return turn


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as unit rows in double precision, padded by zeros."""
    offs = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offs)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], sizes)] = flat[offs[0] : offs[-1]]
    out /= np.abs(out).max(1, keepdims=True)  # squares of large components stay finite
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _usable(vector: str):
    """Not null or empty, all components finite, not all zero."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & good & F.exists(vector, lambda x: x != 0)


def _combined(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def fit(vectors: DataFrame, width: int, settings: Settings) -> tuple[Rotations, np.ndarray]:
    """Centre and axes of a hash sample of vectors, and the sample on these axes."""
    share = settings.sample_rows / max(1, vectors.count())
    sample = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000) + 1).limit(2 * settings.sample_rows)
    held = sample.select("embedding").toArrow().column("embedding")
    unit = unit_rows(_combined(held), width) if len(held) else np.zeros((0, width))
    found = principal(unit)
    return found, (unit - found.mean) @ found.axes


def placed(vectors: DataFrame, rotations: Rotations, width: int, settings: Settings) -> DataFrame:
    """(label, rep, zone, lowest): the zone of every vector, and the innermost in which a partner may lie."""
    sent = vectors.sparkSession.sparkContext.broadcast(rotations)  # of the dimension's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = -np.array(settings.zones)
        for batch in batches:
            r = sent.value.distances(unit_rows(batch.column("embedding"), width))
            zone, lowest = (np.searchsorted(inner, -x, side="left").astype(np.int32) for x in (r, r - settings.apart))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rep"), pa.array(zone), pa.array(lowest)], ["label", "rep", "zone", "lowest"])

    return vectors.select("label", "rep", "embedding").mapInArrow(run, "label string, rep long, zone int, lowest int")


def entries(vectors: DataFrame, rotations: Rotations, zones: list[Zone], width: int, settings: Settings) -> DataFrame:
    """(rep, zone, c0, c1, keys): the beginning of every vector's code and its entries in the tables of its zones."""
    sent = vectors.sparkSession.sparkContext.broadcast((rotations, zones))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations, zones = sent.value
        weights = np.uint64(1) << np.arange(48, dtype=np.uint64)
        for batch in batches:
            bits = rotations.bits(unit_rows(batch.column("embedding"), width))
            code = np.packbits(bits[:, :128], axis=1, bitorder="little").view(np.int64)
            for zone in zones:
                mine = np.flatnonzero((batch.column("zone").to_numpy() <= zone.number) & (batch.column("lowest").to_numpy() >= zone.number))
                if not len(mine):
                    continue
                parts = bits[mine, : zone.bits * zone.tables].reshape(len(mine), zone.tables, zone.bits).astype(np.uint64)
                keys = (parts * weights[: zone.bits]).sum(2, dtype=np.uint64) | np.arange(zone.tables, dtype=np.uint64) << np.uint64(48)
                offs = np.arange(len(mine) + 1, dtype=np.int32) * zone.tables
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").take(pa.array(mine)), batch.column("rep").take(pa.array(mine)), pa.array(np.full(len(mine), zone.number, dtype=np.int32)),
                        pa.array(code[mine, 0]), pa.array(code[mine, 1]), pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.view(np.int64).ravel())),
                    ],
                    ["label", "rep", "zone", "c0", "c1", "keys"],
                )

    return vectors.select("label", "rep", "embedding", "zone", "lowest").mapInArrow(run, "label string, rep long, zone int, c0 long, c1 long, keys array<long>")


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of n numbers over the pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def candidates(table: DataFrame, zones: list[Zone], stage: Staging, settings: Settings) -> DataFrame:
    """(a, b): links enough to join the vectors that share an entry and whose codes are near. An entry of many members
    is met in cells of bounded size; rows come sorted by cell, so a task holds a few cells at a time."""
    rows = stage.save(table.select("rep", "zone", "c0", "c1", F.explode("keys").alias("key"), "label").withColumn("entry", F.xxhash64("label", "zone", "key")).drop("label", "key"), "entries")
    half = settings.cell // 2
    shared = rows.groupBy("entry").agg(F.count("*").alias("members")).where("members > 1")
    shared = stage.save(shared.withColumn("blocks", F.when(F.col("members") > settings.cell, F.ceil(F.col("members") / half)).otherwise(1).cast("int")), "shared")
    met = rows.join(shared.drop("members"), "entry").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = met.withColumn("other", other).withColumn("cell", F.xxhash64("entry", F.least("block", "other"), F.greatest("block", "other")))
    cells = cells.select("cell", "rep", "zone", "c0", "c1").repartition("cell").sortWithinPartitions("cell")
    bounds = np.full(len(settings.zones) + 1, -1.0)
    for z in zones:
        bounds[z.number] = settings.compared * z.share + settings.deviations * math.sqrt(settings.compared * z.share * (1 - z.share))

    def pairs(cell, rep, zone, code):
        """Spanning links of whole cells."""
        found_a, found_b = [], []
        at = np.arange(len(cell))
        for step in range(1, len(cell)):
            at = at[at + step < len(cell)]
            at = at[cell[at] == cell[at + step]]
            if not len(at):
                break
            apart = np.bitwise_count(code[at] ^ code[at + step]).sum(1)
            near = at[apart <= bounds[zone[at]]]
            found_a.append(near)
            found_b.append(near + step)
        if not found_a:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        root = _spanning(a, b, len(cell))
        linked = np.flatnonzero(root != np.arange(len(cell)))
        both = np.unique(np.stack([rep[root[linked]], rep[linked]], 1), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b = pairs(rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3:].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "rep", "zone", "c0", "c1")], 1))
            size += batch.num_rows
            if size >= 1 << 16:
                rows = np.ascontiguousarray(np.concatenate(held))
                last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # cells are sorted: the last one may go on
                if last:
                    yield out(np.ascontiguousarray(rows[:last]))
                held, size = [rows[last:]], len(rows) - last
        if size:
            yield out(np.ascontiguousarray(np.concatenate(held)))

    return cells.mapInArrow(run, "a long, b long").distinct()


def compared(clusters: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, others): for pairs of blocks of a cluster, each vector's number of links (b null), and links (others null)
    enough to join what is linked. clusters has node and component; small clusters share a block."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= settings.block).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    packs = max(1, -(-small // (settings.block // 2)))
    in_pack = F.col("n") <= settings.block
    named = clusters.join(sizes, "component").select(
        F.col("node").alias("rep"), "component", F.when(in_pack, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.col("component")).alias("place"), in_pack.alias("packed"),
        F.when(in_pack, 1).otherwise(F.ceil(F.col("n") / settings.block)).cast("int").alias("blocks"),
    ).withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    cells = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "packed", "place", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "rep"
    )

    def run(table: pa.Table) -> pa.Table:
        rep, block, component, copies = (table.column(c).to_numpy() for c in ("rep", "block", "component", "copies"))
        embedding = _combined(table.column("embedding"))
        label = _combined(table.column("label").combine_chunks().dictionary_encode()).indices.to_numpy()
        size = np.diff(embedding.offsets.to_numpy())
        unit = unit_rows(embedding, int(size.max()))
        both = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        kind = np.unique(np.stack([component, size, label], 1), axis=0, return_inverse=True)[1].ravel()
        counts, found_a, found_b = np.zeros(len(rep), dtype=np.int64), [], []
        for x in range(0, len(rep), 512):
            own = slice(x, x + 512)
            near = (unit[own] @ unit.T >= settings.cosine) & (kind[own, None] == kind) & (rep[own, None] != rep)
            if both:
                near &= block[own, None] != block
            counts[own] = near @ copies
            a, b = np.nonzero(near)
            found_a.append(a + x)
            found_b.append(b)
        root = _spanning(np.concatenate(found_a), np.concatenate(found_b), len(rep))
        some, linked = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(rep)))
        return pa.table({
            "a": pa.array(np.concatenate([rep[some], rep[root[linked]]])), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[linked])]),
            "others": pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(linked), pa.int64())]),
        })

    rows = cells.join(vectors.select("rep", "embedding", "copies", "label"), "rep")
    return rows.groupBy("packed", "place", "i", "j").applyInArrow(run, "a long, b long, others long")


def near_duplicates(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings(vec_id, embedding, label)."""
    stage = Staging(embeddings.sparkSession, "vectors")
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable("embedding"), F.lit(False))
    usable = rows.where(good)
    vectors = stage.save(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    # vec_id repeated with different vectors: each vector is a node of its own
    vectors = stage.save(vectors.withColumnRenamed("rep", "first_id").withColumn("rep", F.xxhash64("label", "embedding", "first_id")), "nodes")
    width = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = width["d"] if width else 1
    alike = vectors.where(F.size("embedding") == width)
    rotations, sample = fit(alike, width, settings)
    zoned = stage.save(placed(alike, rotations, width, settings), "placed")
    inner = len(settings.zones)
    counts = zoned.select("label", F.explode(F.sequence("zone", F.least("lowest", F.lit(inner)))).alias("zone"), (F.col("zone") == F.col("lowest")).alias("x")).groupBy("label", "zone").count()
    native = {r["zone"] for r in zoned.select("zone").distinct().collect()}
    most = {r["zone"]: r["n"] for r in counts.groupBy("zone").agg(F.max("count").alias("n")).collect() if r["zone"] in native}  # a row a zone
    zones = plan(most, settings)
    needed = max([settings.compared, *(z.bits * z.tables for z in zones)])
    rotations.turns = [iterative_quantisation(sample, seed, settings.iterations) for seed in range(-(-needed // 64))]
    table = entries(alike.join(zoned.select("rep", "zone", "lowest"), "rep"), rotations, zones, width, settings)
    near = candidates(table, zones, stage, settings)
    # the innermost zone and vectors of other lengths: compared in full, by a star around one of each label and length
    full = vectors.where(F.size("embedding") != width).select("rep", "label", F.size("embedding").alias("d")).unionByName(
        zoned.where(F.col("lowest") >= inner).select("rep", "label", F.lit(-1).alias("d")) if inner in native else zoned.limit(0).select("rep", "label", F.lit(-1).alias("d"))
    )
    centre = full.groupBy("label", "d").agg(F.min("rep").alias("a"))
    stars = full.join(centre, ["label", "d"]).select("a", F.col("rep").alias("b")).where("a <> b")
    clusters = stage.save(connected_components(near.union(stars), stage), "clusters")
    found = stage.save(compared(clusters, vectors, settings), "compared")
    names = vectors.select("rep", "first_id")
    linked = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    links = found.where("b is not null").select("a", "b")
    ids = links.join(names.toDF("a", "ia"), "a").join(names.toDF("b", "ib"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    component = stage.save(connected_components(ids, stage), "components")
    nodes = (
        vectors.join(linked, F.col("rep") == F.col("node"), "left").drop("node")
        .join(component, F.col("first_id") == F.col("node"), "left")
        .select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component_id"))
    )
    nodes = stage.save(nodes, "results")
    # rows that link with nothing would share the join key null: they pass by the join
    joined = usable.join(nodes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
