"""Exact nearest neighbours and top-k in blocks, and statistics of vector groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.operators.lineage import checkpointed

#: Rows of a block, and of it those multiplied at once: a task holds two blocks and the product of a strip with one.
BLOCK, STRIP = 16384, 64
#: So many products, and those of one row more, are put in order at once, however many of them are equal.
ORDERED = 65536
#: Of the columns of a product one in so many tells a bound that the k best reach.
SPARSE = 16


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x


def unit_vectors(vectors: DataFrame, key: str = "id", column: str = "embedding") -> DataFrame:
    """(key, u): vectors of length one in double precision; zero, null and non-finite ones are left out."""
    from noema.functions.numbers import dot, unit, usable_vector

    v = F.col(column)
    return vectors.where(usable_vector(v) & (dot(v, v) > 0)).select(key, unit(v).alias("u"))


_FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("sim", pa.float64())])


def _best(ask: tuple[np.ndarray, np.ndarray], have: tuple[np.ndarray, np.ndarray], k: int, least: float) -> Iterator[pa.RecordBatch]:
    """The k best of have (ids, vectors) for each row of ask, strip by strip; have is in order of id, which decides ties. The
    k-th best of some columns is a bound that the k best of all reach, so only few are put in order."""
    b, index = have
    step = SPARSE if len(b) >= SPARSE * k else 1
    product = np.empty((min(STRIP, len(ask[0])), len(b)))  # one for all strips
    for at in range(0, len(ask[0]), STRIP):
        a = ask[0][at : at + STRIP]
        sims = np.matmul(ask[1][at : at + STRIP], index.T, out=product[: len(a)])
        first, n = np.searchsorted(b, a), np.searchsorted(b, a, "right") - np.searchsorted(b, a)
        sims[np.repeat(np.arange(len(a)), n), np.arange(n.sum()) + np.repeat(first + n - np.cumsum(n), n)] = -np.inf  # itself
        some = sims[:, ::step]
        kth = np.partition(some, -k, axis=1)[:, -k] if k < some.shape[1] else np.full(len(a), -np.inf)
        # a margin for rounding: of similarities 1e-9 apart the smaller id wins
        good = sims >= np.maximum(kth - 2e-9, max(least, -2.0))[:, None]
        ends = np.cumsum(np.count_nonzero(good, axis=1)) // ORDERED
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(ends)) + 1):
            row, col = np.nonzero(good[part[0] : part[-1] + 1])
            row += part[0]
            order = np.lexsort((col, -np.round(sims[row, col], 9), row))
            row, col = row[order], col[order]
            starts = np.searchsorted(row, part)
            keep = np.arange(len(row)) - starts[row - part[0]] < k
            row, col = row[keep], col[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(b[col]), pa.array(sims[row, col])], schema=_FOUND)


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], bool]:
    """The first and the other rows of a cell as ids in order and vectors, and whether it is a block with itself. Batches are
    taken apart as they come, so that the cell isn't held twice."""
    parts: dict[bool, list] = {True: [], False: []}
    own = False
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("i")[0] == batch.column("j")[0] if "i" in batch.schema.names else False
        ids, x, is_first = batch.column("id").to_numpy(), _matrix(pa.chunked_array([batch.column("u")])), batch.column("is_first").to_numpy(zero_copy_only=False)
        for side, held in parts.items():
            mine = is_first == side
            if mine.any():
                held.append((ids[mine], x[mine]))
    out = []
    for held in parts.values():
        ids = np.concatenate([i for i, _ in held]) if held else np.zeros(0, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        x = np.empty((len(ids), held[0][1].shape[1] if held else 0))
        at = 0
        while held:
            _, some = held.pop(0)
            x[place[at : at + len(some)]] = some
            at += len(some)
        out.append((ids[order], x))
    return out[0], out[1], own


def _kept_best(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("id").orderBy(F.round("sim", 9).desc(), "other")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


class Regions:
    """Points of length one by their nearest pivot, and what each has still to be compared with.

    Angles obey the triangle inequality: a point at an angle t from a pivot is at least t - r away from every point of the
    pivot's region, whose points lie within r of it. Once a point knows its k best of its own region, a region that can't hold
    a better one is passed by. pivots are a bounded sample of the points, by a hash of their ids.
    """

    def __init__(self, points: DataFrame, pivots: int, block: int):
        rows = points.orderBy(F.xxhash64("id"), "id").limit(pivots).select("u").collect()  # at most `pivots` rows
        self.pivots = np.array([r["u"] for r in rows], dtype=np.float64)
        middle = self.pivots

        def place(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, STRIP):
                    batch = whole.slice(start, STRIP)
                    x = _matrix(pa.chunked_array([batch.column("u")]))
                    sims = np.clip(x @ middle.T, -1, 1)
                    at = sims.argmax(1)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array(at.astype(np.int32)), pa.array(np.arccos(sims[np.arange(len(x)), at]))], ["id", "u", "region", "angle"])

        self.points = checkpointed(points.select("id", "u").mapInArrow(place, "id long, u array<double>, region int, angle double"))
        self.sizes, self.reach = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
        for r in self.points.groupBy("region").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect():
            self.sizes[r["region"]], self.reach[r["region"]] = r["n"], r["reach"]
        self.parts = np.maximum(1, -(-self.sizes // block))

    def _parted(self) -> DataFrame:
        parts = self.points.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(self.parts)], "region int, parts int")
        return self.points.join(F.broadcast(parts), "region").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def inside(self, k: int, least: float) -> DataFrame:
        """The k best of each point in its own region."""
        rows = self._parted()
        asked = rows.select("region", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("is_first"), "id", "u")
        held = rows.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("part").alias("j"), F.lit(False).alias("is_first"), "id", "u")
        return _kept_best(asked.unionByName(held).groupBy("region", "i", "j").applyInArrow(_asking(k, least), "id long, other long, sim double"), k)

    def _may(self, found: DataFrame, k: int, least: float, emit, schema: str) -> DataFrame:
        """emit(batch, row, region) of small batches of points and the regions in which they may find better ones than found."""
        worst = found.where(F.col("rank") == k).select("id", F.col("sim").alias("worst"))
        rows = self._parted().join(worst, "id", "left").select("id", "u", "region", "part", F.greatest(F.coalesce("worst", F.lit(-2.0)), F.lit(least)).alias("worst"))
        middle, reach, filled = self.pivots, self.reach, self.sizes > 0

        def check(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, STRIP):
                    batch = whole.slice(at, STRIP)
                    x = _matrix(pa.chunked_array([batch.column("u")]))
                    away = np.arccos(np.clip(x @ middle.T, -1, 1)) - reach
                    # a margin for rounding: of similarities 1e-9 apart the smaller id wins
                    may = (np.cos(np.clip(away, 0, np.pi)) >= batch.column("worst").to_numpy()[:, None] - 2e-9) & filled
                    may[np.arange(len(x)), batch.column("region").to_numpy()] = False
                    yield emit(batch, *np.nonzero(may))

        return rows.mapInArrow(check, schema)

    def asked(self, found: DataFrame, k: int, least: float) -> np.ndarray:
        """How many points ask each region."""

        def counts(batch, row, region):
            n = np.bincount(region, minlength=1)
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0].astype(np.int64))], ["other", "n"])

        out = np.zeros(len(self.sizes), dtype=np.int64)
        for r in self._may(found, k, least, counts, "other int, n long").groupBy("other").agg(F.sum("n").alias("n")).collect():
            out[r["other"]] = r["n"]
        return out

    def open(self, found: DataFrame, k: int, least: float) -> DataFrame:
        """(id, u, region, part, other): the regions in which points may find better ones than those found."""

        def listed(batch, row, region):
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("id", "u", "region", "part")), pa.array(region.astype(np.int32))], ["id", "u", "region", "part", "other"])

        return self._may(found, k, least, listed, "id long, u array<double>, region int, part int, other int")

    def outside(self, asked: DataFrame, k: int, least: float) -> DataFrame:
        """The k best of each asked point in each of the regions asked of."""
        parts = self.points.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(self.parts)], "other int, parts int")
        left = asked.join(F.broadcast(parts), "other").select("region", "part", "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("is_first"), "id", "u")
        cells = left.select("region", "part", "other", "j").distinct()
        right = self._parted().select(F.col("region").alias("other"), F.col("part").alias("j"), "id", "u").join(cells, ["other", "j"])
        both = left.unionByName(right.select("region", "part", "other", "j", F.lit(False).alias("is_first"), "id", "u"))
        return _kept_best(both.groupBy("region", "part", "other", "j").applyInArrow(_asking(k, least), "id long, other long, sim double"), k)


def _asking(k: int, least: float):
    """A function of a cell: the k best of its held rows for its asked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, have, _ = _sides(batches)
        if len(ask[0]) and len(have[0]):
            yield from _best(ask, have, k, least)
        del ask, have
        pa.default_memory_pool().release_unused()

    return run


def nearest_by_regions(points: DataFrame, k: int, least: float = -1.0, pivots: int = 256, block: int | None = None) -> DataFrame:
    """nearest for points(id, u) of length one: products are those inside regions around pivots, and of points with regions
    that may hold a better neighbour. Exact for any points; far fewer products where they lie in clusters."""
    regions = Regions(points, pivots, block or BLOCK)
    own = checkpointed(regions.inside(k, least).select("id", "other", "sim", "rank"))
    return _with_others(regions, own, k, least)


def _with_others(regions: Regions, own: DataFrame, k: int, least: float) -> DataFrame:
    more = regions.outside(regions.open(own, k, least), k, least)
    return _kept_best(own.select("id", "other", "sim").unionByName(more.select("id", "other", "sim")), k)


def _clustered_nearest(points: DataFrame, k: int, least: float, blocks: int) -> DataFrame | None:
    """nearest_by_regions, unless that would copy points more often than blocks do: then nothing was passed by."""
    regions = Regions(points, 256, BLOCK)
    own = checkpointed(regions.inside(k, least).select("id", "other", "sim", "rank"))
    copies = int((regions.asked(own, k, least) * regions.parts).sum())
    return _with_others(regions, own, k, least) if copies <= int(regions.sizes.sum()) * blocks else None


def nearest(points: DataFrame, k: int, least: float = -1.0, key: str = "id", column: str = "u", unit: bool = False) -> DataFrame:
    """(id, other, sim, rank): the k points with the highest dot product of every point, ties by id.

    Every pair of blocks is a cell with a matrix product of its own, which leaves k rows a point of either block; a
    window over these picks the k best. The search is exact, so products grow with the square of the points; a row travels
    once for each block of all points. Of more points than a block holds, if they are said to be of length one, those go by
    regions, which pass by what can't be near; where they pass by too little, all blocks are compared.
    """
    n = points.count()
    if unit and n > BLOCK:
        points = checkpointed(points.select(F.col(key).cast("long").alias(key), F.col(column).alias(column)))
        found = _clustered_nearest(points.select(F.col(key).alias("id"), F.col(column).alias("u")), k, least, -(-n // BLOCK))
        if found is not None:
            return found
    # small tables too are cut into cells for all cores
    spread = min(math.isqrt(2 * points.sparkSession.sparkContext.defaultParallelism) + 1, -(-n // 256))
    blocks = max(1, -(-n // BLOCK), spread)
    numbered = points.select(F.col(key).alias("id"), F.col(column).alias("u")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    sides = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = sides.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("is_first"), "id", "u")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, inside = _sides(batches)
        if inside:
            yield from _best(first, first, k, least)
        elif len(first[0]) and len(second[0]):
            yield from _best(first, second, k, least)
            yield from _best(second, first, k, least)
        del first, second
        pa.default_memory_pool().release_unused()

    return _kept_best(cells.groupBy("i", "j").applyInArrow(compare, "id long, other long, sim double"), k)


def nearest_of(asked: DataFrame, points: DataFrame, k: int, least: float = -1.0, key: str = "id", column: str = "u") -> DataFrame:
    """nearest for some of the points only: products are those of asked rows with all points."""
    few, n = asked.count(), points.count()
    asks, haves = max(1, -(-few // BLOCK)), max(1, -(-n // BLOCK), min(points.sparkSession.sparkContext.defaultParallelism, -(-n // 256)))
    block = lambda frame, blocks: frame.select(F.col(key).alias("id"), F.col(column).alias("u")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = block(asked, asks).select(F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(haves - 1))).alias("j"), F.lit(True).alias("is_first"), "id", "u")
    right = block(points, haves).select(F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("i"), F.col("block").alias("j"), F.lit(False).alias("is_first"), "id", "u")

    return _kept_best(left.unionByName(right).groupBy("i", "j").applyInArrow(_asking(k, least), "id long, other long, sim double"), k)


def scored(points: DataFrame, wanted: list[float], key: str = "id", column: str = "u") -> DataFrame:
    """(id, score): the cosine of every point with one vector."""
    q = np.asarray(wanted, dtype=np.float64)
    q = q / np.linalg.norm(q)
    score = F.aggregate(F.zip_with(column, F.array(*map(F.lit, q.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return points.select(F.col(key).alias("id"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("score"))


def top_k(points: DataFrame, wanted: list[float], k: int, key: str = "id", column: str = "u") -> DataFrame:
    """(id, score): the k points of the highest cosine with one vector; a per-task top-k, then a merge of these."""
    return scored(points, wanted, key, column).orderBy(F.round("score", 9).desc(), "id").limit(k)


def mean_vectors(points: DataFrame, by: str, column: str = "u") -> DataFrame:
    """(by, members, mean): component means of each group, summed in tasks before the shuffle."""
    parts = points.select(by, F.posexplode(column).alias("at", "x")).groupBy(by, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy(by).agg(F.max("n").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))


def silhouette(points: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """One row, the mean silhouette (cosine) of points(id, by, u). The mean cosine of a point with a group is its
    product with the group's mean vector, so this costs points times groups. Singletons count 0."""
    from noema.functions.numbers import dot

    sides = points.crossJoin(F.broadcast(groups.select(F.col(by).alias("_g"), "members", "mean")))  # groups: a few by contract
    far = 1 - dot(F.col("u"), F.col("mean"))
    own = F.col(by) == F.col("_g")
    n = F.col("members")
    per = sides.select("id", own.alias("own"), n.alias("n"), F.when(own, far * n / F.nullif(n - 1, F.lit(0))).otherwise(far).alias("d"))
    ab = per.groupBy("id").agg(F.max(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.agg(F.avg(s).alias("silhouette"))
