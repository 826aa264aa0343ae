"""Column expressions for numbers, vectors, arrays and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def usable_vector(v: Column) -> Column:
    """Not null or empty, all components finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length one; null for a zero vector. The norm is an element of an array, so that it is worked out once a
    vector and not for each component."""
    scaled = F.transform(F.array(F.sqrt(dot(v, v))), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)))
    return F.get(scaled, F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 for two empty arrays."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def blended(cosine: Column, overlap: Column, weight: float) -> Column:
    return clamp((1 - weight) * cosine + weight * overlap, -1.0, 1.0)


def confidence(cosine: Column) -> Column:
    return clamp((cosine + 1) / 2, 0.0, 1.0)


def progress(done: Column, total: Column) -> Column:
    """Percent, half to even; 100 where there is nothing to do."""
    return F.when(total <= 0, F.lit(100)).otherwise(F.bround(100 * done / total).cast("int"))


def index_quantile(values: Column, q: float) -> Column:
    """The element at floor((n - 1) q) of the sorted array."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) * F.lit(q)).cast("int"))


def name_uuid(namespace_hex: str, name: Column) -> Column:
    """The version 5 UUID of a name."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    digit = F.substring(variant, (F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-5"), F.substring(raw, 14, 3), F.lit("-"),
        digit, F.substring(raw, 18, 3), F.lit("-"), F.substring(raw, 21, 12),
    )


def node_size(members: Column) -> Column:
    return clamp(8 + 1.85 * F.sqrt(members), 10.0, 26.0)


def edge_size(relations: Column) -> Column:
    return clamp(0.4 + 0.28 * F.log2(relations + 1), 0.68, 2.1)
