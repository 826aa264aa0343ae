"""Pages, counts, incremental differences and integrity, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.operators.lineage import checkpointed


def keyset_page(rows: DataFrame, keys: Sequence[str], limit: int, after: Sequence | None = None, descending: bool = True) -> DataFrame:
    """The page of limit rows after a row whose keys are given, and one more that tells if another page follows.

    The condition on the keys is an ordinary filter, so it reaches the scan; order and limit become a top-k.
    """
    if after is not None:
        past, equal = F.lit(False), F.lit(True)
        for key, value in zip(keys, after):
            c = F.col(key)
            past = past | (equal & ((c < F.lit(value)) if descending else (c > F.lit(value))))
            equal = equal & (c == F.lit(value))
        rows = rows.where(past)
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    return rows.orderBy(*order).limit(limit + 1)


def recent_with_counts(parents: DataFrame, order: Sequence[Column], limit: int, children: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """The most recent parents, each with the number of rows in the child tables (0 where there is none)."""
    top = parents.orderBy(*order).limit(limit)
    out = top
    for name, (child, foreign) in children.items():
        # the few parents restrict the child before it is grouped
        few = child.join(F.broadcast(top.select(F.col(key).alias(foreign))), foreign, "left_semi")
        counts = few.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def incremental_split(current: DataFrame, stored: DataFrame, key: str, mark: str) -> DataFrame:
    """current with state: 'done' where the store has the same mark, 'changed' where another, 'new' where none."""
    held = stored.select(F.col(key).alias("_key"), F.col(mark).alias("_mark"))
    return current.join(held, F.col(key) == F.col("_key"), "left").withColumn(
        "state", F.when(F.col("_key").isNull(), "new").when(F.col("_mark").eqNullSafe(F.col(mark)), "done").otherwise("changed")
    ).drop("_key", "_mark")


def changes(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, change): 'deleted', 'added' or 'mark' for the rows that two snapshots of one table don't share."""
    before = old.select(F.col(key).alias("_key"), F.col(mark).alias("_mark"))
    both = new.select(key, mark).join(before, F.col(key) == F.col("_key"), "full_outer")
    change = F.when(F.col(key).isNull(), "deleted").when(F.col("_key").isNull(), "added").when(~F.col("_mark").eqNullSafe(F.col(mark)), "mark")
    return both.select(F.coalesce(key, "_key").alias(key), change.alias("change")).where("change is not null")


def orphans(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is no longer live."""
    return stored.join(live.select(key), key, "left_anti")


def corpus_violations(nodes: DataFrame, marks: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """One row per way in which three tables that must agree on their keys don't, with its number of rows."""
    n, m, p = (x.select(key).distinct() for x in (nodes, marks, points))
    all_keys = (
        n.withColumn("n", F.lit(1)).join(m.withColumn("m", F.lit(1)), key, "full_outer").join(p.withColumn("p", F.lit(1)), key, "full_outer")
    )
    checks = {"no_mark": "n = 1 and m is null", "no_point": "n = 1 and p is null", "stray_mark": "m = 1 and n is null", "stray_point": "p = 1 and n is null"}
    counted = all_keys.agg(*(F.count_if(F.expr(c)).alias(k) for k, c in checks.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("violation"), F.col(k).alias("rows")) for k in checks))).alias("x")).select("x.*")


def corpus_faults(nodes: DataFrame, marks: DataFrame, points: DataFrame, key: str, dimensions: int) -> DataFrame:
    """(key, fault) of each key on which the tables don't agree; the first fault counts. nodes(key, source, fingerprint),
    marks(key, status, fingerprint), points(key, source, fingerprint, vector); a null agrees with nothing."""
    found = (
        nodes.select(key, F.struct("source", "fingerprint").alias("n"))
        .join(marks.select(key, F.struct("status", "fingerprint").alias("m")), key, "full_outer")
        .join(points.groupBy(key).agg(F.first(F.struct("source", "fingerprint", F.size("vector").alias("size"))).alias("p"), F.count("*").alias("copies")), key, "full_outer")
    )
    differ = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    c = F.col
    fault = (
        F.when(c("n").isNull(), "no node").when(c("m").isNull(), "no mark").when(differ(c("m.status"), F.lit("indexed")), "not indexed")
        .when(differ(c("m.fingerprint"), c("n.fingerprint")), "mark is old").when(c("p").isNull(), "no point").when(c("copies") > 1, "several points")
        .when(differ(c("p.source"), c("n.source")), "other source").when(differ(c("p.fingerprint"), c("n.fingerprint")), "point is old")
        .when(differ(c("p.size"), F.lit(dimensions)), "dimensions")
    )
    return found.select(key, fault.alias("fault")).where("fault is not null")


def corpus_mark(rows: DataFrame, key: str, *marks: str) -> DataFrame:
    """(rows, mark): whether two snapshots of a table are the same, whatever the order of their rows. Rows are hashed each
    (a null differs from any text), and their hashes meet in a sum and an exclusive or, which tasks combine in part."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (key, *marks)))
    half = lambda at: F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("long")
    parts = rows.select(half(1).alias("a"), F.pmod(half(16), F.lit(1_000_000_007)).cast("decimal(20,0)").alias("b")).agg(
        F.count("*").alias("rows"), F.coalesce(F.bit_xor("a"), F.lit(0)).alias("x"), F.coalesce(F.sum("b"), F.lit(0)).alias("s"),
    )
    return parts.select("rows", F.sha2(F.concat_ws(";", *(F.col(c).cast("string") for c in ("rows", "x", "s"))), 256).alias("mark"))


def numbered(rows: DataFrame, *order: Column, kept: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """rows with their 'number' from 0 in order. Numbers come from per-partition counts and offsets, not from one sorted task. kept is how rows are
    written in between."""
    # written once, since two evaluations may draw their ranges differently
    placed = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + place).drop("_id", "_part", "_before")


def upsert_latest(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union by key, the new row instead of the stored one; of new rows with one key that of the highest 'version'."""
    window = Window.partitionBy(key).orderBy(F.col("_new").desc(), F.col("version").desc())
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank", "_new")


def violations(checks: dict[str, Column], rows: DataFrame) -> DataFrame:
    """(rule, rows) of CHECK-like rules: rows for which a condition is false."""
    counted = rows.agg(*(F.count_if(~c).alias(k) for k, c in checks.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("rows")) for k in checks))).alias("x")).select("x.*")


def dangling(children: DataFrame, keys: Sequence[str], parents: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """The children whose keys, none of them null, are those of no parent."""
    held = parents.select(*(F.col(p).alias(f"_{i}") for i, p in enumerate(parent_keys))).distinct()
    whole, same = F.lit(True), F.lit(True)
    for i, k in enumerate(keys):
        whole, same = whole & F.col(k).isNotNull(), same & (F.col(k) == F.col(f"_{i}"))
    return children.where(whole).join(held, same, "left_anti")


def stale_marks(marks: DataFrame, nodes: DataFrame) -> DataFrame:
    """marks(id, fingerprint, status) after a change of nodes(id, fingerprint): 'stale' where the text that was indexed is another
    now. What isn't part of a fingerprint (tags) changes nothing; marks of nodes that are gone, or that weren't indexed, stay."""
    now = nodes.select("id", F.col("fingerprint").alias("_now"))
    changed = (F.col("status") == "indexed") & F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("fingerprint"))
    return marks.join(now, "id", "left").withColumn("status", F.when(changed, "stale").otherwise(F.col("status"))).drop("_now")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def get_or_create(existing: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """All names with origin: 'existing', or 'created' for those that were not there."""
    new = wanted.select(name).distinct().join(existing.select(name), name, "left_anti")
    return existing.select(name).distinct().withColumn("origin", F.lit("existing")).unionByName(new.withColumn("origin", F.lit("created")))
