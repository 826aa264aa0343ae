"""Facts, labels, retrieval context and citations."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.functions import text as X
from noema.functions.folding import client_text, plain, search_text
from noema.operators.lineage import checkpointed
from noema.operators.relational import numbered


#: Whole texts that a Python worker holds at once to fold them.
FOLDED = 512


def merge_facts(facts: DataFrame) -> DataFrame:
    """Facts(ord, title, content, tags, passage) with equal keys become one: the first title and content, all
    passages, and the first eight different tags in order. Keys of whole texts are folded in Python, so a batch holds
    few: this stays set in the session."""
    facts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FOLDED))
    keyed = facts.withColumn("key", F.sha2(F.concat(X.identity_key(F.col("title")), F.lit("\x1f"), X.identity_key(F.col("content"))), 256))
    merged = keyed.groupBy("key").agg(
        F.min("ord").alias("first"), F.min_by("title", "ord").alias("title"), F.min_by("content", "ord").alias("content"),
        F.array_sort(F.collect_set("passage")).alias("passages"), F.count("*").alias("merged"),
    )
    # each tag by its first place, so that a key holds different tags only
    places = keyed.select("key", "ord", F.posexplode("tags").alias("place", "tag")).groupBy("key", "tag").agg(F.min(F.struct("ord", "place")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("first"))
    tags = places.withColumn("rank", rank).where("rank <= 8").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    return merged.join(tags, "key", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def _top_words(words: DataFrame, least: Column, n: int) -> DataFrame:
    """(grp, label): the n most frequent words (count desc, word) of each group with the least count or more."""
    counts = words.groupBy("grp", "word").agg(F.count("*").alias("n")).join(words.select("grp", "members").distinct(), "grp").where(F.col("n") >= least)
    window = Window.partitionBy("grp").orderBy(F.col("n").desc(), "word")
    top = counts.withColumn("r", F.row_number().over(window)).where(F.col("r") <= n)
    return top.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("words"))


def tag_labels(members: DataFrame) -> DataFrame:
    """(grp, label) from members(grp, tags): the two most frequent tags seen twice (once in a group of one)."""
    sized = members.join(members.groupBy("grp").agg(F.count("*").alias("members")), "grp")
    words = sized.select("grp", "members", F.explode("tags").alias("t")).withColumn("word", X.identity_key(F.regexp_replace(X.strip(F.col("t")), "^#", ""))).where("word <> ''")
    top = _top_words(words, F.when(F.col("members") == 1, 1).otherwise(2), 2)
    return top.select("grp", F.array_join(F.transform("words", X.capitalised), " · ").alias("label"))


def title_labels(members: DataFrame) -> DataFrame:
    """(grp, label) from members(grp, title): the three most frequent words of three letters or more."""
    found = F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}{3,}"), F.lit(0))
    words = members.select("grp", F.lit(1).alias("members"), F.explode(found).alias("word")).where(~F.col("word").isin(*X.STOP_WORDS))
    top = _top_words(words, F.lit(1), 3)
    return top.select("grp", X.capitalised(F.array_join("words", " ")).alias("label"))


def fallback_labels(groups: DataFrame, tags: DataFrame, titles: DataFrame, kinds: dict[int, str], root: str) -> DataFrame:
    """(grp, level, label) of groups(grp, level): the root's name, tags, title words, or kind and number in level."""
    placed = numbered(groups, F.col("level"), F.col("grp"))
    first = placed.groupBy("level").agg(F.min("number").alias("first"))
    kind = F.coalesce(*(F.when(F.col("level") == k, F.lit(v)) for k, v in kinds.items()), F.lit("Group"))
    named = placed.join(first, "level").withColumn("number", F.col("number") - F.col("first") + 1).join(tags.withColumnRenamed("label", "tag_label"), "grp", "left").join(titles.withColumnRenamed("label", "title_label"), "grp", "left")
    label = F.when(F.col("level") == 0, F.lit(root)).otherwise(F.coalesce("tag_label", "title_label", F.concat_ws(" ", kind, F.col("number").cast("string"))))
    return named.select("grp", "level", F.left(label, F.lit(80)).alias("label"))


def context_prefix(blocks: DataFrame, most: int, framing: int, most_blocks: int) -> DataFrame:
    """The ranked blocks(rank, block) that fit a budget, numbered K1, K2, ...: the first that overflows ends it, and
    if that is the very first it is cut. The sum of lengths only grows, so a running sum and a filter decide."""
    window = Window.orderBy("rank")
    # most_blocks rows at most reach the window, which needs them in one place
    ranked = blocks.orderBy("rank").limit(most_blocks).withColumn("place", F.row_number().over(window))
    size = F.sum(F.length("block") + 2).over(window.rowsBetween(Window.unboundedPreceding, 0)) - 2 + framing
    kept = ranked.withColumn("size", size).where((F.col("size") <= most) | ((F.col("place") == 1) & F.lit(most > framing)))
    return kept.select("rank", F.concat(F.lit("K"), F.col("place").cast("string")).alias("reference"), F.when(F.col("size") > most, X.limit_text(F.col("block"), most - framing)).otherwise(F.col("block")).alias("block"))


def citation_verdict(answer: Column, additions: Column, used: Column, allowed: Column, insufficient: Column) -> Column:
    """Why an answer's citations are refused, or 'valid'; the first failure counts."""
    inline = F.transform(X.citations(answer), F.upper)
    shape = r"^K[1-9][0-9]*$"
    return (
        F.when(F.size(F.array_except(used, allowed)) > 0, "unknown used")
        .when(F.exists(X.citations(answer), lambda t: ~t.rlike(shape)), "malformed")
        .when(F.size(F.array_except(inline, allowed)) > 0, "unknown inline")
        .when(F.size(X.citations(F.coalesce(additions, F.lit("")))) > 0, "additions cite")
        .when(insufficient & ((F.size(used) > 0) | (F.size(inline) > 0)), "insufficient cites")
        .when(~insufficient & (F.size(used) == 0), "nothing used")
        .when((F.size(F.array_except(inline, used)) > 0) | (F.size(F.array_except(used, inline)) > 0), "sets differ").otherwise("valid")
    )


def text_search(items: DataFrame, wanted: str, limit: int) -> DataFrame:
    """items(kind, id, label) that match, best first: tier, surplus length, kind, label, id."""
    asked = F.lit(plain(wanted, search_text))
    formed = items.withColumn("form", X.search_form(F.col("label")))
    scored = formed.withColumn("tier", X.search_tier(F.col("form"), asked)).where("tier is not null").withColumn("surplus", F.greatest(F.lit(0), F.length("form") - F.length(asked)))
    return scored.orderBy("tier", "surplus", "kind", "form", "id").limit(limit).drop("form")


def client_search(items: DataFrame, wanted: str, limit: int) -> DataFrame:
    """items(kind, id, label, tags) by score: 100 equal, 85 prefix, 72 word prefix, 60 inside, 48 a tag, 36 in a tag."""
    form, asked = X.client_form(F.col("label")), F.lit(re.sub(r"[\W_]+", " ", client_text(wanted)).strip())
    tags = X.client_forms(F.col("tags"))
    score = (
        F.when(form == asked, 100).when(F.startswith(form, asked), 85).when(F.exists(F.split(form, " "), lambda w: F.startswith(w, asked)), 72)
        .when(F.contains(form, asked), 60).when(F.array_contains(tags, asked), 48).when(F.exists(tags, lambda t: F.contains(t, asked)), 36)
    )
    return items.withColumn("score", score).where("score is not null").orderBy(F.col("score").desc(), "kind", "label", "id").limit(limit)


class _Costs:
    """Costs of consecutive items, and where bins that begin among them end."""

    def __init__(self, costs: np.ndarray, budget: int):
        self.budget, self.until = budget, np.cumsum(costs)
        self.before = self.until - costs
        after = np.searchsorted(self.until, self.before + budget, side="right")
        # an item too large for any bin is taken by one that is empty
        first = np.minimum(after, max(len(costs) - 1, 0))
        self.next = np.where((after < len(costs)) & (self.before[first] == self.before), after + 1, after)

    def entry(self, used: int) -> int:
        """The first item that doesn't fit in an open bin of which so much is used; the number of items if all do."""
        after = int(np.searchsorted(self.until, self.budget - used, side="right"))
        return after + 1 if not used and after < len(self.until) and not self.before[after] else after

    def starts(self, entry: int) -> list[int]:
        """All items that begin a bin, if this one does."""
        out = []
        while entry < len(self.until):
            out.append(entry)
            entry = int(self.next[entry])
        return out

    def ends(self, upto: int) -> tuple[list[int], list[int]]:
        """For each entry up to one: how much of the last bin is used in the end, and how many bins begin."""
        total = int(self.until[-1])
        used, count = [0] * (len(self.until) + 2), [0] * (len(self.until) + 2)
        for i, (n, b) in zip(range(len(self.until) - 1, -1, -1), zip(self.next[::-1].tolist(), self.before[::-1].tolist())):
            used[i], count[i] = (used[n], count[n] + 1) if n < len(self.until) else (total - b, 1)
        return used[: upto + 1], count[: upto + 1]


def bin_groups(items: DataFrame, budget: int, overhead: int) -> DataFrame:
    """(grp, ord, bin): items(grp, ord, tokens) in order; a new bin begins where the next item would exceed the budget.
    Null tokens count as 0, a null group is a group.

    Items are dealt out in ranges of group and order, so a group of any size spreads over tasks. Each range tells for every
    place at which a bin from before it may end (an item of its first bin's worth) how full its last bin gets and how many
    begin; the driver follows these from range to range, and each range numbers its items.
    """
    rows = items.select(F.col("grp").cast("string"), F.col("ord").cast("long"), (F.coalesce(F.col("tokens").cast("long"), F.lit(0)) + overhead).alias("cost"))
    placed = checkpointed(rows.repartitionByRange("grp", "ord").sortWithinPartitions("grp", "ord"))

    def whole(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray] | None:
        """A range, and where its groups begin, with the end."""
        found = [b for b in batches if b.num_rows]
        if not found:
            return None
        table = pa.Table.from_batches(found).combine_chunks()
        codes = table.column("grp").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return table, np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (own := whole(batches)) is None:
            return
        table, bounds = own
        costs, grp = table.column("cost").to_numpy(), table.column("grp")
        first, last = _Costs(costs[: bounds[1]], budget), _Costs(costs[bounds[-2] :], budget)
        upto = min(int(np.searchsorted(first.until, budget, side="right")) + 1, len(first.until) - 1)
        used, count = first.ends(upto)
        starts = last.starts(0)
        yield pa.RecordBatch.from_pylist([{
            "part": TaskContext.get().partitionId(), "first": grp[0].as_py(), "last": grp[-1].as_py(), "alone": len(bounds) == 2, "total": int(first.until[-1]),
            "until": first.until[: upto + 1].tolist(), "used": used, "count": count, "last_used": int(last.until[-1] - last.before[starts[-1]]), "last_bin": len(starts) - 1,
        }], schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("alone", pa.bool_()), ("total", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("until", "used", "count")), ("last_used", pa.int64()), ("last_bin", pa.int64())]))

    schema = "part int, first string, last string, alone boolean, total long, until array<long>, used array<long>, count array<long>, last_used long, last_bin long"
    opened: dict[int, tuple[int, int]] = {}  # by range: what is used of the bin that its first group comes with, and that bin
    before = None
    for r in sorted(placed.mapInArrow(told, schema).collect(), key=lambda r: r["part"]):
        used, number = before[1:] if before and before[0] == r["first"] else (0, -1)
        opened[r["part"]] = used, number
        if r["alone"]:
            at = 0
            if number >= 0:
                at = bisect_right(r["until"], budget - used)
                at += not used and at < len(r["until"]) and not (at and r["until"][at - 1])
            before = (r["first"], r["used"][at], number + r["count"][at]) if at < len(r["until"]) else (r["first"], used + r["total"], number)
        else:
            before = r["last"], r["last_used"], r["last_bin"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (own := whole(batches)) is None:
            return
        table, bounds = own
        costs, bins = table.column("cost").to_numpy(), np.zeros(table.num_rows, dtype=np.int64)
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            used, last = opened[TaskContext.get().partitionId()] if k == 0 else (0, -1)
            own_costs = _Costs(costs[a:b], budget)
            begun = np.zeros(b - a, dtype=np.int64)
            begun[own_costs.starts(own_costs.entry(used) if last >= 0 else 0)] = 1
            bins[a:b] = last + np.cumsum(begun)
        yield from pa.table({"grp": table.column("grp"), "ord": table.column("ord"), "bin": pa.array(bins)}).to_batches(max_chunksize=1 << 16)

    return placed.mapInArrow(number, "grp string, ord long, bin long")
