"""Mixing sources to target weights by capped water-filling (operator 12), with DataFrame functions only.

A budget of words is shared among sources by weight. No source may give more than so many epochs of itself: a source
whose share lies above that cap is clamped to it, and what it can't give is shared again among the others by weight,
until no share lies above its cap. A round is one aggregate of the source table, and shares only grow, so a clamped
source stays clamped. If all are clamped (or the rest weighs nothing) the mix is smaller than the budget.

A source's target is taken as whole repetitions of all its documents and, for the rest, one more repetition of documents
in the order of a seeded hash of their ids, of which the last is repeated in part (its first words). So each source gives
its target to the word, or less by under one word a row where rows of one id and size meet the end of the rest together:
they share it evenly, rounded down. Where the rest ends is found by range counts over the digits of the hash: a
round sums words by source and digit and goes on in the one digit where the sum passes the rest. No task ever orders
a source's documents, so a source of any size is spread over all tasks.

Null sources are a source of their own (the last by code point); null or blank texts have size 0 and give no words.
Sources without a weight, or with one that is null or not above 0, give nothing. Repeated rows count as often as they
stand there; ids may be null. Ties need no other order than (hash, id, size), since rows equal in these are treated alike. Extra
columns are ignored by mix and kept by mixed_documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.llm.staging import Staging, fresh
from noema.operators.relational import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: The hash of an id has so many digits of so many bits.
DIGITS, BITS = 5, 12


@dataclass(frozen=True)
class Settings:
    #: Words of the mix, in percent of all words, and how often a source may be repeated at most.
    percent: int = 150
    epochs: int = 2
    seed: int = 12
    #: Source tables of so many rows at most are broadcast; larger ones are joined by shuffles.
    broadcast_rows: int = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def cyclic_weights(documents: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(source, weight): the sources by code point, null last, weigh as given, repeating."""
    places = numbered(documents.select("source").distinct(), F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    return places.select("source", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")).alias("weight"))


def water_level(sources: DataFrame, settings: Settings = Settings()) -> float | None:
    """The level L at which targets least(weight * L, epochs * size) add up to the budget, or the last one if they
    can't; None if no source has words and weight. sources: size and weight, both long."""
    rows = sources.agg(F.sum("size").cast("decimal(38,0)")).first()[0]
    budget = settings.percent * int(rows or 0)  # in hundredths of a word
    cap, level, clamped = F.col("size") * settings.epochs, None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        state = sources.where("weight > 0").agg(
            F.count_if(over).alias("clamped"), F.coalesce(F.sum(F.when(over, cap).cast("decimal(38,0)")), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~over, F.col("weight")).cast("decimal(38,0)")), F.lit(0)).alias("open"),
        ).first()
        if state["clamped"] == clamped or not state["open"]:
            return level
        clamped = state["clamped"]
        # whole numbers until here, so that the level doesn't depend on how rows lie in partitions
        level = (budget - 100 * int(state["given"])) / (100 * int(state["open"]))


def _digit(level: int) -> Column:
    return F.shiftright("hash", BITS * (DIGITS - 1 - level)).bitwiseAND(F.lit((1 << BITS) - 1))


def _keyed(source: str, name: str) -> list[Column]:
    """A source as two columns without nulls, which any join can use."""
    return [F.coalesce(F.col(source), F.lit("")).alias(f"{name}s"), F.col(source).isNull().alias(f"{name}n")]


def _plan(documents: DataFrame, weights: DataFrame, settings: Settings, stage: Staging) -> tuple[DataFrame, DataFrame, bool]:
    """Staged rows (doc_id, ks, kn, size, hash), sources with targets and where the rest ends, and whether those are few."""
    name = F.md5(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stage.save(
        documents.select("doc_id", *_keyed("source", "k"), words(F.col("text")).alias("size"), F.conv(F.substring(name, 1, 15), 16, 10).cast("long").alias("hash")), "sizes"
    )
    wanted = weights.where("weight > 0").groupBy(*_keyed("source", "k")).agg(F.sum(F.col("weight").cast("long")).alias("weight"))
    summed = rows.groupBy("ks", "kn").agg(F.sum("size").alias("size"))
    sources = stage.save(summed.join(wanted, ["ks", "kn"], "left").withColumn("weight", F.coalesce("weight", F.lit(0))), "sources")
    level = water_level(sources, settings) or 0.0
    few = sources.count() <= settings.broadcast_rows
    target = F.least(F.col("weight") * F.lit(level), (F.col("size") * settings.epochs).cast("double"))
    sources = sources.withColumn("target", F.when(F.col("size") > 0, target).otherwise(0.0))
    sources = sources.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long"))
    ends = sources.withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("size"))
    # digit by digit: 'at' is the first digits of the hash at which the rest ends, 'left' what is left of it there
    ends = ends.withColumn("at", F.lit(0).cast("long")).withColumn("left", F.col("rest"))
    for k in range(DIGITS):
        here = _near(rows, ends, few).where(F.shiftright("hash", BITS * (DIGITS - k)) == F.col("at"))
        sums = here.groupBy("ks", "kn", _digit(k).alias("digit")).agg(F.sum("size").alias("n"))
        # a row a digit and source
        before = F.coalesce(F.sum("n").over(Window.partitionBy("ks", "kn").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = sums.withColumn("before", before).join(ends.select("ks", "kn", "left"), ["ks", "kn"]).where("before <= left and left < before + n")
        found = reached.groupBy("ks", "kn").agg(F.min(F.struct("before", "digit")).alias("f"))
        # where nothing is left over within the source, the rest ends behind its last hash: all documents are repeated
        next_at = F.when(F.col("f").isNull() | (F.col("at") < 0), F.lit(-1).cast("long")).otherwise(F.shiftleft(F.col("at"), BITS) + F.col("f.digit"))
        ends = stage.save(ends.join(found, ["ks", "kn"], "left").withColumn("at", next_at).withColumn("left", F.col("left") - F.coalesce("f.before", F.lit(0))).drop("f"), "ends")
    return rows, ends, few


def _near(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with their source's columns; a source of many rows is split by adaptive execution if the table isn't small."""
    own = sources.withColumnRenamed("size", "source_size")
    return rows.join(F.broadcast(own) if few else own, ["ks", "kn"])


def mix(documents: DataFrame, weights: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, whole (repetitions of the whole text), part (words of one more).

    documents has doc_id, text and source; weights has source and weight (whole numbers).
    """
    stage = Staging(documents.sparkSession, "mixing")
    rows, ends, few = _plan(documents, weights, settings, stage)
    placed = _near(rows, ends, few)
    # rows at the very hash share what is left there in the order of id and size
    tied = placed.where(F.col("hash") == F.col("at")).groupBy("ks", "kn", "doc_id", "size").agg(F.count("*").alias("copies"), F.max("left").alias("left"))
    order = Window.partitionBy("ks", "kn").orderBy(F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
    share = F.least(F.floor((F.col("left") - F.col("before")) / F.col("copies")), F.col("size"))
    tied = stage.save(tied.select(F.col("ks").alias("_ks"), F.col("kn").alias("_kn"), F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.greatest(share, F.lit(0)).cast("long").alias("share")), "tied")
    same = (F.col("ks") == F.col("_ks")) & (F.col("kn") == F.col("_kn")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("hash") == F.col("at"))
    joined = placed.join(F.broadcast(tied) if tied.count() <= settings.broadcast_rows else tied, same, "left")
    part = F.when((F.col("at") < 0) | (F.col("hash") < F.col("at")), F.col("size")).otherwise(F.coalesce("share", F.lit(0)))
    taken = F.col("whole") * F.col("size") + part
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.when(~F.col("kn"), F.col("ks")).alias("source"), "whole", part.alias("part"))


def mixed_documents(documents: DataFrame, weights: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mix itself: each document as often as it is taken, with 'repetition' from 1; a last one in part holds the
    first words, joined by one space. Rows with equal source, id and size are taken alike."""
    names = ["doc_id", "source", "size", "whole", "part"]
    key, source, size, whole, part = (fresh(documents.columns, n) for n in names)
    at = "repetition" if "repetition" not in map(str.lower, documents.columns) else fresh(documents.columns, "repetition")
    taken = mix(documents, weights, settings).select(*(F.col(n).alias(c) for n, c in zip(names, (key, source, size, whole, part)))).distinct()
    own = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (words(F.col("text")) == F.col(size))
    many = (F.col(whole) + (F.col(part) > 0).cast("long")).cast("int")
    each = documents.join(taken, own).where(many > 0).withColumn(at, F.explode(F.sequence(F.lit(1), many)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(part).cast("int")), " ")
    text = F.when((F.col(at) > F.col(whole)) & (F.col(part) < F.col(size)), cut).otherwise(F.col("text"))
    return each.withColumn("text", text).drop(key, source, size, whole, part)
