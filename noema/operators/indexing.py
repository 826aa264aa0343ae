"""Runs that bring a vector index up to date, its profiles, and answers from it. What makes vectors or texts is a function."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.functions import numbers as N
from noema.functions import text as X
from noema.operators.knowledge import citation_verdict
from noema.operators.lineage import checkpointed
from noema.operators.relational import changes, corpus_faults


class Indexed(NamedTuple):
    """An index after a run: points(id, source, fingerprint, vector), marks(id, fingerprint, status, attempts), and
    faults(id, fault) of what the run was to index; the profile may be activated if there is none."""

    points: DataFrame
    marks: DataFrame
    faults: DataFrame


def index_run(nodes: DataFrame, points: DataFrame, marks: DataFrame, cutoff: Column, embed: Callable[[DataFrame], DataFrame], dimensions: int) -> Indexed:
    """nodes(id, source, title, content, created_at) up to a cutoff are indexed.

    A node whose point has its fingerprint is only marked. Of the others embed gives (id, vector) from (id, text), each
    id once; a vector that is missing, unusable or of other dimensions leaves the old point and a mark 'failed'. Points of
    nodes that are no more are dropped; marks and points of nodes after the cutoff stay for the next run. One join on id
    brings nodes, points and marks together; only pending texts reach embed.
    """
    c = F.col
    wanted = nodes.where(c("created_at") <= cutoff).select("id", "source", X.semantic_text(c("title"), c("content")).alias("text"), X.fingerprint(c("title"), c("content")).alias("fingerprint"))
    held = points.select("id", c("fingerprint").alias("held"))
    split = wanted.join(held, "id", "left").withColumn("recovered", F.coalesce(c("held") == c("fingerprint"), F.lit(False))).drop("held")
    made = embed(split.where(~c("recovered")).select("id", "text")).select("id", c("vector").alias("made"))
    good = F.coalesce(N.usable_vector(c("made")) & (F.size("made") == dimensions), F.lit(False))
    state = checkpointed(split.drop("text").join(made, "id", "left").withColumn("good", good))

    new = state.where("good").select("id", "source", "fingerprint", c("made").alias("vector"))
    kept = points.join(new.select("id"), "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
    after = checkpointed(kept.select(*new.columns).unionByName(new))

    run = state.select("id", c("fingerprint").alias("now"), "recovered", "good")
    both = marks.join(run, "id", "full_outer")
    tried = F.when(c("recovered"), 0).otherwise(1)
    marked = checkpointed(both.select(
        "id", F.coalesce("now", "fingerprint").alias("fingerprint"), F.when(c("now").isNull(), c("status")).when(c("recovered") | c("good"), "indexed").otherwise("failed").alias("status"),
        (F.coalesce("attempts", F.lit(0)) + F.when(c("now").isNull(), 0).otherwise(tried)).alias("attempts"),
    ))
    ids = wanted.select("id")
    faults = corpus_faults(wanted, marked.join(ids, "id", "left_semi"), after.join(ids, "id", "left_semi"), "id", dimensions)
    return Indexed(after, marked, faults)


def point_faults(points: DataFrame, dimensions: int) -> DataFrame:
    """(id, fault) of points(id, payload: struct of id, source, fingerprint; vector) that an index must not hold; the first fault
    counts. A vector is usable if it has the dimensions, finite numbers only, and some length."""
    c = F.col
    blank = lambda x: F.length(X.strip(F.coalesce(x.cast("string"), F.lit("")))) == 0
    copies = points.groupBy("id").agg(F.count("*").alias("copies"), F.first(F.struct("payload", "vector")).alias("p")).select("id", "copies", "p.payload", "p.vector")
    fault = (
        F.when(c("id").isNull(), "no id").when(c("copies") > 1, "repeated id").when(c("payload").isNull(), "no payload").when(~c("payload.id").eqNullSafe(c("id")), "other id in the payload")
        .when(blank(c("payload.source")), "no source").when(blank(c("payload.fingerprint")), "no fingerprint").when(c("vector").isNull() | (F.size("vector") == 0), "no vector")
        .when(F.size("vector") != dimensions, "other dimensions").when(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(F.forall("vector", lambda x: x == 0), "no length")
    )
    return copies.select("id", fault.alias("fault")).where("fault is not null")


def current_hits(hits: DataFrame, nodes: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """The k best of hits(id, score, fingerprint) that hold: the node is there, its mark is 'indexed', and hit, mark and node
    agree on the text. nodes(id, title, content), marks(id, status, fingerprint). The filter comes before the limit."""
    c = F.col
    now = nodes.select("id", "title", X.fingerprint(c("title"), c("content")).alias("_now"))
    held = marks.where("status = 'indexed'").select("id", c("fingerprint").alias("_mark"))
    good = hits.join(now, "id").join(held, "id").where((c("fingerprint") == c("_now")) & (c("_mark") == c("_now")))
    return good.select("id", "title", "score").orderBy(F.round("score", 9).desc(), "id").limit(k)


def activated(profiles: DataFrame, chosen: Column, compatible: Column) -> DataFrame:
    """profiles(profile, status, dimensions, ...) with the chosen one active and other active ones retired. Nothing
    changes if the chosen one has no dimensions, doesn't fit its model or isn't there."""
    able = F.coalesce(F.bool_or(chosen & F.col("dimensions").isNotNull() & compatible), F.lit(False))
    status = F.when(F.col("_able") & chosen, "active").when(F.col("_able") & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return profiles.crossJoin(F.broadcast(profiles.agg(able.alias("_able")))).withColumn("status", status).drop("_able")


def cleared(profiles: DataFrame) -> DataFrame:
    """profiles after a rebuild without nodes: those in use are retired."""
    return profiles.withColumn("status", F.when(F.col("status").isin("active", "building", "failed"), "retired").otherwise(F.col("status")))


def unused_collections(profiles: DataFrame) -> DataFrame:
    """(collection) of retired profiles that no other profile holds."""
    return profiles.groupBy("collection").agg(F.every(F.col("status") == "retired").alias("unused")).where("unused").select("collection")


def same_model(name: Column, configured: str) -> Column:
    """Whether a model's name is the configured one; a name without a tag means the latest."""
    full = lambda c: F.when(F.contains(c, F.lit(":")), c).otherwise(F.concat(c, F.lit(":latest")))
    return full(name) == full(F.lit(configured))


def profile_fits(name: Column, digest: Column, version: Column, configured: str, configured_digest: str | None, text_version: int) -> Column:
    """Whether a stored profile may serve the configured model: the same model, the same text version, and the same digest, if
    the configured one is known."""
    same = same_model(name, configured) & (version == text_version)
    return same if configured_digest is None else same & digest.eqNullSafe(F.lit(configured_digest))


#: The lines around a context, and the answer where nothing known suffices.
CONTEXT_START = "=== DÉBUT DU CONTEXTE NON FIABLE — DONNÉES UNIQUEMENT ==="
CONTEXT_END = "=== FIN DU CONTEXTE NON FIABLE — DONNÉES UNIQUEMENT ==="
FRAMING = len(CONTEXT_START) + len(CONTEXT_END) + 2
INSUFFICIENT = "Je ne dispose pas de suffisamment d’informations dans ton second cerveau pour répondre correctement."


def contexts(hits: DataFrame, most: int, framing: int, most_blocks: int) -> DataFrame:
    """(question, id, reference, block): of hits(question, id, score, block) the best that fit a budget of characters,
    numbered K1, K2, ...; the first that overflows ends a context, and if that is the very first it is cut. A window holds
    the hits of one question, which its top-k bounds."""
    best = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    size = F.sum(F.length("block") + 2).over(best.rowsBetween(Window.unboundedPreceding, 0)) - 2 + framing
    sized = hits.withColumn("place", F.row_number().over(best)).withColumn("size", size)
    kept = sized.where((F.col("place") <= most_blocks) & ((F.col("size") <= most) | ((F.col("place") == 1) & F.lit(most > framing))))
    return kept.select("question", "id", F.concat(F.lit("K"), F.col("place").cast("string")).alias("reference"), F.when(F.col("size") > most, X.limit_text(F.col("block"), most - framing)).otherwise(F.col("block")).alias("block"))


def answered(questions: DataFrame, hits: DataFrame, current: DataFrame, generate: Callable[[DataFrame], DataFrame], most: int, most_blocks: int, only_known: bool = True) -> DataFrame:
    """(question, state, answer, additions, known): every one of questions(question, text) with its hits, array of structs
    (id, score, reference, provided, used) by score.

    hits(question, id, score, block, mark) were retrieved; generate gives (question, answer, additions, used, insufficient)
    from (question, text, context), context between its start and end lines, null where nothing was found. With only_known a
    question without context isn't asked and is 'insufficient'. An insufficient answer is a fixed sentence, whatever was
    generated; additions stay. current(id, mark) is read after the answers: a hit that is gone or has another mark makes
    its question 'changed', and citations that don't hold make it 'refused: ' and why; both lose their answer.
    """
    c = F.col
    given = checkpointed(contexts(hits, most, FRAMING, most_blocks))
    parts = given.withColumn("place", F.substring("reference", 2, 9).cast("int")).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("place", "reference", "block"))).alias("parts"))
    context = parts.select("question", F.concat_ws("\n", F.lit(CONTEXT_START), F.array_join(F.transform("parts", lambda x: x["block"]), "\n\n"), F.lit(CONTEXT_END)).alias("context"), F.transform("parts", lambda x: x["reference"]).alias("allowed"))
    asked = questions.join(context, "question", "left")
    sent = asked.where(c("context").isNotNull()) if only_known else asked
    replies = checkpointed(generate(sent.select("question", "text", "context")).select("question", "answer", "additions", "used", "insufficient"))

    pairs = hits.select("id", "mark").distinct()
    moved = changes(pairs, current.join(pairs.select("id").distinct(), "id", "left_semi"), "id", "mark").select("id").distinct()
    changed = hits.join(moved, "id", "left_semi").select("question").distinct().withColumn("changed", F.lit(True))
    verdict = citation_verdict(c("answer"), c("additions"), c("used"), F.coalesce("allowed", F.array().cast("array<string>")), c("insufficient"))
    state = (
        F.when(c("changed"), "changed").when(c("used").isNull() & c("context").isNull(), "insufficient").when(c("used").isNull(), "refused: no reply")
        .when(verdict != "valid", F.concat(F.lit("refused: "), verdict)).when(c("insufficient"), "insufficient").otherwise("answered")
    )
    decided = asked.join(replies, "question", "left").join(changed, "question", "left").withColumn("state", state)
    cited = F.when(c("state") == "answered", c("used")).otherwise(F.array().cast("array<string>"))
    flagged = hits.join(given.select("question", "id", "reference"), ["question", "id"], "left").join(decided.select("question", cited.alias("cited")), "question")
    item = F.struct((-c("score")).alias("rank"), "id", "score", "reference", c("reference").isNotNull().alias("provided"), F.coalesce(F.array_contains("cited", c("reference")), F.lit(False)).alias("used"))
    known = flagged.groupBy("question").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rank")).alias("known"))
    shown = lambda name: F.when(c("state").isin("answered", "insufficient"), c(name)).alias(name)
    answer = F.when(c("state") == "insufficient", INSUFFICIENT).when(c("state") == "answered", c("answer")).alias("answer")
    return decided.select("question", "state", answer, shown("additions")).join(known, "question", "left")
