"""Analysis of sources: passages that keep their ids, a map over them that can be resumed, and the sink of what it finds."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.functions import text as X
from noema.operators.lineage import checkpointed, written
from noema.operators.relational import get_or_create, numbered

PASSAGE = ["source", "passage", "start", "end", "text"]
#: Rows of a run's log: a call that begins ('running') and what came of it ('completed', 'failed').
LOG = "run int, id string, mark string, event string, payload string, error string"


def _placed(passages: DataFrame) -> DataFrame:
    """passages, which have a mark of their text, with their distance from the source's last place, and their number among the
    source's passages of one text. Numbers are those of a range-partitioned order, so a text that a source repeats
    without end is spread over tasks."""
    placed = numbered(passages, F.col("source"), F.col("mark"), F.col("passage"), kept=written)
    first = placed.groupBy("source", "mark").agg(F.min("number").alias("first"))
    last = passages.groupBy("source").agg(F.max("end").alias("last"))
    both = placed.join(first, ["source", "mark"]).join(last, "source")
    return both.select(*passages.columns, (F.col("last") - F.col("end")).alias("behind"), (F.col("number") - F.col("first")).alias("occurrence"))


def _named(new: DataFrame, places: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(id, row, state) of new(row, source, passage, start, end, mark), and the ids of places(id, and the same columns without a row) whose texts are
    gone; see aligned_passages. Neither table has texts."""
    at = [c for c in PASSAGE if c != "text"]
    left, right = written(_placed(new)), written(_placed(places))
    pairs = None
    for step, by in enumerate(("start", "behind", "turn")):
        if by == "turn":  # those that are left count anew
            left, right = (written(_placed(x.select(*[c for c in x.columns if c in ("id", "row", "mark", *at)]))).withColumnRenamed("occurrence", "turn") for x in (left, right))
        other = right.select("id", "source", "mark", by, *(F.col(c).alias(f"_{c}") for c in ("passage", "start", "end")))
        same = F.lit(True)
        for c in ("passage", "start", "end"):
            same = same & (F.col(c) == F.col(f"_{c}"))
        found = written(left.join(other, ["source", "mark", by]).select("id", "row", "source", "passage", F.when(same, "kept").otherwise("moved").alias("state")))
        pairs = found if pairs is None else pairs.unionByName(found)
        left = left.join(found.select("source", "passage"), ["source", "passage"], "left_anti")
        right = right.join(found.select("id"), "id", "left_anti")
    made = left.withColumn("id", F.sha2(F.concat_ws("\x1f", F.lit(version), F.col("source").cast("string"), "mark", F.col("turn").cast("string")), 256))
    return pairs.select("id", "row", "state").unionByName(made.select("id", "row", F.lit("new").alias("state"))), right.select("id")


#: Passages that can be told apart.
_WHOLE = "source is not null and text is not null"


def _rows(new: DataFrame) -> DataFrame:
    """new, written once, with a number for each row, on which its text is joined again."""
    return written(new.select(*PASSAGE, F.md5("text").alias("mark")).where(_WHOLE).withColumn("row", F.monotonically_increasing_id()))


def _places(stored: DataFrame) -> DataFrame:
    """stored with marks in place of its texts."""
    return stored.where(_WHOLE).select("id", *(F.md5(c).alias("mark") if c == "text" else c for c in PASSAGE))


def _texts(stored: DataFrame, states: DataFrame) -> DataFrame:
    """Passages of stored whose ids are in states(id, state)."""
    return stored.join(states.dropDuplicates(["id"]), "id").select("id", *PASSAGE, "state")


def aligned_passages(new: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """(id, source, passage, start, end, text, state): new(source, passage, start, end, text) with the ids of stored(id, and
    the same columns) where the text is equal.

    A text keeps its id where it stands as far from the source's beginning as before, else as far from its end, else by its
    turn among the source's passages of that text that are left. So an edit keeps all ids before and behind it. state is
    'kept', 'moved' (other place or number), 'new' (with an id made of version, source, text and turn), and 'retired' for
    stored passages whose text is gone. version names the import, so that no id is given twice. Rows without a source or text
    are left out. Texts are written once and joined once; what is placed and joined before has their marks.
    """
    rows = _rows(new)
    named, gone = _named(rows.drop("text"), _places(stored), version)
    return rows.join(named, "row").select("id", *PASSAGE, "state").unionByName(_texts(stored, gone.withColumn("state", F.lit("retired"))))


def prepared(sources: DataFrame, stored: DataFrame, known: DataFrame, cut: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """Passages of sources(source, text) as aligned_passages gives them. known(source, mark) has the marks of the texts that
    stored is of: a source whose text hasn't changed isn't cut again and keeps its passages; those of sources that are no
    more are retired. cut gives (source, passage, start, end, text) from (source, text)."""
    marked = sources.where("source is not null and text is not null").withColumn("mark", F.md5("text"))
    same = written(marked.join(known.select("source", "mark").distinct(), ["source", "mark"], "left_semi").select("source"))
    changed = marked.select("source", "text")
    if not same.isEmpty():  # else no text needs to travel
        changed = changed.join(same, "source", "left_anti")
    rows, places = _rows(cut(changed)), _places(stored)
    named, gone = _named(rows.drop("text"), places.join(same, "source", "left_anti"), version)
    kept = places.join(same, "source", "left_semi").select("id", F.lit("kept").alias("state"))
    return rows.join(named, "row").select("id", *PASSAGE, "state").unionByName(_texts(stored, kept.unionByName(gone.withColumn("state", F.lit("retired")))))


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(path)
    except Exception as error:  # no call yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LOG)


def analysis_state(passages: DataFrame, path: str, valid: Column) -> DataFrame:
    """(id, source, passage, status, attempts, payload) of passages(id, source, passage, text) by a log of calls.

    'completed' where a call of this very text gave a payload that is valid still; 'running' where a call began and nothing came
    of it, as a driver that died leaves it; 'failed' after a call that failed or gave what isn't valid; else 'pending'.
    valid is a condition on payload. attempts counts the calls of an id, whatever the text.
    """
    rows = passages.select("id", "source", "passage", F.md5("text").alias("now"))
    log = _log(passages.sparkSession, path)
    done = log.where("event = 'completed'").withColumn("good", F.coalesce(valid, F.lit(False))).where("good").groupBy("id", F.col("mark").alias("now")).agg(F.max_by("payload", "run").alias("payload"))
    tried = log.groupBy("id").agg(F.count_if(F.col("event") == "running").alias("attempts"), F.count_if(F.col("event") != "running").alias("ended"))
    status = F.when(F.col("payload").isNotNull(), "completed").when(F.col("attempts") > F.col("ended"), "running").when(F.col("attempts") > 0, "failed").otherwise("pending")
    return rows.join(done, ["id", "now"], "left").join(tried, "id", "left").select("id", "source", "passage", status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "payload")


def analysis_run(passages: DataFrame, folder: str, generate: Callable[[DataFrame], DataFrame], valid: Column, at_once: int = 1) -> DataFrame:
    """A run over passages(id, source, passage, text), and the state after it.

    What has a valid result is skipped; the rest of each source goes in order, at_once passages of every source in a wave.
    generate gives (id, payload) from a wave's (id, source, passage, text). A wave's calls are in the log before they
    begin and its results before the next wave begins, so a run that is killed loses one wave at most and its successor calls
    nothing twice that ended well. A passage without a reply or with one that isn't valid has failed: its source
    stops there, others go on, and the next run takes it up. The order is dealt out once, in files by wave, so that a
    wave reads its own rows only.
    """
    spark = passages.sparkSession
    path = f"{folder}/log"
    run = (_log(spark, path).agg(F.max("run")).first()[0] or 0) + 1
    state = analysis_state(passages, path, valid)
    todo = numbered(state.where("status <> 'completed'").select("id", "source", "passage"), F.col("source"), F.col("passage"), F.col("id"))
    first = todo.groupBy("source").agg(F.min("number").alias("first"))
    waves = todo.join(first, "source").select("id", F.floor((F.col("number") - F.col("first")) / at_once).cast("int").alias("wave"))
    queue = f"{folder}/queue-{run}"
    waves.join(passages.select("id", "source", "passage", "text"), "id").repartition("wave").write.mode("overwrite").partitionBy("wave").parquet(queue)
    queued = spark.read.schema(f"id string, source {passages.schema['source'].dataType.simpleString()}, passage {passages.schema['passage'].dataType.simpleString()}, text string, wave int").parquet(queue)
    last = queued.agg(F.max("wave")).first()[0]
    stopped = None
    for wave in range(0 if last is None else last + 1):
        own = queued.where(F.col("wave") == wave).drop("wave")
        if stopped is not None:
            own = own.join(stopped, "source", "left_anti")
        own = checkpointed(own)
        if own.isEmpty():
            break
        base = own.select(F.lit(run).alias("run"), "id", F.md5("text").alias("mark"))
        empty = F.lit(None).cast("string")
        base.select("*", F.lit("running").alias("event"), empty.alias("payload"), empty.alias("error")).write.mode("append").parquet(path)
        replies = generate(own).select("id", "payload").withColumn("good", F.coalesce(valid, F.lit(False)))
        ended = checkpointed(own.select("id", "source").join(base, "id").join(replies, "id", "left"))
        error = F.when(F.col("payload").isNull(), "no reply").when(~F.col("good"), "not valid")
        ended.select("run", "id", "mark", F.when(error.isNull(), "completed").otherwise("failed").alias("event"), "payload", error.alias("error")).write.mode("append").parquet(path)
        failed = ended.where("not coalesce(good, false)").select("source").distinct()
        stopped = checkpointed(failed if stopped is None else stopped.unionByName(failed))
    return analysis_state(passages, path, valid)


class Findings(NamedTuple):
    """Tables of one generation: nodes(node, source, title, content), tags(name, origin), node_tags(node, name),
    evidence(node, source, place, passage_id, excerpt, start, end), and refused(source, reason)."""

    nodes: DataFrame
    tags: DataFrame
    node_tags: DataFrame
    evidence: DataFrame
    refused: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return self._asdict()


def findings(facts: DataFrame, passages: DataFrame, nodes: DataFrame, tags: DataFrame) -> Findings:
    """What is to be stored of facts(source, title, content, tags, passages): nodes, their tags and evidence.

    passages(id, source, passage, start, end, text) are those of the sources. A source of which nodes(node, source) are
    stored is refused, so nothing is stored twice; so is one with a fact that names a passage that isn't there. A
    refused source gives no rows. tags(name) are those there are; names that aren't there are created once. Repeated facts of a
    source are one node, named by its source, title and content.
    """
    c = F.col
    node = F.sha2(F.concat_ws("\x1f", c("source").cast("string"), X.identity_key(c("title")), X.identity_key(c("content"))), 256)
    named = checkpointed(facts.withColumn("node", node))
    places = named.select("node", "source", F.explode("passages").alias("passage")).distinct()
    known = passages.select("source", "passage", c("id").alias("passage_id"), c("text").alias("excerpt"), "start", "end")
    missing = places.join(known.select("source", "passage"), ["source", "passage"], "left_anti").select("source").distinct()
    held = named.select("source").distinct().join(nodes.select("source"), "source", "left_semi")
    refused = checkpointed(held.withColumn("reason", F.lit("has nodes")).unionByName(missing.join(held, "source", "left_anti").withColumn("reason", F.lit("passage is missing"))))
    ready = named.join(refused.select("source"), "source", "left_anti")
    own = ready.groupBy("node", "source").agg(F.min(F.struct("title", "content")).alias("x")).select("node", "source", "x.title", "x.content")
    node_tags = ready.select("node", F.explode("tags").alias("name")).distinct()
    found = places.join(refused.select("source"), "source", "left_anti").join(known, ["source", "passage"])
    # a node's own passages, of which a fact names a few
    before = found.groupBy("node").agg(F.sort_array(F.collect_set("passage")).alias("all"))
    evidence = found.join(before, "node").select("node", "source", (F.array_position("all", c("passage")) - 1).cast("int").alias("place"), "passage_id", "excerpt", "start", "end")
    return Findings(own, get_or_create(tags, node_tags, "name"), node_tags, evidence, refused)
