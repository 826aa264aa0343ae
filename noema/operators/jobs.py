"""Operators over a durable job log: claims, heartbeats, metrics and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def claim_next(jobs: DataFrame) -> DataFrame:
    """The oldest pending job, as it is after the claim."""
    return jobs.where("status = 'pending'").orderBy("created_at", "job_id").limit(1).withColumn("status", F.lit("running")).withColumn("attempt", F.col("attempt") + 1)


def is_stale(status: Column, last_activity: Column, now: Column, seconds: int) -> Column:
    return (status == "running") & (last_activity <= now - F.make_dt_interval(secs=F.lit(seconds)))


def recovered(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """After a crash: a running job whose output exists has succeeded, any other goes back to pending."""
    done = finished.select(F.col("job_id").alias("_done")).distinct()
    return jobs.join(done, F.col("job_id") == F.col("_done"), "left").withColumn(
        "status",
        F.when(F.col("status") != "running", F.col("status")).when(F.col("_done").isNotNull(), "succeeded").otherwise("pending"),
    ).drop("_done")


def finished(jobs: DataFrame, ends: DataFrame, default: str, unstored: str) -> DataFrame:
    """jobs(job_id, stage, percent) after ends(job_id, ok, stored, message, detail): a job has succeeded only if its result
    is stored. A failed one keeps its percent, names the stage it failed in, and its texts are cut to their columns."""
    c = F.col
    good = c("ok") & c("stored")
    # texts are cut, and dropped where the job went well, before they travel to the join
    texts = ends.select(
        "job_id", "ok", "stored", F.when(~F.coalesce("ok", F.lit(False)), F.nullif(F.left(F.trim("message"), F.lit(4000)), F.lit(""))).alias("message"),
        F.when(~c("ok"), F.nullif(F.left(F.trim("detail"), F.lit(4000)), F.lit(""))).alias("detail"),
    )
    said = F.when(c("ok"), F.lit(unstored)).otherwise(F.coalesce("message", F.lit(default)))
    few = jobs.select("job_id", F.left("stage", F.lit(64)).alias("stage"), "percent").hint("shuffle_hash")  # short rows, one a job: no text is sorted
    return few.join(texts, "job_id").select(
        "job_id", F.when(good, "succeeded").otherwise("failed").alias("status"), F.when(good, "completed").otherwise("failed").alias("stage"),
        F.when(good, 100).otherwise(c("percent")).alias("percent"), F.when(~good, said).alias("error_message"),
        F.when(~good, F.coalesce("detail", said)).alias("error_detail"), F.when(~good, c("stage")).alias("error_stage"),
    )


def enqueue_once(requests: DataFrame) -> DataFrame:
    """Of requests with one key the first in time is enqueued; the others get its id and say so."""
    window = Window.partitionBy("key").orderBy("created_at", "request_id")
    return requests.withColumn("job_id", F.first("request_id").over(window)).withColumn(
        "outcome", F.when(F.col("job_id") == F.col("request_id"), "enqueued").otherwise("already queued")
    )


def enqueued(requests: DataFrame, jobs: DataFrame, once: bool = True) -> DataFrame:
    """requests(request_id, target, kind) with what comes of each, given jobs(job_id, target, kind, status, created_at): the
    newest job of the target that isn't over is returned ('already queued') or, being of another kind, stands in the way
    ('busy'); a target whose job has succeeded is 'already done' if it may be done only once."""
    c = F.col
    open_job, over = c("status").isin("pending", "running"), c("status") == "succeeded"
    order = F.struct("created_at", "job_id")
    held = jobs.groupBy("target").agg(
        F.max(F.when(open_job, F.struct(order.alias("o"), "job_id", c("kind").alias("held")))).alias("open"),
        F.coalesce(F.bool_or(over), F.lit(False)).alias("done"),
    )
    outcome = (
        F.when(c("open.held") == c("kind"), "already queued").when(c("open").isNotNull(), "busy")
        .when(c("done") & F.lit(once), "already done").otherwise("enqueued")
    )
    return requests.join(held, "target", "left").withColumn("outcome", outcome).withColumn("job_id", F.when(c("outcome") == "already queued", c("open.job_id"))).drop("open", "done")


def call_metrics(calls: DataFrame, by: str) -> DataFrame:
    """Calls, retries by either rule, milliseconds and tokens of each job. Nulls count as nothing."""
    return calls.groupBy(by).agg(
        F.count("*").alias("calls"), F.count_if(F.col("attempt") > 0).alias("retries_by_attempt"),
        F.count_if(F.col("outcome") == "validation_retry").alias("retries_by_outcome"),
        F.coalesce(F.sum(F.bround(F.col("seconds") * 1000).cast("long")), F.lit(0)).alias("rounded_ms"),
        F.coalesce(F.sum(F.greatest(F.lit(0), (F.col("seconds") * 1000).cast("long"))), F.lit(0)).alias("whole_ms"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )


def call_rows(calls: DataFrame, most: int = 1000) -> DataFrame:
    """calls(job_id, kind, attempt, seconds, tokens, outcome, diagnostic) as rows of the log: nothing below zero, a blank
    diagnostic null, a long one cut."""
    text = F.nullif(F.trim("diagnostic"), F.lit(""))
    return calls.select("job_id", "kind", F.greatest(F.lit(0), "attempt").alias("attempt"), F.greatest(F.lit(0.0), "seconds").alias("seconds"), "tokens", "outcome", F.left(text, F.lit(most)).alias("diagnostic"))


def gap_segments(events: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """events with the number of the segment they are in: a new one begins after a pause of at least the gap."""
    window = Window.partitionBy(by).orderBy(at, "event_id")
    pause = F.unix_micros(at) - F.unix_micros(F.lag(at).over(window))
    return events.withColumn("segment", F.sum(F.when(pause >= gap_seconds * 1_000_000, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def failure_kind(message: Column) -> Column:
    """What a failure is, by its message."""
    text = F.lower(message)
    return (
        F.when(text.rlike("timed? ?out"), "timeout").when(text.rlike("refused|unreachable|connect"), "unreachable")
        .when(text.rlike("model .*not found|no such model"), "missing model").when(text.rlike("http [45][0-9][0-9]"), "http")
        .when(text.rlike("corrupt|malformed"), "corrupt").otherwise("invalid reply")
    )


def index_facts(owners: DataFrame, nodes: DataFrame, marks: DataFrame, jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The facts from which index_status decides, for every one of owners(owner): from nodes(id, owner), marks(id, owner, status),
    jobs(owner, running) and profiles(owner, status, compatible, error). A node without a mark is pending, a mark without a
    node an orphan; only marks of nodes there are count as failed. Whether the store answers is for the caller to add."""
    c = F.col
    both = nodes.select("id", "owner", F.lit(1).alias("node")).join(marks.select("id", c("owner").alias("_owner"), c("status").alias("mark")), "id", "full_outer")
    sums = both.groupBy(F.coalesce("owner", "_owner").alias("owner")).agg(
        F.count("node").alias("nodes"), F.count_if(c("node").isNotNull() & (c("mark").isNull() | ~c("mark").isin("indexed", "failed"))).alias("pending"),
        F.count_if(c("node").isNotNull() & (c("mark") == "failed")).alias("failed"), F.count_if(c("node").isNull()).alias("orphans"),
    )
    live, made = c("status") == "active", c("status") == "building"
    held = profiles.groupBy("owner").agg(
        F.bool_or(live).alias("has_active"), F.bool_or(made).alias("has_building"), F.bool_or(live & c("compatible")).alias("active_compatible"),
        F.bool_or(made & c("compatible")).alias("building_compatible"), F.bool_or(made & c("error")).alias("building_error"),
    )
    busy = jobs.groupBy("owner").agg(F.bool_or("running").alias("job_running"))
    wide = owners.select("owner").distinct().join(sums, "owner", "left").join(held, "owner", "left").join(busy, "owner", "left")
    counts, flags = ["nodes", "pending", "failed", "orphans"], ["has_active", "has_building", "active_compatible", "building_compatible", "building_error", "job_running"]
    return wide.select("owner", *(F.coalesce(n, F.lit(0)).alias(n) for n in counts), *(F.coalesce(n, F.lit(False)).alias(n) for n in flags))


def index_status(facts: DataFrame) -> DataFrame:
    """facts with the state of a vector index; the first rule that holds decides."""
    c = F.col
    return facts.withColumn(
        "state",
        F.when((c("nodes") == 0) & ~c("has_active") & ~c("has_building"), "empty")
        .when(~c("has_active") & c("has_building") & ~c("building_compatible"), "incompatible")
        .when(~c("has_active") & c("job_running"), "building").when(~c("has_active") & c("has_building") & c("building_error"), "stale")
        .when(~c("has_active") & c("has_building"), "building").when(~c("has_active"), "not_built")
        .when(~c("active_compatible") & c("job_running"), "building").when(~c("active_compatible"), "incompatible")
        .when(~c("store_readable"), "corrupt").when(~c("store_up"), "unavailable").when(c("job_running"), "building")
        .when((c("pending") > 0) | (c("failed") > 0) | (c("orphans") > 0), "stale").otherwise("ready"),
    )


def graph_status(facts: DataFrame) -> DataFrame:
    """facts with the state of a graph and the reasons why it is stale, in order."""
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(~c("has_embedding_profile"), "no embedding profile"), F.when(c("profile_changed"), "embedding profile changed"),
        F.when(c("input_changed"), "input changed"), F.when(c("parameters_changed"), "parameters changed"), F.when(~c("vectors_ready"), "vectors not ready"),
    ))
    return facts.withColumn("reasons", F.array_join(reasons, ", ")).withColumn(
        "state",
        F.when(c("job_running") | c("has_building"), "building").when((c("nodes") == 0) & ~c("has_embedding_profile"), "empty")
        .when(~c("vectors_ready"), "vector_index_required").when(~c("has_profile") & c("latest_failed"), "error")
        .when(~c("has_profile"), "not_built").when(F.size(reasons) > 0, "stale").otherwise("ready"),
    )
