"""Queries of the job log, decisions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.functions import numbers as N
from noema.operators import jobs as J
from noema.operators.relational import numbered
from noema.plans.registry import Tables, query

_JOBS = """j as (select event_id as job_id, ts as created_at, case when event_type = 'error' then 'failed' when event_id % 5 = 0 then 'pending' when event_id % 5 = 1 then 'running' else 'succeeded' end as status,
(event_id % 3)::int as attempt, value as seconds, try_cast(json_extract_string(props, '$.k') as bigint) as tokens, user_id, event_type from events)"""


def _jobs(t: Tables):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 5 == 0, "pending").when(F.col("event_id") % 5 == 1, "running").otherwise("succeeded")
    return t.events.select(
        F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), status.alias("status"), (F.col("event_id") % 3).cast("int").alias("attempt"),
        F.col("value").alias("seconds"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), "user_id", "event_type",
    )


@query(f"""with {_JOBS} select user_id, count(*) as calls, count(*) filter (where attempt > 0) as retries_by_attempt, count(*) filter (where event_type = 'error') as retries_by_outcome,
coalesce(sum(round_even(seconds * 1000, 0)::bigint), 0)::bigint as rounded_ms, coalesce(sum(greatest(0, trunc(seconds * 1000)::bigint)), 0)::bigint as whole_ms, coalesce(sum(tokens), 0)::bigint as tokens from j group by 1""")
def job_metrics(t: Tables):
    calls = _jobs(t).withColumn("outcome", F.when(F.col("event_type") == "error", "validation_retry").otherwise("ok"))
    return J.call_metrics(calls, "user_id")


@query(f"with {_JOBS} select user_id, round(max(epoch_us(created_at)) / 1e6::double - min(epoch_us(created_at)) / 1e6::double, 3) as duration, round(sum(seconds) / nullif(count(*) filter (where attempt > 0), 0), 6) as per_retry from j group by 1")
def job_latency(t: Tables):
    """Duration of each job and seconds a retry; null where there is no retry."""
    at = F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    return _jobs(t).groupBy("user_id").agg(
        F.round(F.max(at) - F.min(at), 3).alias("duration"), F.round(F.sum("seconds") / F.nullif(F.count_if(F.col("attempt") > 0), F.lit(0)), 6).alias("per_retry")
    )


@query(f"with {_JOBS} select job_id, status = 'running' and created_at <= timestamp '2024-01-15 00:00:00' - interval 120 second as stale from j")
def stale_jobs(t: Tables):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return _jobs(t).select("job_id", J.is_stale(F.col("status"), F.col("created_at"), now, 120).alias("stale"))


@query(f"with {_JOBS} select job_id, 'running' as status, attempt + 1 as attempt from j where status = 'pending' order by created_at, job_id limit 1")
def job_claim(t: Tables):
    return J.claim_next(_jobs(t)).select("job_id", "status", "attempt")


@query(f"with {_JOBS} select user_id, job_id, status from j qualify row_number() over (partition by user_id order by case status when 'running' then 0 when 'pending' then 1 else 2 end, created_at desc, job_id desc) = 1")
def latest_job(t: Tables):
    """The usable job of each user: running before pending before others, then the newest."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "pending", 1).otherwise(2)
    window = Window.partitionBy("user_id").orderBy(rank, F.col("created_at").desc(), F.col("job_id").desc())
    return _jobs(t).withColumn("r", F.row_number().over(window)).where("r = 1").select("user_id", "job_id", "status")


@query("""with g as (select event_id, user_id, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) >= 7200000000 then 1 else 0 end as cut, ts from events)
select event_id, user_id, sum(cut) over (partition by user_id order by ts, event_id)::bigint as segment from g""")
def gap_segments(t: Tables):
    events = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return J.gap_segments(events, "user_id", "at", 7200).select("event_id", "user_id", "segment")


@query(f"with {_JOBS} select job_id, case when status <> 'running' then status when seconds >= 50 then 'succeeded' else 'pending' end as status from j")
def crash_recovery(t: Tables):
    rows = _jobs(t)
    return J.recovered(rows, rows.where("seconds >= 50").select("job_id")).select("job_id", "status")


@query("""with r as (select event_id as request_id, user_id || ':' || event_type as key, ts as created_at from events), f as (select *, first_value(request_id) over (partition by key order by created_at, request_id) as job_id from r)
select request_id, job_id, case when job_id = request_id then 'enqueued' else 'already queued' end as outcome from f""")
def enqueue_once(t: Tables):
    requests = t.events.select(F.col("event_id").alias("request_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").alias("created_at"))
    return J.enqueue_once(requests).select("request_id", "job_id", "outcome")


@query("""select event_id, case event_id % 6 when 0 then 'timeout' when 1 then 'unreachable' when 2 then 'missing model' when 3 then 'http' when 4 then 'corrupt' else 'invalid reply' end as kind from events""")
def failure_kinds(t: Tables):
    said = F.array(*map(F.lit, ("Request timed out", "Connection refused", "model x not found", "HTTP 503", "store is corrupt", "what?")))
    return t.events.select("event_id", J.failure_kind(F.element_at(said, (F.col("event_id") % 6 + 1).cast("int"))).alias("kind"))


@query("select user_id, count(*) as events, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_activity from events group by 1")
def heartbeats(t: Tables):
    return t.events.groupBy("user_id").agg(F.count("*").alias("events"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_activity"))


@query("select event_id, (case when event_id % 4 = 0 then 100 else round_even(100.0::double * (event_id % 7) / (event_id % 4 * 8), 0) end)::int as percent from events")
def progress_percent(t: Tables):
    return t.events.select("event_id", N.progress((F.col("event_id") % 7).cast("double"), F.col("event_id") % 4 * 8).alias("percent"))


_FACTS = "f as (select event_id, event_id % 9 as nodes, event_id % 2 = 0 as has_active, event_id % 3 = 0 as has_building, event_id % 5 <> 0 as building_compatible, event_id % 7 = 0 as building_error, event_id % 11 = 0 as job_running, event_id % 13 <> 0 as active_compatible, event_id % 17 <> 0 as store_readable, event_id % 19 <> 0 as store_up, event_id % 23 as pending, 0 as failed, event_id % 2 as orphans from events)"


@query(f"""with {_FACTS} select event_id, case when nodes = 0 and not has_active and not has_building then 'empty' when not has_active then case when has_building and not building_compatible then 'incompatible' when job_running then 'building'
when has_building and building_error then 'stale' when has_building then 'building' else 'not_built' end when not active_compatible then case when job_running then 'building' else 'incompatible' end when not store_readable then 'corrupt' when not store_up then 'unavailable'
when job_running then 'building' when pending > 0 or failed > 0 or orphans > 0 then 'stale' else 'ready' end as state from f""")
def index_status(t: Tables):
    """All branches of the decision on an index's state, over synthetic facts."""
    e = F.col("event_id")
    facts = t.events.select(
        "event_id", (e % 9).alias("nodes"), (e % 2 == 0).alias("has_active"), (e % 3 == 0).alias("has_building"), (e % 5 != 0).alias("building_compatible"), (e % 7 == 0).alias("building_error"),
        (e % 11 == 0).alias("job_running"), (e % 13 != 0).alias("active_compatible"), (e % 17 != 0).alias("store_readable"), (e % 19 != 0).alias("store_up"), (e % 23).alias("pending"), F.lit(0).alias("failed"), (e % 2).alias("orphans"),
    )
    return J.index_status(facts).select("event_id", "state")


@query("""with n as (select o_orderkey as id, o_custkey as owner from orders where o_totalprice > 100000 and o_orderkey % 10 > 0), m as (select l_orderkey as id, o_custkey as owner, case when min(struct_pack(a := l_linenumber, q := l_quantity)).q > 48 then 'failed' when min(struct_pack(a := l_linenumber, q := l_quantity)).q > 46 then 'pending' else 'indexed' end as status from lineitem join orders on l_orderkey = o_orderkey where o_totalprice > 100000 group by 1, 2),
b as (select coalesce(n.owner, m.owner) as owner, count(n.id) as nodes, count(*) filter (where n.id is not null and coalesce(status, 'pending') = 'pending') as pending, count(*) filter (where n.id is not null and status = 'failed') as failed, count(*) filter (where n.id is null) as orphans from n full join m using (id) group by 1),
j as (select user_id as owner, arg_max(event_type, struct_pack(t := ts, i := event_id)) = 'signup' as running from events group by 1),
f as (select c_custkey as owner, coalesce(nodes, 0) as nodes, coalesce(pending, 0) as pending, coalesce(failed, 0) as failed, coalesce(orphans, 0) as orphans, c_mktsegment in ('MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD') as live, c_mktsegment in ('BUILDING', 'HOUSEHOLD') as made, c_acctbal > 2000 as fits, c_acctbal < 4000 as error, coalesce(running, false) as running
from customer left join b on b.owner = c_custkey left join j on j.owner = c_custkey)
select owner, nodes, pending, failed, orphans, case when nodes = 0 and not live and not made then 'empty' when not live and made and not fits then 'incompatible' when not live and running then 'building' when not live and made and error then 'stale' when not live and made then 'building'
when not live then 'not_built' when not fits and running then 'building' when not fits then 'incompatible' when running then 'building' when pending + failed + orphans > 0 then 'stale' else 'ready' end as state from f""")
def owner_index_states(t: Tables):
    """The state of each customer's index, from their orders as nodes, first lines as marks, segments as profiles and last
    events as jobs."""
    large = t.orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.struct("l_linenumber", "l_quantity")).alias("m")).select("id", F.col("m.l_quantity").alias("q"))
    marks = large.join(first, "id").select("id", "owner", F.when(F.col("q") > 48, "failed").when(F.col("q") > 46, "pending").otherwise("indexed").alias("status"))
    last = t.events.groupBy(F.col("user_id").alias("owner")).agg((F.max_by("event_type", F.struct("ts", "event_id")) == "signup").alias("running"))
    segment, own = F.col("c_mktsegment"), [F.col("c_custkey").alias("owner")]
    rows = t.customer.select(*own, segment, (F.col("c_acctbal") > 2000).alias("compatible"), (F.col("c_acctbal") < 4000).alias("error"))
    live = rows.where(segment.isin("MACHINERY", "AUTOMOBILE", "HOUSEHOLD")).withColumn("status", F.lit("active"))
    made = rows.where(segment.isin("BUILDING", "HOUSEHOLD")).withColumn("status", F.lit("building"))
    facts = J.index_facts(t.customer.select(*own), large.where("id % 10 > 0"), marks, last, live.unionByName(made))
    up = F.lit(True)
    return J.index_status(facts.withColumn("store_readable", up).withColumn("store_up", up)).select("owner", "nodes", "pending", "failed", "orphans", "state")


@query("""with f as (select event_id as e from events), s as (select e, concat_ws(', ', case when e % 2 = 0 then 'no embedding profile' end, case when e % 3 = 0 then 'embedding profile changed' end, case when e % 5 = 0 then 'input changed' end,
case when e % 7 = 0 then 'parameters changed' end, case when e % 11 = 0 then 'vectors not ready' end) as reasons from f)
select e as event_id, reasons, case when e % 13 = 0 or e % 17 = 0 then 'building' when e % 19 = 0 and e % 2 = 0 then 'empty' when e % 11 = 0 then 'vector_index_required' when e % 23 = 0 then case when e % 4 = 1 then 'error' else 'not_built' end when reasons <> '' then 'stale' else 'ready' end as state from s""")
def graph_status(t: Tables):
    e = F.col("event_id")
    facts = t.events.select(
        "event_id", (e % 13 == 0).alias("job_running"), (e % 17 == 0).alias("has_building"), (e % 19).alias("nodes"), (e % 2 != 0).alias("has_embedding_profile"), (e % 3 == 0).alias("profile_changed"),
        (e % 5 == 0).alias("input_changed"), (e % 7 == 0).alias("parameters_changed"), (e % 11 != 0).alias("vectors_ready"), (e % 23 != 0).alias("has_profile"), (e % 4 == 1).alias("latest_failed"),
    )
    return J.graph_status(facts).select("event_id", "reasons", "state")


@query("""with e as (select event_id as job_id, event_type <> 'error' as ok, event_id % 7 <> 0 as stored, case event_id % 3 when 0 then '   ' when 1 then repeat('x', 5000) else ' failed ' || event_id || ' ' end as message,
case when event_id % 2 = 1 then repeat('d', 4500) end as detail, repeat('stage' || event_id % 4, 20) as stage, (event_id % 100)::int as percent from events), f as (select *, ok and stored as good, case when ok then 'result was not stored' else coalesce(nullif(left(trim(message), 4000), ''), 'job failed') end as said from e)
select job_id, case when good then 'succeeded' else 'failed' end as status, case when good then 'completed' else 'failed' end as stage, case when good then 100 else percent end as percent, case when not good then said end as error_message,
case when not good then coalesce(case when not ok then left(detail, 4000) end, said) end as error_detail, case when not good then left(stage, 64) end as error_stage from f""")
def job_finish(t: Tables):
    """How jobs end: stored results, results that were lost, failures with blank, long and short texts."""
    e = F.col("event_id")
    text = e.cast("string")
    jobs = t.events.select(e.alias("job_id"), F.repeat(F.concat(F.lit("stage"), (e % 4).cast("string")), F.lit(20)).alias("stage"), (e % 100).cast("int").alias("percent"))
    message = F.when(e % 3 == 0, "   ").when(e % 3 == 1, F.repeat(F.lit("x"), F.lit(5000))).otherwise(F.concat(F.lit(" failed "), text, F.lit(" ")))
    ends = t.events.select(e.alias("job_id"), (F.col("event_type") != "error").alias("ok"), (e % 7 != 0).alias("stored"), message.alias("message"), F.when(e % 2 == 1, F.repeat(F.lit("d"), F.lit(4500))).alias("detail"))
    return J.finished(jobs, ends, "job failed", "result was not stored")


@query("""with l as (select *, row_number() over (order by quality desc, doc_id) - 1 as r from labels) select doc_id, r // 12 as batch from l""")
def label_batches(t: Tables):
    """Batches of twelve in order."""
    placed = numbered(t.labels.select("doc_id", "quality"), F.col("quality").desc(), F.col("doc_id"))
    return placed.select("doc_id", F.floor(F.col("number") / 12).alias("batch"))
