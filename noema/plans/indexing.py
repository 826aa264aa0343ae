"""Queries of index runs, profiles and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from noema.functions import text as X
from noema.operators import indexing as I
from noema.operators import jobs as J
from noema.operators import relational as R
from noema.operators import similarity
from noema.plans.registry import Tables, query
from noema.plans.texts import _STRIP, _TITLE, _sql


def _run(t: Tables):
    d, v = F.col("doc_id"), F.col("vec_id")
    rows = t.documents.where("text is not null and source is not null and doc_id is not null")
    nodes = rows.select(d.alias("id"), "source", F.col("source").alias("title"), F.col("text").alias("content"), d.alias("created_at"))
    now = nodes.select("id", "source", X.fingerprint(F.col("title"), F.col("content")).alias("fingerprint"))
    points = t.embeddings.join(now, v == F.col("id"), "left").where("vec_id % 4 <> 1").select(
        v.alias("id"), F.coalesce("source", F.lit("gone")).alias("source"), F.when(v % 3 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.col("embedding").alias("vector"),
    )
    marks = now.where("id % 5 < 3").select("id", F.lit("old").alias("fingerprint"), F.when(F.col("id") % 5 == 0, "failed").otherwise("indexed").alias("status"), F.lit(1).alias("attempts"))

    def embed(texts):
        bad = F.when(F.col("id") % 29 == 0, F.array(F.lit(float("nan")), *[F.lit(1.0)] * 63)).when(F.col("id") % 31 == 0, F.array(F.lit(1.0)))
        return texts.where("id % 37 <> 0").select("id", F.coalesce(bad, F.array_repeat(F.lit(0.5), 64)).alias("vector"))

    return I.index_run(nodes, points.withColumn("vector", F.col("vector").cast("array<double>")), marks, F.lit(900), embed, 64)


_RUN = f"""n as (select doc_id as id, source, sha256({_sql(_STRIP, 'source')} || chr(10) || chr(10) || {_sql(_STRIP, 'text')}) as f from documents where text is not null and source is not null and doc_id is not null),
p as (select vec_id as id, coalesce(source, 'gone') as source, case when vec_id % 3 = 0 then 'old' else f end as f from embeddings left join n on vec_id = id where vec_id % 4 <> 1),
m as (select id, case when id % 5 = 0 then 'failed' else 'indexed' end as status from n where id % 5 < 3),
s as (select n.id, n.source, n.f, coalesce(p.f = n.f, false) as rec, p.id is not null as has, n.id % 29 <> 0 and n.id % 31 <> 0 and n.id % 37 <> 0 as good from n left join p using (id) where n.id <= 900)"""


@query(f"""with {_RUN} select n.id, coalesce(s.f, case when m.id is not null then 'old' end) as fingerprint, case when s.id is null then m.status when rec or good then 'indexed' else 'failed' end as status,
(case when m.id is null then 0 else 1 end + case when s.id is null or rec then 0 else 1 end)::int as attempts from n left join m using (id) left join s using (id) where s.id is not null or m.id is not null""")
def index_marks(t: Tables):
    """Marks after a run: recovered, embedded, failed, and left to the next run."""
    return _run(t).marks


@query(f"""with {_RUN} select n.id, n.source, coalesce(case when not rec and good then s.f end, p.f) as fingerprint, not coalesce(rec, true) and coalesce(good, false) as new from n left join p using (id) left join s using (id)
where p.id is not null or (not rec and good)""")
def index_points(t: Tables):
    """Points after a run: new ones, kept ones, none of nodes that are gone."""
    return _run(t).points.select("id", "source", "fingerprint", (F.col("vector")[0] == 0.5).alias("new"))


@query(f"with {_RUN} select id, 'not indexed' as fault from s where not rec and not good")
def index_faults(t: Tables):
    """What keeps the index of a run from being activated."""
    return _run(t).faults


_FORM = f"n as (select doc_id as id, source as title, sha256({_sql(_STRIP, 'source')} || chr(10) || chr(10) || {_sql(_STRIP, 'text')}) as f, length(text) as n from documents where text is not null and source is not null and doc_id is not null)"


@query(f"""with {_FORM}, h as (select b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a, embeddings b where a.vec_id = 7)
select id, title, round(score, 6) as score from h join n using (id) where n.n % 5 <> 0 and n.n % 7 <> 0 and n.n % 4 <> 1 order by round(score, 9) desc, id limit 10""")
def search_hits(t: Tables):
    """The best hits whose node, mark and point agree on the text: some points and some marks are of an older text, some
    marks aren't 'indexed', some nodes are gone."""
    rows = t.documents.where("text is not null and source is not null and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.length("text").alias("n"))
    now = rows.select("id", "n", X.fingerprint(F.col("title"), F.col("content")).alias("now"))
    wanted = [float(x) for x in t.embeddings.where("vec_id = 7").first()["embedding"]]
    points = similarity.unit_vectors(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"))
    hits = similarity.scored(points, wanted).join(now, "id", "left").select("id", "score", F.when(F.col("n") % 5 == 0, "old").otherwise(F.col("now")).alias("fingerprint"))
    marks = now.select("id", F.when(F.col("n") % 7 == 0, "failed").otherwise("indexed").alias("status"), F.when(F.col("n") % 4 == 1, "old").otherwise(F.col("now")).alias("fingerprint"))
    return I.current_hits(hits, rows, marks, 10).select("id", "title", F.round("score", 6).alias("score"))


@query("""with d as (select doc_id, source, md5(text) as f, length(text) as n from documents), p as (select vec_id as id, source, f, coalesce(n, 0) as n from embeddings left join d on vec_id = doc_id)
select id, case when n % 11 = 1 then 'repeated id' when n % 13 = 1 then 'other id in the payload' when source is null then 'no source' when n % 7 = 1 then 'no fingerprint' when n % 5 = 1 then 'other dimensions' when n % 3 = 1 then 'not finite' when n % 4 = 1 then 'no length' end as fault
from p where n % 11 = 1 or n % 13 = 1 or source is null or n % 7 = 1 or n % 5 = 1 or n % 3 = 1 or n % 4 = 1""")
def point_faults(t: Tables):
    """What an index must not hold: points damaged by the length of their text, and those whose document is gone."""
    d = t.documents.select(F.col("doc_id").alias("id"), "source", F.md5("text").alias("f"), F.length("text").alias("n"))
    p = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).join(d, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n")
    vector = F.when(n % 5 == 1, F.slice("v", 1, 3)).when(n % 3 == 1, F.concat(F.slice("v", 2, 63), F.array(F.lit(float("nan"))))).when(n % 4 == 1, F.array_repeat(F.lit(0.0), 64)).otherwise(F.col("v"))
    own = F.when(n % 13 == 1, F.col("id") + 1).otherwise(F.col("id")).alias("id")
    points = p.select("id", F.struct(own, "source", F.when(n % 7 == 1, " ").otherwise(F.coalesce("f", F.lit("none"))).alias("fingerprint")).alias("payload"), vector.alias("vector"), n.alias("n"))
    return I.point_faults(points.unionByName(points.where("n % 11 = 1")).drop("n"), 64)


_PROFILES = "p as (select c_custkey as profile, case c_custkey % 4 when 0 then 'active' when 1 then 'building' when 2 then 'retired' else 'failed' end as status, case when c_custkey % 3 <> 0 then 64 end as dimensions, 'g' || (c_custkey // 3) as collection from customer)"


def _profiles(t: Tables):
    k = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("active", "building", "retired", "failed"))), (k % 4 + 1).cast("int"))
    return t.customer.select(k.alias("profile"), status.alias("status"), F.when(k % 3 != 0, 64).alias("dimensions"), F.concat(F.lit("g"), F.floor(k / 3).cast("string")).alias("collection"))


@query(f"""with {_PROFILES} select 'fits' as round, profile, case when profile = 13 then 'active' when status = 'active' then 'retired' else status end as status from p
union all select 'lacks dimensions', profile, status from p union all select 'cleared', profile, 'retired' from p""")
def profile_activation(t: Tables):
    """A profile that may become active, one that may not, and a rebuild without nodes."""
    p = _profiles(t)
    chosen = lambda n: I.activated(p, F.col("profile") == n, F.lit(True))
    rounds = {"fits": chosen(13), "lacks dimensions": chosen(9), "cleared": I.cleared(p)}
    parts = [frame.select(F.lit(name).alias("round"), "profile", "status") for name, frame in rounds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"with {_PROFILES} select collection from p group by 1 having bool_and(profile <> 13 and status in ('active', 'retired'))")
def retired_collections(t: Tables):
    """Collections that may be dropped once profile 13 is active."""
    return I.unused_collections(I.activated(_profiles(t), F.col("profile") == 13, F.lit(True)))


@query(f"""with h as (select conv_id as question, turn, conv_id * 100 + turn as id, text, {_sql(_STRIP, 'text')} as c from conversations where conv_id % 9 <> 0), s as (select *, row_number() over (partition by question order by turn, id) as place, sum(length(text) + 2) over (partition by question order by turn, id rows unbounded preceding) - 2 + 114 as size from h),
g as (select *, place <= 4 and (size <= 900 or place = 1) as given, case when size <= 900 then text when length(c) <= 786 then c else regexp_replace(left(c, 785), '[\\s\\p{{Z}}]+$', '') || '…' end as block from s),
q as (select question, sum(given::int) as n, '=== DÉBUT DU CONTEXTE NON FIABLE — DONNÉES UNIQUEMENT ===' || chr(10) || string_agg(block, chr(10) || chr(10) order by place) filter (given) || chr(10) || '=== FIN DU CONTEXTE NON FIABLE — DONNÉES UNIQUEMENT ===' as context from g group by 1),
d as (select conv_id as question, case when q.question is null then 'insufficient' when conv_id % 7 = 0 then 'changed' when conv_id % 5 = 0 then 'refused: unknown used' when conv_id % 8 = 0 then 'insufficient' when conv_id % 11 = 0 then 'refused: no reply' else 'answered' end as state, n, context from (select distinct conv_id from conversations) left join q on conv_id = question)
select question, state, case when state = 'answered' then 'so [K1]' when state = 'insufficient' then 'Je ne dispose pas de suffisamment d’informations dans ton second cerveau pour répondre correctement.' end as answer,
case when state in ('answered', 'insufficient') and n is not null then length(context) || ' ' || md5(context) end as additions, coalesce(known, '') as known from d left join (select question, string_agg(id || ':' || case when given then 'K' || place else '-' end || case when given and place = 1 and state = 'answered' then '+' else '' end, ',' order by place) as known
from g join d using (question) group by 1) using (question)""")
def answer_run(t: Tables):
    """Questions answered from their hits by a stub: answers that hold, cite what isn't there, know too little, are missing,
    or whose facts have changed meanwhile. The additions tell of the context that was sent."""
    rows = t.conversations.select(F.col("conv_id").alias("question"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", "text")
    questions = rows.select("question").distinct().withColumn("text", F.lit("what?"))
    hits = rows.where("question % 9 <> 0").select("question", "id", (1 / (F.col("turn") + 1)).alias("score"), F.col("text").alias("block"), F.md5("text").alias("mark"))
    current = rows.select("id", F.when((F.col("question") % 7 == 0) & (F.col("turn") == 0), "new").otherwise(F.md5("text")).alias("mark"))

    def generate(asked):
        q = F.col("question")
        used = F.when(q % 5 == 0, F.array(F.lit("K99"))).when(q % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("K1")))
        return asked.where((q % 11 != 0) | (q % 5 == 0) | (q % 8 == 0)).select(q, F.when(q % 8 == 0, "unclear").otherwise("so [K1]").alias("answer"), F.concat_ws(" ", F.length("context").cast("string"), F.md5("context")).alias("additions"), used.alias("used"), (q % 8 == 0).alias("insufficient"))

    out = I.answered(questions, hits, current, generate, 900, 4)
    shown = F.transform("known", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.coalesce(x["reference"], F.lit("-")), F.when(x["used"], "+").otherwise("")))
    return out.select("question", "state", "answer", "additions", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("known"))


@query("""with j as (select event_id as job_id, user_id as target, case when event_id % 2 = 0 then 'index' else 'rebuild' end as kind, case when event_id % 7 = 0 then 'pending' when event_id % 3 = 0 then 'failed' else 'succeeded' end as status, ts from events where user_id % 3 <> 0),
h as (select target, arg_max(struct_pack(id := job_id, k := kind), struct_pack(t := ts, i := job_id)) filter (where status = 'pending') as o, bool_or(status = 'succeeded') as done from j group by 1),
r as (select distinct user_id as target from events)
select target, case when o.k = 'index' then 'already queued' when o is not null then 'busy' when done then 'already done' else 'enqueued' end as outcome, case when o.k = 'index' then o.id end as job_id from r left join h using (target)""")
def enqueue_outcomes(t: Tables):
    e = F.col("event_id")
    status = F.when(e % 7 == 0, "pending").when(e % 3 == 0, "failed").otherwise("succeeded")
    jobs = t.events.where("user_id % 3 <> 0").select(e.alias("job_id"), F.col("user_id").alias("target"), F.when(e % 2 == 0, "index").otherwise("rebuild").alias("kind"), status.alias("status"), F.col("ts").alias("created_at"))
    requests = t.events.select(F.col("user_id").alias("target")).distinct().select(F.col("target").alias("request_id"), "target", F.lit("index").alias("kind"))
    return J.enqueued(requests, jobs).select("target", "outcome", "job_id")


@query("""select event_id as job_id, event_type as kind, greatest(0, event_id % 5 - 1)::int as attempt, greatest(0, value - 10)::double as seconds, case event_id % 3 when 1 then repeat('x', 50) when 2 then 'd' || event_id end as diagnostic from events""")
def call_rows(t: Tables):
    e = F.col("event_id")
    said = F.when(e % 3 == 0, "  ").when(e % 3 == 1, F.repeat(F.lit("x"), F.lit(60))).otherwise(F.concat(F.lit(" d"), e.cast("string"), F.lit(" ")))
    calls = t.events.select(e.alias("job_id"), F.col("event_type").alias("kind"), (e % 5 - 1).cast("int").alias("attempt"), (F.col("value") - 10).alias("seconds"), F.lit(1).alias("tokens"), F.lit("ok").alias("outcome"), said.alias("diagnostic"))
    return J.call_rows(calls, 50).drop("tokens", "outcome")


@query("""with h as (select md5(concat_ws(chr(31), coalesce('=' || doc_id, ''), coalesce('=' || source, ''), coalesce('=' || md5(text), ''))) as h from documents),
a as (select count(*) as rows, coalesce(bit_xor(('0x' || substr(h, 1, 15))::bigint), 0) as x, coalesce(sum(('0x' || substr(h, 16, 15))::bigint % 1000000007), 0)::hugeint as s from h) select rows, sha256(rows || ';' || x || ';' || s) as mark from a""")
def corpus_fingerprint(t: Tables):
    """One mark of all documents, by which a graph knows that its input has changed."""
    return R.corpus_mark(t.documents.withColumn("mark", F.md5("text")), "doc_id", "source", "mark")


@query(f"""select d.doc_id as id, {_TITLE} as title, case when length(c) <= 180 then c else regexp_replace(left(c, 179), '[\\s\\p{{Z}}]+$', '') || '…' end as excerpt, coalesce(d.source, 'deleted source') as source, coalesce(l.quality, -1)::int as quality, case when l.doc_id is null then 'pending' else 'indexed' end as status
from (select *, {_sql(_STRIP, 'text')} as c from documents) d left join (select doc_id, min(quality) as quality from labels group by 1) l using (doc_id)""")
def node_summaries(t: Tables):
    """Nodes as they are listed: title, excerpt, source and state."""
    marks = t.labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.lit(True).alias("held"))
    return t.documents.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("id"), X.derived_title(F.col("text")).alias("title"), X.limit_text(F.col("text"), 180).alias("excerpt"), F.coalesce("source", F.lit("deleted source")).alias("source"),
        F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), F.when(F.col("held"), "indexed").otherwise("pending").alias("status"),
    )
