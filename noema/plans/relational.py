"""Queries of pages, counts, joins and integrity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from noema.functions import numbers as N
from noema.functions import text as X
from noema.functions.times import utc, utc_text
from noema.operators import relational as R
from noema.plans.registry import Tables, query



def _orders(t: Tables):
    return t.orders.select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("price"))


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias("day")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_totalprice as price from orders order by o_orderdate desc, o_orderkey desc limit 21")
def keyset_orders_first(t: Tables):
    """First page of 20, with the row that tells of a next one."""
    return R.keyset_page(_orders(t), ["o_orderdate", "o_orderkey"], 20).select("o_orderkey", _day("o_orderdate"), "price")


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_totalprice as price from orders
where o_orderdate < timestamp '1996-06-15' or (o_orderdate = timestamp '1996-06-15' and o_orderkey < 500) order by o_orderdate desc, o_orderkey desc limit 21""")
def keyset_orders_next(t: Tables):
    page = R.keyset_page(_orders(t), ["o_orderdate", "o_orderkey"], 20, after=[datetime(1996, 6, 15), 500])
    return page.select("o_orderkey", _day("o_orderdate"), "price")


@query("""select l_orderkey, l_linenumber, l_quantity from lineitem where l_suppkey = 3 and (l_orderkey < 900 or (l_orderkey = 900 and l_linenumber < 2))
order by l_orderkey desc, l_linenumber desc, l_quantity desc limit 11""")
def keyset_children(t: Tables):
    rows = t.lineitem.where("l_suppkey = 3").select("l_orderkey", "l_linenumber", "l_quantity")
    return R.keyset_page(rows, ["l_orderkey", "l_linenumber"], 10, after=[900, 2])


@query("select conv_id, turn, role from conversations where conv_id = 5 and turn > 1 order by turn limit 6")
def keyset_segments(t: Tables):
    return R.keyset_page(t.conversations.where("conv_id = 5").select("conv_id", "turn", "role"), ["turn"], 5, after=[1], descending=False)


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 77")
def point_lookup(t: Tables):
    return t.orders.where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'
order by o_totalprice desc, o_orderstatus, o_orderdate, o_orderkey limit 25""")
def conjunctive_filters(t: Tables):
    """Optional filters, a four-key order and a limit."""
    rows = t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    return rows.orderBy(F.col("o_totalprice").desc(), "o_orderstatus", "o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select event_id, user_id from events where ts <= timestamp '2024-01-05 12:00:00'")
def snapshot_cutoff(t: Tables):
    """Rows up to a job's cutoff; later ones are left to the next job."""
    return t.events.where(F.col("ts") <= F.lit("2024-01-05 12:00:00").cast("timestamp_ntz")).select("event_id", "user_id")


@query("""with top as (select * from orders order by o_orderdate desc, o_orderkey desc limit 5)
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, (select count(*) from lineitem where l_orderkey = o_orderkey) as lines,
(select count(*) from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as returned, (select count(*) from orders) as total from top""")
def dashboard_recent(t: Tables):
    """Five latest parents with child counts, and the number of all parents."""
    lines = t.lineitem.select(F.col("l_orderkey"), "l_returnflag")
    out = R.recent_with_counts(
        t.orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 5,
        {"lines": (lines, "l_orderkey"), "returned": (lines.where("l_returnflag = 'R'"), "l_orderkey")}, "o_orderkey",
    )
    return out.crossJoin(F.broadcast(t.orders.agg(F.count("*").alias("total")))).select("o_orderkey", _day("o_orderdate"), "lines", "returned", "total")


@query("select n_regionkey as parent, count(*) as children from nation group by 1")
def child_counts(t: Tables):
    return t.nation.groupBy(F.col("n_regionkey").alias("parent")).agg(F.count("*").alias("children"))


@query("""select count(*) filter (where toxic = 0) as indexed, count(*) filter (where toxic = 1) as failed,
greatest(0, (select count(*) from documents) - count(*)) as pending,
(select count(*) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)) as orphans from labels""")
def status_counts(t: Tables):
    """Indexed, failed, pending and orphaned checkpoints, in one pass over each table."""
    marks = t.labels.join(t.documents.select("doc_id", F.lit(1).alias("live")), "doc_id", "left").agg(
        F.count_if(F.col("toxic") == 0).alias("indexed"), F.count_if(F.col("toxic") == 1).alias("failed"),
        F.count_if(F.col("live").isNull()).alias("orphans"), F.count("*").alias("marks"),
    )
    docs = t.documents.agg(F.count("*").alias("docs"))
    return marks.crossJoin(F.broadcast(docs)).select("indexed", "failed", F.greatest(F.lit(0), F.col("docs") - F.col("marks")).alias("pending"), "orphans")


@query("select l_orderkey, round(coalesce(sum(case when l_returnflag = 'R' then l_quantity end), 0), 6) as returned from lineitem group by 1")
def filtered_sum(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)), 6).alias("returned"))


@query("select (coalesce(max(turn), 0) + 1)::bigint as generation from conversations")
def next_generation(t: Tables):
    return t.conversations.agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("generation"))


@query("select o_custkey, sum(case when o_orderstatus = 'X' then o_totalprice end) as nothing, round(sum(case when o_orderstatus <> 'X' then o_totalprice end), 4) as something from orders group by 1")
def sum_of_optionals(t: Tables):
    """Null if and only if all are null."""
    x = F.col("o_orderstatus") == "X"
    return t.orders.groupBy("o_custkey").agg(F.sum(F.when(x, F.col("o_totalprice"))).alias("nothing"), F.round(F.sum(F.when(~x, F.col("o_totalprice"))), 4).alias("something"))


@query("""select d.doc_id, case when l.doc_id is null then 'new' when sha256(d.text) = sha256(d.text || case when l.quality = 1 then '' else '!' end) then 'done' else 'changed' end as state
from documents d left join labels l using (doc_id)""")
def incremental_split(t: Tables):
    """Documents against the fingerprints of an earlier run (here: right for those of good quality)."""
    now = t.documents.select("doc_id", F.sha2("text", 256).alias("mark"))
    held = t.documents.join(t.labels, "doc_id").select("doc_id", F.sha2(F.concat("text", F.when(F.col("quality") == 1, "").otherwise("!")), 256).alias("mark"))
    return R.incremental_split(now, held, "doc_id", "mark").select("doc_id", "state")


@query("select doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def orphan_sweep(t: Tables):
    return R.orphans(t.labels, t.documents.where("lang = 'en'"), "doc_id").select("doc_id")


@query("""with n as (select distinct doc_id from documents), m as (select distinct doc_id from labels), p as (select distinct vec_id as doc_id from embeddings)
select 'no_mark' as violation, count(*) as rows from n where doc_id not in (from m) union all select 'no_point', count(*) from n where doc_id not in (from p)
union all select 'stray_mark', count(*) from m where doc_id not in (from n) union all select 'stray_point', count(*) from p where doc_id not in (from n)""")
def corpus_violations(t: Tables):
    return R.corpus_violations(t.documents, t.labels, t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""with n as (select doc_id, source, md5(coalesce(text, '')) as f from documents), m as (select doc_id, case when doc_id % 13 = 0 then 'pending' else 'indexed' end as status, case when doc_id % 17 = 0 then 'old' else f end as f from n where doc_id % 11 <> 0),
p as (select vec_id as doc_id, case when vec_id % 5 = 0 then 'elsewhere' else source end as source, case when vec_id % 19 = 0 then 'old' else f end as f, case when vec_id % 7 = 0 then 3 else len(embedding) end as size from embeddings left join n on vec_id = doc_id),
x as (select coalesce(n.doc_id, p.doc_id) as doc_id, case when n.doc_id is null then 'no node' when m.doc_id is null then 'no mark' when status <> 'indexed' then 'not indexed' when m.f <> n.f then 'mark is old' when p.doc_id is null then 'no point'
when p.source is distinct from n.source or n.source is null then 'other source' when p.f <> n.f then 'point is old' when size <> 64 then 'dimensions' end as fault from n left join m using (doc_id) full join p on p.doc_id = n.doc_id)
select doc_id, fault from x where fault is not null""")
def corpus_faults(t: Tables):
    """Documents, marks and vectors that disagree on source, fingerprint, status or dimensions."""
    d, v = F.col("doc_id"), F.col("vec_id")
    nodes = t.documents.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"))
    marks = nodes.where(d % 11 != 0).select("doc_id", F.when(d % 13 == 0, "pending").otherwise("indexed").alias("status"), F.when(d % 17 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    points = t.embeddings.join(nodes, v == d, "left").select(
        v.alias("doc_id"), F.when(v % 5 == 0, "elsewhere").otherwise(F.col("source")).alias("source"), F.when(v % 19 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(v % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vector"),
    )
    return R.corpus_faults(nodes, marks, points, "doc_id", 64)


@query("""with old as (select doc_id, quality as mark from labels), new as (select vec_id as doc_id, label % 2 as mark from embeddings)
select coalesce(o.doc_id, n.doc_id) as doc_id, case when n.doc_id is null then 'deleted' when o.doc_id is null then 'added' else 'mark' end as change
from old o full join new n using (doc_id) where o.doc_id is null or n.doc_id is null or o.mark is distinct from n.mark""")
def retrieval_changed(t: Tables):
    """What changed between retrieval and answer: rows that came, went or differ."""
    old, new = t.labels.select("doc_id", F.col("quality").alias("mark")), t.embeddings.select(F.col("vec_id").alias("doc_id"), (F.col("label") % 2).alias("mark"))
    return R.changes(old, new, "doc_id", "mark").select("doc_id", "change")


@query("""with e as (select distinct p_brand as tag from part where p_size < 10), w as (select distinct p_brand as tag from part)
select tag, 'existing' as origin from e union all select tag, 'created' from w where tag not in (from e)""")
def tag_get_or_create(t: Tables):
    brands = t.part.select(F.col("p_brand").alias("tag"), "p_size")
    return R.get_or_create(brands.where("p_size < 10").select("tag"), brands.select("tag"), "tag")


@query("""select coalesce(e.vec_id, l.doc_id) as vec_id, coalesce(l.quality + 100, e.label)::int as label from embeddings e full join labels l on l.doc_id = e.vec_id""")
def upsert_points(t: Tables):
    """Points by id, the last written wins."""
    rows = t.embeddings.select("vec_id", F.col("label").cast("int").alias("label"), F.lit(0).alias("version"))
    new = t.labels.select(F.col("doc_id").alias("vec_id"), (F.col("quality") + 100).cast("int").alias("label"), F.lit(0).alias("version"))
    stale = new.withColumn("label", F.lit(-1)).withColumn("version", F.lit(-1))
    return R.upsert_latest(rows, new.unionByName(stale), "vec_id").select("vec_id", "label")


@query("select vec_id, label from embeddings where vec_id in (select doc_id from labels where toxic = 1)")
def fetch_by_ids(t: Tables):
    ids = t.labels.where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return t.embeddings.select("vec_id", "label").join(ids, "vec_id", "left_semi")


@query("select vec_id, len(embedding)::int as dims, list_bool_and(list_transform(embedding, lambda x: not isnan(x) and not isinf(x))) as usable from embeddings")
def vector_checks(t: Tables):
    return t.embeddings.select("vec_id", F.size("embedding").alias("dims"), N.usable_vector(F.col("embedding")).alias("usable"))


@query("""select o.o_orderkey, count(l.l_orderkey) as lines, coalesce(string_agg(l.l_linenumber::varchar, ',' order by l.l_linenumber, l.l_partkey), '') as numbers
from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by 1""")
def eager_children(t: Tables):
    """A parent with its children as one value."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"].cast("string")), ",").alias("numbers"),
    )
    return t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("numbers", F.lit("")).alias("numbers"))


@query("""select 'quality' as rule, count(*) filter (where not (quality in (0, 1))) as rows from labels union all select 'toxic', count(*) filter (where not (toxic in (0, 1))) from labels
union all select 'clean', count(*) filter (where not (toxic = 0)) from labels""")
def constraint_violations(t: Tables):
    return R.violations({"quality": F.col("quality").isin(0, 1), "toxic": F.col("toxic").isin(0, 1), "clean": F.col("toxic") == 0}, t.labels)


@query("select l_orderkey, l_linenumber, count(*) as count from lineitem group by 1, 2 having count(*) > 1")
def unique_violations(t: Tables):
    return R.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""select 'orders.customer' as rule, count(*) as rows from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer) union all
select 'labels.german', count(*) from labels where doc_id is not null and doc_id not in (select doc_id from documents where lang = 'de') union all
select 'lineitem.line of its order', count(*) from lineitem l where not exists (select 1 from lineitem p where p.l_orderkey = l.l_orderkey and p.l_linenumber = l.l_linenumber - 1) and l_linenumber > 1""")
def foreign_violations(t: Tables):
    """Rows that name a parent that isn't there, by one key or two."""
    lines = t.lineitem.where("l_linenumber > 1").withColumn("before", F.col("l_linenumber") - 1)
    checks = {
        "orders.customer": R.dangling(t.orders, ["o_custkey"], t.customer, ["c_custkey"]),
        "labels.german": R.dangling(t.labels, ["doc_id"], t.documents.where("lang = 'de'"), ["doc_id"]),
        "lineitem.line of its order": R.dangling(lines, ["l_orderkey", "before"], t.lineitem, ["l_orderkey", "l_linenumber"]),
    }
    parts = [frame.agg(F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), "rows") for rule, frame in checks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""select doc_id as id, case when doc_id % 4 = 0 then 'failed' when doc_id % 6 = 1 then 'indexed' when length(text) % 3 = 0 then 'stale' else 'indexed' end as status from documents where text is not null and source is not null""")
def stale_embeddings(t: Tables):
    """Marks after edits: a third of the texts by length, tags of all; some nodes are gone, some were never indexed."""
    rows = t.documents.where("text is not null and source is not null").withColumnRenamed("doc_id", "id")
    marks = rows.select("id", X.fingerprint(F.col("source"), F.col("text")).alias("fingerprint"), F.when(F.col("id") % 4 == 0, "failed").otherwise("indexed").alias("status"))
    edited = F.when(F.length("text") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    nodes = rows.where("id % 6 <> 1").select("id", X.fingerprint(F.col("source"), edited).alias("fingerprint"), F.array(F.lit("new tag")).alias("tags"))
    return R.stale_marks(marks, nodes).select("id", "status")


@query("""select event_id, strftime(ts - case when event_id % 3 = 1 then interval 90 minute else interval 0 minute end, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as utc from events""")
def utc_coercion(t: Tables):
    """Points in time without an offset, with one, and in Zulu time."""
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    written = F.concat(plain, F.when(F.col("event_id") % 3 == 1, "+01:30").when(F.col("event_id") % 3 == 2, "Z").otherwise(""))
    return t.events.select("event_id", utc_text(utc(written)).alias("utc"))


@query("select 'part' as kind, p_partkey::varchar as id, p_name as label from part union all select 'nation', n_nationkey::varchar, n_name from nation")
def union_kinds(t: Tables):
    """Two sources as one typed stream."""
    parts = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"))
    return parts.unionByName(t.nation.select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label")))


@query("""with a as (select p_brand as k, p_partkey as o, p_name as v from part) select k as brand, min(o) as first_place, arg_max(v, o) as last_value from a group by 1""")
def merge_keep_last(t: Tables):
    """Keyed union: the last value at the first place."""
    return t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("first_place"), F.max_by("p_name", "p_partkey").alias("last_value"))


@query("select count(*) as orders, count(distinct o_custkey) as customers from orders")
def scalar_counts(t: Tables):
    return t.orders.agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))


@query("select doc_id, case when n_chars = 0 then 'empty' when n_chars > 4000 then 'too large' else 'ok' end as verdict from documents")
def bounded_read(t: Tables):
    return t.documents.select("doc_id", F.when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") > 4000, "too large").otherwise("ok").alias("verdict"))


@query("""select doc_id, coalesce(nullif(lang, 'de'), 'unknown') as lang, n_chars, 0::int as attempts from documents""")
def migrate_rows(t: Tables):
    """A migration as a projection: a back-fill and a new column with its default."""
    return t.documents.select("doc_id", F.coalesce(F.nullif("lang", F.lit("de")), F.lit("unknown")).alias("lang"), "n_chars", F.lit(0).alias("attempts"))
