"""Queries of passages that keep their ids, of the resumable map, and of the sink."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.operators import analysis as A
from noema.operators import chunking
from noema.operators.lineage import scratch
from noema.plans.registry import Tables, query
from noema.sources import generations


def _numbered(rows):
    """Texts of a source one after the other, each with its place in the whole."""
    order = Window.partitionBy("source").orderBy("ord")
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("source", (F.row_number().over(order) - 1).cast("int").alias("passage"), before.cast("int").alias("start"), (before + F.length("text")).cast("int").alias("end"), "text")


_PASSAGES = """raw as (select conv_id as source, turn as ord, text from conversations where text is not null),
edited as (select source, ord, case when source % 3 = 0 and ord = 1 then text || ' edited' else text end as text from raw where not (source % 3 = 1 and ord = 0)
  union all select source, 1000, text from raw where source % 5 = 0 and ord = 0),
old as (select 'p' || (source * 1000 + passage) as id, * from (select source, row_number() over w - 1 as passage, coalesce(sum(length(text) + 1) over (w rows between unbounded preceding and 1 preceding), 0) as start, text from raw window w as (partition by source order by ord))),
new as (select source, row_number() over w - 1 as passage, coalesce(sum(length(text) + 1) over (w rows between unbounded preceding and 1 preceding), 0) as start, text from edited window w as (partition by source order by ord)),
o as (select *, max(start + length(text)) over (partition by source) - start - length(text) as behind from old), n as (select *, max(start + length(text)) over (partition by source) - start - length(text) as behind from new),
s1 as (select o.id, n.source, n.passage, n.start, o.passage as was, o.start as stood from n join o on n.source = o.source and n.text = o.text and n.start = o.start),
n1 as (select * from n where (source, passage) not in (select (source, passage) from s1)), o1 as (select * from o where id not in (select id from s1)),
s2 as (select o.id, n.source, n.passage, n.start, o.passage as was, o.start as stood from n1 n join o1 o on n.source = o.source and n.text = o.text and n.behind = o.behind),
n2 as (select *, row_number() over (partition by source, text order by passage) - 1 as turn from n1 where (source, passage) not in (select (source, passage) from s2)),
o2 as (select *, row_number() over (partition by source, text order by passage) - 1 as turn from o1 where id not in (select id from s2)),
s3 as (select o.id, n.source, n.passage, n.start, o.passage as was, o.start as stood from n2 n join o2 o on n.source = o.source and n.text = o.text and n.turn = o.turn)"""


@query(f"""with {_PASSAGES} select id, source, passage::int as passage, case when passage = was and start = stood then 'kept' else 'moved' end as state from (select * from s1 union all select * from s2 union all select * from s3)
union all select sha256(concat_ws(chr(31), '2', source, md5(text), turn)), source, passage::int, 'new' from n2 where (source, passage) not in (select (source, passage) from s3)
union all select id, source, passage::int, 'retired' from o2 where id not in (select id from s3)""")
def passage_reuse(t: Tables):
    """A second import after edits in the middle, at the beginning and at the end keeps the ids of all other passages."""
    raw = t.conversations.where("text is not null").select(F.col("conv_id").alias("source"), F.col("turn").alias("ord"), "text")
    stored = _numbered(raw).withColumn("id", F.concat(F.lit("p"), (F.col("source") * 1000 + F.col("passage")).cast("string")))
    text = F.when((F.col("source") % 3 == 0) & (F.col("ord") == 1), F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    edited = raw.where("not (source % 3 = 1 and ord = 0)").withColumn("text", text).unionByName(raw.where("source % 5 = 0 and ord = 0").withColumn("ord", F.lit(1000)))
    return A.aligned_passages(_numbered(edited), stored, "2").select("id", "source", "passage", "state")


#: A stub that gives no valid result for some texts when it is first asked for them.
_BAD = 9


@query(f"""with p as (select conv_id as source, turn as passage, text, row_number() over (partition by conv_id order by turn) as place from conversations where text is not null),
bad as (select source, min(place) as first from p where length(text) % {_BAD} = 0 group by 1),
ended as (select p.*, first is null or place < first as done, place = first as failed from p left join bad using (source))
select source * 1000 + passage as id, 1 as run, case when done then 'completed' when failed then 'failed' else 'pending' end as status, case when done or failed then 1 else 0 end as attempts, case when done then md5(text) end as payload from ended
union all select source * 1000 + passage, 2, 'completed', case when coalesce(failed, false) then 2 else 1 end, md5(text) from ended""")
def analysis_resume(t: Tables):
    """A run in which sources stop at a passage that has no valid result, and one that resumes: what was completed isn't
    asked again, what failed is tried again."""
    rows = t.conversations.where("text is not null")
    passages = rows.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), F.col("conv_id").alias("source"), F.col("turn").alias("passage"), "text")
    folder, good = scratch(t.spark, "analysis"), F.length("payload") == 32
    sick = F.when(F.length("text") % _BAD == 0, "sick").otherwise(F.md5("text"))
    first = A.analysis_run(passages, folder, lambda wave: wave.select("id", sick.alias("payload")), good)
    first = A.checkpointed(first)
    second = A.analysis_run(passages, folder, lambda wave: wave.select("id", F.md5("text").alias("payload")), good)
    shown = lambda frame, run: frame.select(F.col("id").cast("long").alias("id"), F.lit(run).alias("run"), "status", F.col("attempts").cast("int").alias("attempts"), "payload")
    return shown(first, 1).unionByName(shown(second, 2))


@query(f"""with p as (select conv_id as source, turn, role, text from conversations where text is not null),
refused as (select distinct source, case when source % 5 = 0 then 'has nodes' else 'passage is missing' end as reason from p where source % 5 = 0 or source % 7 = 0),
f as (select source, role, text, turn from p where source not in (select source from refused)),
k as (select source, role, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') as k, turn from f),
e as (select distinct source, role, k, unnest([turn, (select min(turn) from p q where q.source = k.source)]) as passage from k)
select source, count(distinct (role, k)) as nodes, count(*) as evidence, count(distinct role) as tags, null as reason from e group by 1 union all select source, 0, 0, 0, reason from refused""")
def analysis_sink(t: Tables):
    """One generation of nodes, tags and evidence, without sources that have nodes or name a passage that isn't there."""
    rows = t.conversations.where("text is not null").select(F.col("conv_id").alias("source"), F.col("turn").alias("passage"), "role", "text")
    passages = rows.select(F.concat_ws("/", "source", "passage").alias("id"), "source", "passage", F.lit(0).alias("start"), F.length("text").alias("end"), "text")
    first = rows.groupBy("source").agg(F.min("passage").alias("first"))
    named = F.when(F.col("source") % 7 == 0, F.array("passage", F.lit(50000))).otherwise(F.array("passage", "first"))
    facts = rows.join(first, "source").select("source", F.col("role").alias("title"), F.col("text").alias("content"), F.array("role").alias("tags"), named.alias("passages"))
    held = rows.where("source % 5 = 0").select(F.lit("n").alias("node"), "source").distinct()
    root = scratch(t.spark, "findings")
    made = A.findings(facts, passages, held, rows.where("passage = 0").select(F.col("role").alias("name")).distinct())
    generations.publish(t.spark, made.tables(), root)
    nodes, tags, evidence, refused = (generations.read(t.spark, n, root) for n in ("nodes", "node_tags", "evidence", "refused"))
    counts = nodes.groupBy("source").agg(F.count("*").alias("nodes")).join(evidence.groupBy("source").agg(F.count("*").alias("evidence")), "source", "left")
    used = nodes.select("source", "node").join(tags, "node").groupBy("source").agg(F.count_distinct("name").alias("tags"))
    none = F.lit(0).cast("long")
    return counts.join(used, "source", "left").withColumn("reason", F.lit(None).cast("string")).unionByName(refused.select("source", none.alias("nodes"), none.alias("evidence"), none.alias("tags"), "reason"))


@query("select lang, count(*) as rows, 2 as generation, true as refused from documents group by lang")
def published_generation(t: Tables):
    """The newest of two generations; a writer that began from the first is refused."""
    root, counts = scratch(t.spark, "generations"), lambda rows: {"counts": rows.groupBy("lang").agg(F.count("*").alias("rows"))}
    generations.publish(t.spark, counts(t.documents.where("lang = 'en'")), root)
    newest = generations.publish(t.spark, counts(t.documents), root, base=1)
    try:
        generations.publish(t.spark, counts(t.documents.where("lang = 'fr'")), root, base=1)
        refused = False
    except generations.Conflict:
        refused = True
    return generations.read(t.spark, "counts", root).select("lang", "rows", F.lit(newest).alias("generation"), F.lit(refused).alias("refused"))


@query("""with d as (select doc_id, text from documents where text is not null), s as (select doc_id, md5(text) as mark, doc_id % 3 as edit from d)
select doc_id as source, edit = 0 as cut_again, true as ids_kept from s where exists (select 1 from d where d.doc_id = s.doc_id and regexp_matches(d.text, '\\S'))""")
def passage_rebuild(t: Tables):
    """A second import of all documents, a third of which have got a last paragraph: only these are cut again, and every passage
    whose text is as before keeps its id."""
    texts = t.documents.where("text is not null").select(F.col("doc_id").alias("source"), "text")
    limits = chunking.Limits(target=120, most=160)

    def cut(sources):
        made = chunking.chunk_texts(sources, limits, key="source")
        return made.select("source", "passage", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "text")

    none = t.spark.createDataFrame([], "id string, source long, passage int, start int, end int, text string")
    known = t.spark.createDataFrame([], "source long, mark string")
    stored = A.written(A.prepared(texts, none, known, cut, "1").drop("state"))
    edited = texts.withColumn("text", F.when(F.col("source") % 3 == 0, F.concat("text", F.lit("\n\nA paragraph at the end."))).otherwise(F.col("text")))
    seen = []
    made = A.prepared(edited, stored, texts.select("source", F.md5("text").alias("mark")), lambda s: seen.append(s) or cut(s), "2")
    again = A.written(made.select("source", "state", F.md5("text").alias("mark")))
    old = stored.select("source", F.md5("text").alias("mark")).distinct().withColumn("was", F.lit(True))
    lost = again.where("state = 'new'").select("source", "mark").join(old, ["source", "mark"], "left_semi").select("source").distinct().withColumn("lost", F.lit(True))
    wide = again.select("source").distinct().join(seen[0].select("source").distinct().withColumn("cut_again", F.lit(True)), "source", "left").join(lost, "source", "left")
    return wide.select("source", F.coalesce("cut_again", F.lit(False)).alias("cut_again"), F.coalesce(~F.col("lost"), F.lit(True)).alias("ids_kept"))
