"""Queries of text functions, search, labels, context and citations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.functions import numbers as N
from noema.functions import text as X
from noema.functions.canonical import canonical_row
from noema.operators import chunking, knowledge
from noema.operators.lineage import checkpointed
from noema.plans.registry import Tables, query
from noema.sources import subtitles

# pieces of SQL that several oracles share
_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
_KEY = r"replace(lower(regexp_replace(" + _STRIP + r", '[\s\p{{Z}}]+', ' ', 'g')), 'ß', 'ss')"
_FORM = "translate(" + _KEY + f", '{X.ACCENTED}', '{X.PLAIN}')"


def _sql(form: str, column: str) -> str:
    return form.format(column)


@query(f"""with s as (select doc_id, {_sql(_STRIP, 'text')} as core from documents)
select doc_id, case when length(core) = 0 then 0 else greatest(1, ceil(greatest(length(core) / 4.0::double,
len(regexp_extract_all(core, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]')) * 1.25::double)))::bigint end as tokens from s""")
def token_estimate(t: Tables):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(f"select doc_id, sha256({_sql(_STRIP, 'source')} || chr(10) || chr(10) || {_sql(_STRIP, 'text')}) as mark from documents")
def semantic_fingerprint(t: Tables):
    return t.documents.select("doc_id", X.fingerprint(F.col("source"), F.col("text")).alias("mark"))


_TITLE = f"""(select case when length(l) <= 120 then l else regexp_replace(left(l, 119), '[\\s\\p{{Z}}]+$', '') || '…' end from (select coalesce(
list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\f]'), lambda x: {_sql(_STRIP, 'x')}), lambda x: length(x) > 0)[1], 'Untitled note') as l))"""


@query(f"select doc_id, {_TITLE} as title from documents")
def derive_title(t: Tables):
    return t.documents.select("doc_id", X.derived_title(F.col("text")).alias("title"))


@query(f"""select doc_id, case when length(c) <= 200 then c else regexp_replace(left(c, 199), '[\\s\\p{{Z}}]+$', '') || '…' end as excerpt
from (select doc_id, {_sql(_STRIP, 'text')} as c from documents)""")
def limit_text(t: Tables):
    return t.documents.select("doc_id", X.limit_text(F.col("text"), 200).alias("excerpt"))


@query(f"select item_id, regexp_replace({_sql(_STRIP, 'text')}, '[\\s\\p{{Z}}]+', ' ', 'g') as question, length(regexp_replace({_sql(_STRIP, 'text')}, '[\\s\\p{{Z}}]+', ' ', 'g')) between 2 and 2000 as accepted from benchmark")
def normalize_question(t: Tables):
    q = X.collapse(F.col("text"))
    return t.benchmark.select("item_id", q.alias("question"), F.length(q).between(2, 2000).alias("accepted"))


@query(f"""with x as (select doc_id, unnest(['#' || lang, ' ' || upper(source) || ' ', lang, 'a#b', '']) as raw, unnest([1,2,3,4,5]) as i from documents),
c as (select doc_id, i, regexp_replace({_sql(_STRIP, 'raw')}, '^#', '') as raw from x), k as (select doc_id, i, {_sql(_KEY, 'raw')} as tag from c)
select doc_id, string_agg(tag, ',' order by i) as tags from (select doc_id, tag, min(i) as i from k where length(tag) between 1 and 40 and not contains(tag, '#') group by 1, 2) group by 1""")
def tag_normalize(t: Tables):
    raw = F.array(F.concat(F.lit("#"), "lang"), F.concat(F.lit(" "), F.upper("source"), F.lit(" ")), "lang", F.lit("a#b"), F.lit(""))
    return t.documents.select("doc_id", F.array_join(X.clean_tags(raw), ",").alias("tags"))


@query(f"""select doc_id, case when text is null or length({_sql(_STRIP, 'text')}) = 0 then 'blank' when contains(text, chr(65533)) then 'replacement'
when regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') then 'control' end as refused from documents""")
def bad_text(t: Tables):
    return t.documents.select("doc_id", X.bad_text(F.col("text")).alias("refused"))


@query(r"""with n as (select page_id, regexp_extract(url, '/([^/]*)$', 1) || case page_id % 4 when 0 then '.txt' when 1 then '.SRT' when 2 then '.pdf' else ' ' end as name from pages)
select page_id, case when name = '' or trim(name) <> name or length(name) > 255 then 'length' when regexp_matches(name, '[<>:"/\\|?*]') then 'character' when regexp_matches(name, '[. ]$') then 'ending'
when not regexp_matches(lower(name), '\.(srt|txt)$') then 'type' else 'ok' end as verdict,
left(coalesce(nullif(trim(regexp_replace(name, '\.[^.]*$', ''), ' .'), ''), 'Imported source'), 255) as title from n""")
def filename_check(t: Tables):
    end = F.element_at(F.array(*map(F.lit, (".txt", ".SRT", ".pdf", " "))), (F.col("page_id") % 4 + 1).cast("int"))
    name = F.concat(F.regexp_extract("url", "/([^/]*)$", 1), end)
    return t.pages.select("page_id", X.filename_verdict(name).alias("verdict"), X.filename_title(name).alias("title"))


@query(f"""with c as (select p_partkey as id, {_sql(_FORM, 'p_name')} as f, p_name as label from part), r as (select id, label, f, case when f = 'red' then 0 when starts_with(f, 'red') then 1
when len(list_filter(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_]+'), lambda w: starts_with(w, 'red'))) > 0 then 2 when contains(f, 'red') then 3 end as tier from c)
select id, label, tier, greatest(0, length(f) - 3)::int as surplus from r where tier is not null order by tier, surplus, f, id limit 50""")
def text_search_rank(t: Tables):
    items = t.part.select(F.lit("fact").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return knowledge.text_search(items, "RED", 50).select("id", "label", "tier", "surplus")


@query("""with c as (select p_partkey as id, p_name as label, lower(p_name) as f, lower(p_type) as tag from part), s as (select *, case when f = 'ring' then 100 when starts_with(f, 'ring') then 85
when len(list_filter(string_split(f, ' '), lambda w: starts_with(w, 'ring'))) > 0 then 72 when contains(f, 'ring') then 60 when tag = 'ring' then 48 when contains(tag, 'ring') then 36 end as score from c)
select id, label, score from s where score is not null order by score desc, label, id limit 40""")
def client_search_score(t: Tables):
    items = t.part.select(F.lit("fact").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.array("p_type").alias("tags"))
    return knowledge.client_search(items, "ring", 40).select("id", "label", "score")


@query("""with r as (select doc_id, text, row_number() over (order by md5(text), doc_id) as rank from documents where text is not null), s as (select *, sum(length(text) + 2) over (order by rank) - 2 + 20 as size from r where rank <= 8)
select doc_id, 'K' || rank as reference, size::bigint as size from s where size <= 60000""")
def context_prefix(t: Tables):
    """Of eight ranked blocks those that fit a budget of 60,000 characters with 20 of framing."""
    ranked = t.documents.where("text is not null").select("doc_id", "text", F.md5("text").alias("mark")).orderBy("mark", "doc_id").limit(8)
    rank = F.row_number().over(Window.orderBy("mark", "doc_id"))  # eight rows
    blocks = checkpointed(ranked.select("doc_id", rank.alias("rank"), F.col("text").alias("block")))
    kept = knowledge.context_prefix(blocks, 60_000, 20, 8).join(blocks.select("rank", "doc_id"), "rank")
    size = F.sum(F.length("block") + 2).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - 2 + 20
    return kept.select("doc_id", "reference", size.alias("size"))


@query(r"""select conv_id, turn, list_aggregate(list_transform(regexp_extract_all(c, '\[([Kk][^\]\r\n]*)\]', 1), lambda x: x), 'string_agg', ',') as found from
(select conv_id, turn, 'See [K' || (turn + 1) || '] and [k2] but not [X1], [K' || conv_id || ' b].' as c from conversations)""")
def citation_extract(t: Tables):
    answer = F.concat(F.lit("See [K"), (F.col("turn") + 1).cast("string"), F.lit("] and [k2] but not [X1], [K"), F.col("conv_id").cast("string"), F.lit(" b]."))
    return t.conversations.select("conv_id", "turn", F.array_join(X.citations(answer), ",").alias("found"))


_SHAPE = r"\[([Kk][^\]\r\n]*)\]"


@query(rf"""with a as (select conv_id, turn, text || ' [K' || length(text) % 5 || ']' || case when length(text) % 3 = 0 then ' and [K' || (length(text) % 4 + 1) || ']' when length(text) % 17 = 0 then ' [K2 and more]' else '' end as answer, case when length(text) % 11 = 0 then 'see [K2]' end as additions,
case when length(text) % 6 = 1 then []::varchar[] when length(text) % 3 = 0 then list_distinct(['K' || length(text) % 5, 'K' || (length(text) % 4 + 1)]) when length(text) % 7 = 0 then ['K3'] else ['K' || length(text) % 5] end as used, length(text) % 13 = 0 as short from conversations where text is not null),
t as (select *, regexp_extract_all(answer, '{_SHAPE}', 1) as marks from a), u as (select *, list_transform(marks, lambda x: upper(x)) as inline from t)
select conv_id, turn, case when len(list_filter(used, lambda x: not list_contains(['K1', 'K2', 'K3'], x))) > 0 then 'unknown used' when len(list_filter(marks, lambda x: not regexp_full_match(x, 'K[1-9][0-9]*'))) > 0 then 'malformed'
when len(list_filter(inline, lambda x: not list_contains(['K1', 'K2', 'K3'], x))) > 0 then 'unknown inline' when len(regexp_extract_all(coalesce(additions, ''), '{_SHAPE}', 1)) > 0 then 'additions cite' when short and (len(used) > 0 or len(inline) > 0) then 'insufficient cites'
when not short and len(used) = 0 then 'nothing used' when list_sort(list_distinct(inline)) <> list_sort(list_distinct(used)) then 'sets differ' else 'valid' end as verdict from u""")
def citation_verdict(t: Tables):
    """Answers that end in marks by the length of a turn's text, judged by what they cite."""
    n = F.length("text")
    mark = lambda c: F.concat(F.lit("K"), c.cast("string"))
    more = F.when(n % 3 == 0, F.concat(F.lit(" and ["), mark(n % 4 + 1), F.lit("]"))).when(n % 17 == 0, " [K2 and more]").otherwise("")
    answer = F.concat("text", F.lit(" ["), mark(n % 5), F.lit("]"), more)
    used = F.when(n % 6 == 1, F.array().cast("array<string>")).when(n % 3 == 0, F.array_distinct(F.array(mark(n % 5), mark(n % 4 + 1)))).when(n % 7 == 0, F.array(F.lit("K3"))).otherwise(F.array(mark(n % 5)))
    verdict = knowledge.citation_verdict(answer, F.when(n % 11 == 0, "see [K2]"), used, F.array(*map(F.lit, ("K1", "K2", "K3"))), n % 13 == 0)
    return t.conversations.where("text is not null").select("conv_id", "turn", verdict.alias("verdict"))


@query("""select conv_id, turn, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as clock, ms as parsed from (select conv_id, turn, conv_id * 987654 + turn * 4001 as ms from conversations)""")
def clock_roundtrip(t: Tables):
    ms = F.col("conv_id") * 987_654 + F.col("turn") * 4001
    return t.conversations.select("conv_id", "turn", X.clock(ms).alias("clock"), X.parsed_clock(X.clock(ms)).alias("parsed"))


@query("""select conv_id, turn, case when turn % 3 = 0 then printf('00:00:%02d,000 --> 00:00:%02d,500', turn, turn) when turn % 3 = 1 then 'characters ' || turn || ' to ' || (turn + 9) else 'passage ' || turn end as place from conversations""")
def evidence_locator(t: Tables):
    turn = F.col("turn")
    timed, placed = turn % 3 == 0, turn % 3 == 1
    return t.conversations.select("conv_id", "turn", X.locator(F.when(timed, turn * 1000), F.when(timed, turn * 1000 + 500), F.when(placed, turn), F.when(placed, turn + 9), turn).alias("place"))


_FACTS = f"select doc_id, {_TITLE} as title, text, lang, source from documents"


@query(f"""with f as ({_FACTS}), k as (select *, {_sql(_KEY, 'title')} as kt, {_sql(_KEY, 'text')} as kx from f),
t as (select kt, kx, tag, min(doc_id * 2 + pos) as first from (select kt, kx, doc_id, unnest([lang, source]) as tag, unnest([0, 1]) as pos from k) group by 1, 2, 3),
r as (select kt, kx, tag, first, row_number() over (partition by kt, kx order by first) as rank from t where tag is not null),
g as (select kt, kx, string_agg(tag, ',' order by first) as tags from r where rank <= 8 group by 1, 2),
m as (select kt, kx, min(doc_id) as first, arg_min(title, doc_id) as title, count(*) as merged, array_to_string(list_sort(list_distinct(list(doc_id % 16))), ',') as passages from k group by 1, 2)
select m.first, title, merged, passages, coalesce(tags, '') as tags from m left join g on m.kt is not distinct from g.kt and m.kx is not distinct from g.kx""")
def fact_merge(t: Tables):
    facts = t.documents.select(
        F.col("doc_id").alias("ord"), X.derived_title(F.col("text")).alias("title"), F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"), (F.col("doc_id") % 16).alias("passage"),
    )
    return knowledge.merge_facts(facts).select("first", "title", "merged", F.array_join(F.transform("passages", lambda p: p.cast("string")), ",").alias("passages"), F.array_join("tags", ",").alias("tags"))


@query("""with m as (select source as grp, count(*) over (partition by source) as members, lower(lang) as word from documents), c as (select grp, word, count(*) as n, any_value(members) as members from m group by 1, 2 having count(*) >= case when any_value(members) = 1 then 1 else 2 end),
r as (select *, row_number() over (partition by grp order by n desc, word) as r from c) select grp, string_agg(upper(left(word, 1)) || lower(substr(word, 2)), ' · ' order by r) as label from r where r <= 2 group by 1""")
def label_tags(t: Tables):
    return knowledge.tag_labels(t.documents.select(F.col("source").alias("grp"), F.array(F.concat(F.lit("#"), F.upper("lang"))).alias("tags")))


@query(f"""with w as (select lang as grp, unnest(regexp_extract_all(lower(title), '\\p{{L}}{{3,}}')) as word from ({_FACTS})), c as (select grp, word, count(*) as n from w where word not in ({', '.join(repr(x) for x in X.STOP_WORDS)}) group by 1, 2),
r as (select *, row_number() over (partition by grp order by n desc, word) as r from c), j as (select grp, string_agg(word, ' ' order by r) as label from r where r <= 3 group by 1) select grp, upper(left(label, 1)) || lower(substr(label, 2)) as label from j""")
def label_titles(t: Tables):
    return knowledge.title_labels(t.documents.select(F.col("lang").alias("grp"), X.derived_title(F.col("text")).alias("title")))


@query("""with g as (select n_regionkey as level, n_nationkey as grp, row_number() over (partition by n_regionkey order by n_nationkey) as n from nation)
select grp, level, case when level = 0 then 'All notes' when grp % 2 = 0 then 'Tag ' || grp when grp % 3 = 0 then 'Title ' || grp when level = 1 then 'Domain ' || n when level = 2 then 'Theme ' || n else 'Group ' || n end as label from g""")
def label_fallback(t: Tables):
    groups = t.nation.select(F.col("n_nationkey").alias("grp"), F.col("n_regionkey").alias("level"))
    text = lambda word: F.concat_ws(" ", F.lit(word), F.col("grp").cast("string")).alias("label")
    tags, titles = groups.where("grp % 2 = 0").select("grp", text("Tag")), groups.where("grp % 3 = 0").select("grp", text("Title"))
    return knowledge.fallback_labels(groups, tags, titles, {1: "Domain", 2: "Theme"}, "All notes")


@query("""with recursive t as (select source as grp, doc_id, n_chars as n, row_number() over (partition by source order by doc_id) as i from documents),
w as (select grp, doc_id, i, 0::bigint as bin, n + 8 as used from t where i = 1
union all select t.grp, t.doc_id, t.i, case when w.used + t.n + 8 > 6000 then w.bin + 1 else w.bin end, case when w.used + t.n + 8 > 6000 then t.n + 8 else w.used + t.n + 8 end from w join t on t.grp = w.grp and t.i = w.i + 1)
select grp, doc_id as ord, bin from w""")
def bin_pack_groups(t: Tables):
    return knowledge.bin_groups(t.documents.select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("tokens")), 6000, 8)


@query("""with j as (select doc_id, '{"a":{"size":' || coalesce(n_chars::varchar, 'null') || ',"z":[{"lang":' || coalesce(to_json(lang)::varchar, 'null') || ',"n":1},null]},"m":{' || to_json('k' || doc_id % 3)::varchar || ':' || doc_id % 2 || ',"kz":0},"source":' || coalesce(to_json(source)::varchar, 'null')
|| ',"text":' || coalesce(to_json(left(text, 60))::varchar, 'null') || ',"yes":' || (doc_id % 2 = 0)::varchar || '}' as canonical from documents) select *, sha256(canonical) as digest, true as same from j""")
def canonical_json_digest(t: Tables):
    """Nested values as JSON; another order of fields and of a map's entries gives the same digest."""
    d, one, no = F.col("doc_id"), F.lit(1).alias("n"), F.lit(None).cast("struct<n:int,lang:string>")
    text, yes = F.left("text", F.lit(60)).alias("text"), (d % 2 == 0).alias("yes")
    key, value = F.concat(F.lit("k"), (d % 3).cast("string")), (d % 2).cast("int")
    first = t.documents.select("doc_id", yes, text, F.create_map(F.lit("kz"), F.lit(0), key, value).alias("m"), "source", F.struct(F.array(F.struct(one, "lang"), no).alias("z"), F.col("n_chars").alias("size")).alias("a"))
    other = t.documents.select("doc_id", F.struct(F.col("n_chars").alias("size"), F.array(F.struct("lang", one), no.cast("struct<lang:string,n:int>")).alias("z")).alias("a"), "source", F.create_map(key, value, F.lit("kz"), F.lit(0)).alias("m"), yes, text)
    names = ("a", "m", "source", "text", "yes")
    made = [rows.select("doc_id", canonical_row(rows, *order).alias("canonical")) for rows, order in ((first, names), (other, names[::-1]))]
    both = made[0].join(made[1].withColumnRenamed("canonical", "again"), "doc_id")
    return both.select("doc_id", "canonical", F.sha2("canonical", 256).alias("digest"), (F.col("canonical") == F.col("again")).alias("same"))


@query("""with h as (select label as grp, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('level=1;members=' || string_agg(vec_id::varchar, ',' order by vec_id))) as r from embeddings group by 1)
select grp, substr(r,1,8)||'-'||substr(r,9,4)||'-5'||substr(r,14,3)||'-'||substr('89ab', 1 + ('0x' || substr(r,17,1))::int % 4, 1)||substr(r,18,3)||'-'||substr(r,21,12) as uuid from h""")
def cluster_uuid(t: Tables):
    named = t.embeddings.groupBy(F.col("label").alias("grp")).agg(F.array_sort(F.collect_list("vec_id")).alias("m"))
    name = F.concat(F.lit("level=1;members="), F.array_join(F.transform("m", lambda x: x.cast("string")), ","))
    return named.select("grp", N.name_uuid("6ba7b8119dad11d180b400c04fd430c8", name).alias("uuid"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(json_extract_string(props, '$.absent'), '-') as absent, 0::int as broken from events""")
def json_tolerant(t: Tables):
    """Named numbers of a JSON reply; what isn't there or isn't JSON is nothing."""
    return t.events.select(
        "event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("-")).alias("absent"),
        F.coalesce(F.from_json(F.concat(F.lit("x"), "props"), "k long")["k"], F.lit(0)).cast("int").alias("broken"),
    )


@query("""select part_name, list_reduce(list_transform(range(1, length(part_name) + 1), lambda i: ascii(part_name[i])::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint) as h from (select distinct p_name as part_name from part)""")
def stable_hash(t: Tables):
    return t.part.select(F.col("p_name").alias("part_name")).distinct().select("part_name", X.fnv1a(F.col("part_name")).alias("h"))


_SEG = "select conv_id, turn, (conv_id % 3) * 1000 + turn * 4000 as s, regexp_replace(regexp_replace(regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g'), '^\\s+', ''), '\\s+$', '') as text from conversations"


def _cues(t: Tables):
    start = (F.col("conv_id") % 3) * 1000 + F.col("turn") * 4000
    body = F.regexp_replace(F.regexp_replace("text", r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")
    return t.conversations.select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("cue"), start.alias("start_ms"), (start + 3200).alias("end_ms"), body.alias("text"))


@query(f"select conv_id as file, turn + 1 as cue, s as start_ms, s + 3200 as end_ms, sha256(text) as mark, 'ok' as verdict from ({_SEG})")
def srt_roundtrip(t: Tables):
    """Conversations rendered as subtitle files and parsed back."""
    back = subtitles.parse(subtitles.render(_cues(t)))
    return back.select("file", "cue", "start_ms", "end_ms", F.sha2("text", 256).alias("mark"), "verdict")


@query("""with n as (select conv_id as file, count(*) as n from conversations group by 1) select file, case when file % 5 = 1 then 'timing' when file % 5 = 2 and n > 1 then 'times' when file % 5 = 2 then 'times' when file % 5 = 3 then 'number' else 'ok' end as verdict from n""")
def srt_reject(t: Tables):
    """One bad block refuses a whole file."""
    damaged = subtitles.render(_cues(t)).withColumn(
        "text",
        F.when(F.col("file") % 5 == 1, F.regexp_replace("text", " --> ", " -> ")).when(F.col("file") % 5 == 2, F.regexp_replace("text", r"--> 00:", "--> 00:00:00,000\nx:"))
        .when(F.col("file") % 5 == 3, F.concat(F.lit("0\n"), F.regexp_replace("text", r"^1\n", ""))).otherwise(F.col("text")),
    )
    damaged = damaged.withColumn("text", F.regexp_replace("text", r"--> 00:00:00,000\nx:\S*", "--> 00:00:00,000"))
    return subtitles.parse(damaged).groupBy("file").agg(F.first("verdict").alias("verdict"))


@query("""select doc_id, true as exact, true as bounded, true as ordered from documents where regexp_matches(text, '\\S')""")
def chunk_text_invariants(t: Tables):
    """Passages are exact parts of the text, within the limit, in order and apart."""
    limits = chunking.Limits(target=60, most=90)
    # a document's passages are one row, as its text is, so a text travels once and not with each passage
    parts = chunking.chunk_texts(t.documents, limits).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("passage", "char_start", "char_end", "tokens", "text"))).alias("p"))
    checked = parts.join(t.documents.select("doc_id", F.col("text").alias("whole")), "doc_id")
    ends = F.concat(F.array(F.lit(0)), F.transform("p", lambda x: x["char_end"]))
    return checked.select(
        "doc_id", F.expr("forall(p, x -> substring(whole, x.char_start + 1, x.char_end - x.char_start) = x.text)").alias("exact"),
        F.forall("p", lambda x: x["tokens"] <= 90).alias("bounded"),
        F.forall(F.zip_with(F.slice(ends, F.lit(1), F.size("p")), "p", lambda before, x: before <= x["char_start"]), lambda x: x).alias("ordered"),
    )


@query()
def chunk_rows(t: Tables):
    return chunking.chunk_texts(t.documents).drop("text")


@query("select conv_id as source, min(turn) as first_cue, max(turn) as last_cue, true as bounded from conversations group by 1")
def chunk_srt_invariants(t: Tables):
    """Passages of cues cover them from first to last within the limit."""
    cues = t.conversations.select(F.col("conv_id").alias("source"), F.col("turn").alias("cue"), "text", (F.col("turn") * 4000).alias("start_ms"), (F.col("turn") * 4000 + 3200).alias("end_ms"))
    parts = chunking.chunk_cues(cues, chunking.Limits(target=80, most=120, overlap=1))
    return parts.groupBy("source").agg(F.min("first_cue").alias("first_cue"), F.max("last_cue").alias("last_cue"), F.every(F.col("tokens") <= 120).alias("bounded"))
