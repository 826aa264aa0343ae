"""Personal data by bootstrapped contextual extraction (operator 8).

Seeds are what four fixed expressions find in the whole text: e-mail addresses, IP addresses, card and phone numbers.
A fifth seed kind, secret, stands for long values that are assigned to a name such as token or password; it belongs to
the spans that the method adds. A seed's surroundings are lexical patterns: the two words before it, the words on either
side, and for values of more than twelve letters and digits their shape (digit by digit, or hexadecimal and its length).
Other identifier-like tokens (six characters or more with a digit or an at sign) that have the same patterns are
candidates, and so are adjacent groups with digits that spaces, dots, hyphens or brackets join, such as 0171 555 0199.
Values of any length count; long ones stand by their hash. Of spans that lie in each other, the outer one is added.

Spark scores the graph of patterns and values in rounds. A pattern's confidence for a kind is the belief in that kind of
the values it is seen with, over their number plus one; values without any belief count in full against a pattern of
words and by half against a shape, so that numbers of which few pass the check digit (a tenth do by chance) prove
nothing, and numbers of a length at which most pass show the others to be cards with a wrong digit. A value's belief in
a kind is that of its most confident pattern. Patterns count if they are confident and supported by enough different
values, seeds or discovered, so single coincidences and copies of one text prove nothing. Values with high belief become
new spans, and in the next round evidence for more patterns. Beliefs only rise from round to round, and rounds end when
none moves.

A null or empty text has no spans. Repeated documents (same id) each get the spans of their own text. An empty table
gives an empty result. Columns other than doc_id and text are ignored, and redact() passes them on. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.staging import Staging, fresh

KINDS = ("email", "ip", "card", "phone")
#: The kind that only the method's own seeds and discoveries have.
SECRET = "secret"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can only begin at the start of a run of digits, so the other starts are not tried
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_JOINERS = {ord(c): None for c in " -"}
_TOKEN = re.compile(r"\S+")
# groups that hold a digit each, with what may stand between them; starts only where a run of letters and digits does
_GROUPS = re.compile(r"(?<![0-9A-Za-z])[+(\[]{0,2}[A-Za-z]*+[0-9][0-9A-Za-z]*+(?:[ ().\[\]-]{1,3}[A-Za-z]*+[0-9][0-9A-Za-z]*+)+")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?\s{0,4}[:=]\s{0,4}[\"']?([^\s\"'<>]{16,})")
_HEX = re.compile(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})")
_OUTER = "\"'`.,;:!?()[]{}<>|*#$%&="


@dataclass(frozen=True)
class Settings:
    #: Different known or discovered values that a pattern needs, its least confidence, and the least belief of a new value.
    support: int = 3
    confidence: float = 0.6
    belief: float = 0.6
    #: What a value without belief counts against a shape, and the least letters and digits that have one.
    shape_doubt: float = 0.5
    shape_size: int = 13
    #: Rounds end when no value is new and no belief rose by more.
    tolerance: float = 1e-6
    #: Longest value that is kept as it is (others by their hash) and widest look for a context word, in characters.
    longest: int = 64
    reach: int = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of local@domain.tld: every match ends its local part at an at sign, and starts at the run before."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The seeds: leftmost, non-overlapping per kind, by kind and then start."""
    found = [("email", *span) for span in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def contexts(text: str, start: int, end: int, reach: int) -> list[str]:
    """Lexical patterns around a span; sides at the text's edge count as words of their own."""
    left = [w.strip(_OUTER).lower() or w for w in text[max(0, start - reach) : start].split()[-2:]]
    right = [w.strip(_OUTER).lower() or w for w in text[end : end + reach].split()[:1]]
    left = ["^"] * (2 - len(left)) + left
    return [f"{left[0]} {left[1]} _", f"{left[1]} _ {right[0] if right else '$'}"]


def secrets(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Values with letters and digits assigned to a name for secrets, where no base span is."""
    out, k = [], 0
    taken = sorted((s, e) for _, s, e in spans)
    for m in _SECRET.finditer(text):
        start, end = m.span(1)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        value = m.group(1)
        if (k == len(taken) or taken[k][0] >= end) and _DIGIT.search(value) and any(c.isalpha() for c in value):
            out.append((SECRET, start, end))
    return out


def shape(value: str, settings: Settings) -> list[str]:
    """The pattern of a long value's form, if it has one."""
    plain = value.translate(_JOINERS)
    if not settings.shape_size <= len(plain) <= settings.longest:
        return []
    if plain.isdecimal():
        return [f"#9x{len(plain)}"]
    return [f"#hex{len(plain)}"] if _HEX.fullmatch(plain) else []


def identity(value: str, longest: int) -> str:
    """What tells values apart: the value, or the hash of all of it where it is long."""
    return value if len(value) <= longest else hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def grouped(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of joined groups with digits between the spans that are taken."""
    at = 0
    for begin, until in [*taken, (len(text), len(text))]:
        for m in _GROUPS.finditer(text, at, begin) if begin - at >= 6 else ():
            start, end = m.span()
            # a bracket that closes after the groups, or not at all, isn't part of them
            while text[start] in "([" and ")]"["([".index(text[start])] not in m.group():
                start += 1
            if end - start >= 6:
                yield start, end
        at = max(at, until)


def occurrences(text: str, spans: list[tuple[str, int, int]], settings: Settings) -> list[tuple]:
    """(kind or None, start, end, value, pattern) of seeds and of candidate tokens and groups."""
    out = []
    for kind, start, end in spans:
        value = identity(text[start:end], settings.longest)
        out += [(kind, start, end, value, p) for p in [*contexts(text, start, end, settings.reach), *shape(text[start:end], settings)]]
    taken = sorted((s, e) for _, s, e in spans)
    candidates = set(grouped(text, taken))
    k = 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        if len(token) < 6 or not ("@" in token or _DIGIT.search(token)):
            continue
        core = token.strip(_OUTER)
        if len(core) < 6:
            continue
        start = m.start() + token.index(core)
        end = start + len(core)
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        candidates.add((start, end))
    for start, end in sorted(candidates):
        value = identity(text[start:end], settings.longest)
        out += [(None, start, end, value, p) for p in [*contexts(text, start, end, settings.reach), *shape(text[start:end], settings)]]
    return out


_SEEN = "array<struct<kind:string,start:int,end:int,value:string,pattern:string>>"


def extract(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, part (a number that keeps rows with one id apart), base spans and occurrences of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        seen = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("pattern", pa.string())])
        for batch in batches:
            spans, noted = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                own = base_spans(text)
                spans.append([dict(zip(("kind", "start", "end"), x)) for x in own])
                noted.append(
                    [dict(zip(("kind", "start", "end", "value", "pattern"), x)) for x in occurrences(text, own + secrets(text, own), settings)]
                    if own or "@" in text or _DIGIT.search(text) else []
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(spans, pa.list_(span)), pa.array(noted, pa.list_(seen))],
                ["doc_id", "part", "spans", "seen"],
            )

    source = documents.select("doc_id", F.xxhash64("text").alias("part"), "text")
    return source.mapInArrow(run, f"doc_id long, part long, spans array<struct<kind:string,start:int,end:int>>, seen {_SEEN}")


def bootstrap(seen: DataFrame, stage: Staging, settings: Settings = Settings()) -> DataFrame:
    """(value, kind, belief) of values that patterns reveal, from occurrences (kind, value, pattern).

    Sides with one row a key are tables before they are joined, so that a key that holds many rows of the other side
    is an ordinary skewed partition, which Spark splits.
    """
    links = stage.save(seen.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "links")
    known = stage.save(links.select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).where("kind is not null").distinct(), "known")
    # only what can never matter goes: patterns of too few values to count, and those that have no candidate to reveal
    useful = links.groupBy("pattern").agg(F.count("seed").alias("seeds"), F.count("*").alias("values")).where(f"values >= {settings.support} and values > seeds")
    useful = stage.save(useful.select("pattern", "values"), "useful")
    graph = stage.save(links.join(useful, "pattern"), "graph")
    stage.drop(links)
    stage.drop(useful)
    found = graph.sparkSession.createDataFrame([], "value string, kind string, belief double")
    moving = not graph.isEmpty() and not known.isEmpty()
    doubt = F.when(F.startswith("pattern", F.lit("#")), settings.shape_doubt).otherwise(1.0)
    while moving:
        beliefs = stage.save(known.union(found.join(known, ["value", "kind"], "left_anti")), "beliefs")
        by_kind = graph.join(beliefs, "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"), F.count("*").alias("support"), F.first("values").alias("values"))
        by_pattern = by_kind.groupBy("pattern").agg(F.least(F.sum("belief"), F.first("values")).alias("held"), F.collect_list(F.struct("kind", "belief", "support")).alias("kinds"), F.first("values").alias("values"))
        confident = by_pattern.select("pattern", "held", "values", F.inline("kinds")).select(
            "pattern", "kind", "support", (F.col("belief") / (F.col("held") + doubt * (F.col("values") - F.col("held")) + 1)).alias("confidence")
        )
        confident = stage.save(confident.where((F.col("confidence") >= settings.confidence) & (F.col("support") >= settings.support)), "confident")
        better = (
            graph.where("seed is null").join(confident, "pattern").groupBy("value", "kind")
            .agg(F.max("confidence").alias("belief")).where(F.col("belief") >= settings.belief)
        )
        before, found = found, stage.save(better, "found")
        was = before.withColumnRenamed("belief", "was")
        moving = not found.join(was, ["value", "kind"], "left").where(f"was is null or belief > was + {settings.tolerance}").isEmpty()
        for old in (before, beliefs, confident):
            stage.drop(old)
    stage.drop(graph)
    return stage.save(found.groupBy("value").agg(F.max(F.struct("belief", "kind")).alias("best")).select("value", "best.kind", "best.belief"), "best")


def find(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, part, spans (base) and all_spans (base and discovered) of every document; part is the text's hash."""
    stage = Staging(documents.sparkSession, "pii")
    rows = stage.save(extract(documents, settings), "extracted")
    seen = rows.select("doc_id", "part", F.explode("seen").alias("o")).select("doc_id", "part", "o.*")
    found = bootstrap(seen.select("kind", "value", "pattern"), stage, settings)
    places = seen.select("kind", "doc_id", "part", "start", "end", "value").distinct()
    revealed = places.where("kind is null").drop("kind").join(found.select("value", F.col("kind").alias("new_kind")), "value")
    own = places.where(F.col("kind") == SECRET).withColumnRenamed("kind", "new_kind")
    added = (
        revealed.unionByName(own)
        .groupBy("doc_id", "part").agg(F.collect_list(F.struct(F.col("new_kind").alias("kind"), "start", "end")).alias("added"))
        # a span in a longer one says nothing new
        .withColumn("added", F.expr("filter(added, x -> not exists(added, y -> y.start <= x.start and y.end >= x.end and y.end - y.start > x.end - x.start))"))
    )
    added = added.select(F.col("doc_id").alias("_id"), F.col("part").alias("_part"), "added")
    joined = rows.drop("seen").join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("part").eqNullSafe(F.col("_part")), "left")
    every = F.concat("spans", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), x["kind"]).cast("int").alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return joined.select("doc_id", "part", "spans", F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("all_spans"))


def digest(spans: str):
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """documents with each span's text replaced by its kind in angle brackets; overlapping spans become one.

    Every row stays, in any number of copies; null and empty texts stay as they are, and so do columns of any name. An
    n_chars column follows the new text.
    """
    columns = documents.columns
    key, part, held = (fresh(columns, name) for name in ("id", "part", "spans"))
    found = find(documents, settings).select(F.col("doc_id").alias(key), F.col("part").alias(part), F.col("all_spans").alias(held)).where(F.size(held) > 0).distinct()
    both = documents.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(part)), "left")

    @F.pandas_udf("string")
    def mask(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans):
            if own is not None and len(own):
                parts, at = [], 0
                for start, end, kind in sorted((x["start"], x["end"], x["kind"]) for x in own):
                    if start >= at:
                        parts += [text[at:start], f"<{kind.upper()}>"]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    masked = both.withColumn("text", F.when(F.col(held).isNotNull(), mask("text", held)).otherwise(F.col("text")))
    if "n_chars" in columns:
        masked = masked.withColumn("n_chars", F.when(F.col(held).isNotNull(), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*(F.col(f"`{c}`") for c in columns))
