"""Column expressions for text: built-in functions, so they stay in generated code and can be pushed down. Only the forms
under which letters beyond ASCII are compared come from noema.functions.folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noema.functions.folding import client_fold, each, identity_fold, search_fold

#: Fixed value: a lexical token is a run of letters, digits and underscores, or one other visible character.
LEXICAL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
#: Accented letters and their plain forms, for search.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Words left out of labels.
STOP_WORDS = ("avec", "dans", "des", "du", "elle", "entre", "est", "les", "leur", "pour", "principe", "sur", "une", "the", "and", "from", "that", "with")
#: File names that an operating system reserves.
RESERVED_NAMES = ("aux", "clock$", "con", "nul", "prn", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def strip(text: Column) -> Column:
    """Without white space (of any kind) at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def collapse(text: Column) -> Column:
    """Stripped, and every run of white space one space."""
    return F.regexp_replace(strip(text), r"[\s\p{Z}]+", " ")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def token_estimate(text: Column) -> Column:
    """Tokens of a text: a quarter of its characters or 1.25 a lexical token, whichever is more, rounded up."""
    core = strip(text)
    most = F.greatest(F.length(core) / F.lit(4.0), F.regexp_count(core, F.lit(LEXICAL)) * F.lit(1.25))
    return F.when(F.length(core) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(most))).cast("long")


def semantic_text(title: Column, content: Column) -> Column:
    return F.concat(strip(title), F.lit("\n\n"), strip(content))


def fingerprint(title: Column, content: Column) -> Column:
    return F.sha2(semantic_text(title, content), 256)


def limit_text(text: Column, most: int) -> Column:
    """Stripped; longer texts end in an ellipsis within the limit."""
    core = strip(text)
    cut = F.regexp_replace(F.left(core, F.lit(most - 1)), r"[\s\p{Z}]+$", "")
    return F.when(F.length(core) <= most, core).otherwise(F.concat(cut, F.lit("…")))


def derived_title(text: Column, most: int = 120, default: str = "Untitled note") -> Column:
    """The first line that isn't blank, limited."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\f]"), strip), lambda x: F.length(x) > 0)
    return limit_text(F.coalesce(F.get(lines, F.lit(0)), F.lit(default)), most)


def identity_key(text: Column) -> Column:
    """Key under which equal facts meet: compatible characters equal, case-folded, white space collapsed."""
    return collapse(identity_fold(text))


def search_form(text: Column) -> Column:
    """Case-folded, compatible characters equal, without accents, white space collapsed."""
    return collapse(search_fold(text))


def _alphanumeric(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def client_form(text: Column) -> Column:
    """Without accents, lowered, anything but letters and digits a space."""
    return _alphanumeric(client_fold(text))


def client_forms(texts: Column) -> Column:
    return F.transform(each(texts, client_fold), _alphanumeric)


def search_tier(candidate: Column, wanted: Column) -> Column:
    """0 equal, 1 prefix, 2 prefix of a word, 3 inside, 4 every wanted word begins some word; null: no match."""
    words = F.regexp_extract_all(candidate, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    parts = F.regexp_extract_all(wanted, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    every = F.forall(parts, lambda p: F.exists(words, lambda w: F.startswith(w, p)))
    return (
        F.when(candidate == wanted, 0).when(F.startswith(candidate, wanted), 1)
        .when(F.exists(words, lambda w: F.startswith(w, wanted)), 2).when(F.contains(candidate, wanted), 3)
        .when((F.size(parts) > 0) & every, 4)
    )


def tag_names(tags: Column) -> Column:
    """Tags with compatible characters equal, case-folded, collapsed, one leading # dropped; the first of equals, no blanks."""
    bare = F.transform(each(tags, identity_fold), lambda t: collapse(F.regexp_replace(strip(t), "^#", "")))
    return F.array_distinct(F.filter(bare, lambda t: F.length(t) > 0))


def tag_fault(tags: Column) -> Column:
    """Why a list of tags is refused as a whole: a # inside one, or one that is too long; null if it isn't."""
    names = tag_names(tags)
    return F.when(F.exists(names, lambda t: F.contains(t, F.lit("#"))), "inner #").when(F.exists(names, lambda t: F.length(t) > 40), "too long")


def clean_tags(tags: Column) -> Column:
    """The names of tags in order, without those that would be refused."""
    return F.filter(tag_names(tags), lambda t: (F.length(t) <= 40) & ~F.contains(t, F.lit("#")))


def capitalised(text: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 1 << 30)))


def citations(text: Column) -> Column:
    """What stands in brackets and begins with K."""
    return F.regexp_extract_all(text, F.lit(r"\[([Kk][^\]\r\n]*)\]"), F.lit(1))


def clock(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    at = lambda unit, top: (F.floor(ms / F.lit(unit)) % top if top else F.floor(ms / F.lit(unit))).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", at(3_600_000, 0), at(60_000, 60), at(1000, 60), (ms % 1000).cast("long"))


def parsed_clock(text: Column) -> Column:
    """HH:MM:SS,mmm (or a point) as milliseconds; null if it isn't one or minutes or seconds exceed 59."""
    form = r"^(\d{2,13}):([0-5]\d):([0-5]\d)[,.](\d{3})$"
    part = lambda i: F.regexp_extract(text, form, i).cast("long")
    return F.when(text.rlike(form), F.expr("1L") * ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def locator(start_ms: Column, end_ms: Column, char_start: Column, char_end: Column, passage: Column) -> Column:
    """Where evidence stands: a time range, else a character range, else a passage."""
    return (
        F.when(start_ms.isNotNull() & end_ms.isNotNull(), F.concat(clock(start_ms), F.lit(" --> "), clock(end_ms)))
        .when(char_start.isNotNull() & char_end.isNotNull(), F.concat_ws(" ", F.lit("characters"), char_start.cast("string"), F.lit("to"), char_end.cast("string")))
        .when(passage.isNotNull(), F.concat_ws(" ", F.lit("passage"), passage.cast("string"))).otherwise(F.lit("source passage"))
    )


def filename_verdict(name: Column) -> Column:
    """'ok', or why an uploaded file's name is refused."""
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return (
        F.when(name.isNull() | (name == "") | (strip(name) != name) | (F.length(name) > 255), "length")
        .when(name.rlike(r"\p{Cc}"), "control").when(name.rlike(r'[<>:"/\\|?*]'), "character")
        .when(name.rlike(r"[. ]$"), "ending").when(~F.lower(name).rlike(r"\.(srt|txt)$"), "type")
        .when(stem.isin(*RESERVED_NAMES), "reserved").otherwise("ok")
    )


def filename_title(name: Column, default: str = "Imported source") -> Column:
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"^[ .]+|[ .]+$", "")
    return F.left(F.coalesce(F.nullif(stem, F.lit("")), F.lit(default)), F.lit(255))


def bad_text(text: Column) -> Column:
    """Why decoded text is refused; null if it is fine."""
    return (
        F.when(text.isNull() | (F.length(strip(text)) == 0), "blank").when(F.contains(text, F.lit("�")), "replacement")
        .when(text.rlike(r"[\p{Cc}&&[^\t\n\r]]"), "control")
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a hash over the UTF-16 units of ASCII and Latin text, as a number."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
