"""Bytes of unknown 8-bit sets: which set they are in, judged for a batch of files at once by lookups of bytes and their neighbours."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8-bit sets that bytes without a mark may be in; of equally good ones the first is taken.
SETS = ("cp1252", "cp1251", "cp1253")
VOWELS = "àáâãäåæèéêëìíîïòóôõöøùúûüаеёиоуыэюяαεηιουωάέήίόύώ"
#: Letters of Cyrillic and Greek texts by how common they are: log2 of their share over 3 %, in halves from -3 to 2. A share is the mean
#: of that in Russian or Greek and that of the letter's sound in Western languages, as in foreign names and words; a third of the
#: foreign vowels carry the Greek accent.
CYRILLIC = {2: "е", 1.5: "оаин", 1: "тср", 0.5: "лду", 0: "вкм", -0.5: "пгх", -1: "бэ", -1.5: "яызйц", -2: "ьчф", -2.5: "ж", -3: "шющъё"}
GREEK = {1.5: "αετν", 1: "οισρ", 0.5: "κλ", 0: "υπμδέί", -0.5: "ςηγάό", -1: "χβύ", -1.5: "ωφ", -2: "θή", -2.5: "ζ", -3: "ξψώϊϋΐΰ"}
#: A difference in likelihood that letters don't outweigh: so much, and so great a part of the likelihood.
SURE, SURE_PART = 16, 0.25
#: Letters from which a file's own ones are sure to tell Cyrillic from Greek.
LONG = 100
#: Letters that the sure files of a set must have before their spelling decides, and how many sightings that of a shorter context counts for.
LEARNED, SHORTER = 1000, 4.0
#: Bytes that are judged at once, unless one file is longer, and files that a Python worker holds at once.
AT_ONCE, HELD = 1 << 20, 512
#: A letter's context is two bytes; those of ASCII count as one, since words end there.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[0x80:] = np.arange(1, 129)
_CLASSES = 129


def _table(charset: str) -> str:
    """The character of each byte: U+FFFD for unused places, in the Western set what they are in ISO-8859-1."""
    known = [bytes([b]).decode(charset, "replace") for b in range(256)]
    return "".join(chr(b) if c == "�" and charset == "cp1252" else c for b, c in enumerate(known))


_TABLES = {c: _table(c) for c in SETS}


def _pairs(chars: str) -> dict[str, np.ndarray]:
    """What a byte adds after another one (at 256 * first + second), by its reading: 'likely' by form and vowels; 'cyrillic' and 'greek' by form and how
    common letters are.

    By form letters beyond ASCII count for a reading; against it unused places, capitals after small letters, letters of two scripts side
    by side, accented Latin letters next to each other, and a final sigma before a letter. In Cyrillic, hard and soft signs or ы don't
    begin words. Pairs of ASCII are the same in all readings.
    """
    is_ = lambda pattern: np.array([re.fullmatch(pattern, c) is not None for c in chars])
    letter, lower, upper = (np.array([f(c) for c in chars]) for f in (str.isalpha, str.islower, str.isupper))
    high, latin, accented = np.arange(256) >= 0x80, is_("[A-Za-z]"), is_("[À-ÿ]")
    other = is_("[Ͱ-Ͽἀ-῿Ѐ-ԯ]")
    both = lambda a, b: (a[:, None] & b[None, :]).astype(np.float32)
    faults = both(lower, upper) + both(latin, other) + both(other, latin) + both(accented, accented) + both(is_("ς"), letter)
    form = (letter & high).astype(np.float32) - 4 * is_("�") - 4 * faults
    weights = {}
    for name, letters in (("cyrillic", CYRILLIC), ("greek", GREEK)):
        weight = {c: w + 4 for w, some in letters.items() for x in some for c in (x, x.upper() if len(x.upper()) == 1 and x != "ς" else x)}
        weights[name] = np.array([weight.get(c, 0) for c in chars], dtype=np.float32) - 4 * high
    ends = both(~letter, is_("(?i)[ьъы]"))
    out = {"likely": form + is_(f"(?i)[{VOWELS}]"), "cyrillic": form + weights["cyrillic"] - 4 * ends, "greek": form + weights["greek"]}
    return {name: np.where(high[:, None] | high[None, :], x, 0).astype(np.float32).ravel() for name, x in out.items()}


_SCORES = {c: _pairs(_TABLES[c]) for c in SETS}
_LEAD = _SCORES["cp1251"]["cyrillic"] - _SCORES["cp1253"]["greek"]
_RUSSIAN_VOWEL = np.array([c in "аеёиоуыэюяАЕЁИОУЫЭЮЯ" for c in _TABLES["cp1251"]])


class Spelling(NamedTuple):
    """log of how much likelier a byte is in Cyrillic than in Greek files, at (before * n + before) * n + byte of their classes; classes: 256 of them."""

    classes: np.ndarray
    lead: np.ndarray


class _Batch(NamedTuple):
    """Files in a row, each with two spaces before it: the bytes, the places where a byte or the one before it is beyond ASCII, where each file's places
    begin and end, and the pairs of bytes that end there."""

    flat: np.ndarray
    at: np.ndarray
    bounds: np.ndarray
    pairs: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(np.append(values, 0), self.bounds[:-1], dtype=np.float64)
        total[np.diff(self.bounds) == 0] = 0  # where nothing is added up reduceat gives the next value
        return total

    def added(self, table: np.ndarray) -> np.ndarray:
        return self.sums(table[self.pairs])

    def codes(self, classes: np.ndarray, n: int) -> np.ndarray:
        known = classes[self.flat]
        return (known[self.at - 2] * n + known[self.at - 1]) * n + known[self.at]


def _batches(files: list[bytes]) -> Iterator[tuple[list[bytes], _Batch]]:
    start = 0
    while start < len(files):
        end, held = start, 0
        while end < len(files) and (end == start or held + len(files[end]) <= AT_ONCE):
            held += len(files[end]) + 2
            end += 1
        some = files[start:end]
        flat = np.frombuffer(b"  ".join([b"", *some, b""]), dtype=np.uint8)
        high = flat >= 0x80
        at = np.flatnonzero(high[2:] | high[1:-1]) + 2
        ends = np.cumsum([0] + [len(f) + 2 for f in some]) + 2
        yield some, _Batch(flat, at, np.searchsorted(at, ends), (flat[at - 1].astype(np.int64) << 8) | flat[at])
        start = end


def _judged(batch: _Batch) -> np.ndarray:
    """For each file its place in SETS, -1 for Cyrillic or Greek that aren't surely one of them."""
    w, c, g = (batch.added(_SCORES[s]["likely"]) for s in SETS)
    sure = np.where(c - g > SURE + SURE_PART * np.abs(c), 1, np.where(g - c > SURE + SURE_PART * np.abs(g), 2, -1))
    return np.where(w >= np.maximum(c, g), 0, sure)


def _by_letters(batch: _Batch) -> np.ndarray:
    """For each file whether its letters are rather Cyrillic than Greek."""
    vowel = _RUSSIAN_VOWEL[batch.flat]
    three = vowel[batch.at] & vowel[batch.at - 1] & vowel[batch.at - 2]  # in Cyrillic three vowels don't meet
    return batch.added(_LEAD) >= 4 * batch.sums(three.astype(np.float32))


def _learned(files: DataFrame) -> Spelling | None:
    """How files(data) of which it is sure are spelled, or nothing if there are too few of a set; null is passed by, as a filter would work out data
    anew for each condition. Counts are of a fixed number of contexts, summed in tasks before the shuffle."""

    def count(batches):
        total = np.zeros((len(SETS), _CLASSES**3), dtype=np.int64)
        for rows in batches:
            for _, batch in _batches(rows.column(0).drop_null().to_pylist()):
                charset, places = _judged(batch), np.diff(batch.bounds)
                charset = np.where((charset < 0) & (places >= LONG), np.where(_by_letters(batch), 1, 2), charset)
                owner = np.repeat(charset, places)
                mine = owner > 0
                np.add.at(total.ravel(), owner[mine] * _CLASSES**3 + batch.codes(_CLASS, _CLASSES)[mine], 1)
        for s in (1, 2):
            seen = np.flatnonzero(total[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), s, dtype=np.int32)), pa.array(seen), pa.array(total[s, seen])], ["charset", "code", "n"])

    found = files.mapInArrow(count, "charset int, code long, n long").groupBy("charset", "code").agg(F.sum("n").alias("n"))
    rows = found.toPandas()  # those contexts that occur: some thousands of letters
    seen = {s: rows[rows.charset == s] for s in (1, 2)}
    if min(int(x.n[x.code % _CLASSES > 0].sum()) for x in seen.values()) < LEARNED:
        return None
    codes = rows.code.to_numpy()
    used = np.unique(np.concatenate([codes // _CLASSES**2, codes // _CLASSES % _CLASSES, codes % _CLASSES, [0]]))
    dense = np.full(_CLASSES, len(used), dtype=np.int64)  # all that never occur are one
    dense[used] = np.arange(len(used))
    side, logs = len(used) + 1, []
    for x in seen.values():
        n3 = np.zeros((side,) * 3)
        code = x.code.to_numpy()
        n3[dense[code // _CLASSES**2], dense[code // _CLASSES % _CLASSES], dense[code % _CLASSES]] = x.n
        n2 = n3.sum(0)
        n1 = n2.sum(0)
        p1 = (n1 + 1) / (n1.sum() + side)
        p2 = (n2 + SHORTER * p1) / (n2.sum(1, keepdims=True) + SHORTER)
        logs.append(np.log((n3 + SHORTER * p2) / (n3.sum(2, keepdims=True) + SHORTER)))
    return Spelling(dense[_CLASS], (logs[0] - logs[1]).astype(np.float32).ravel())


def _reader(spelling: Spelling | None):
    def read(data: pa.Array) -> pa.Array:
        texts = [None] * len(data)
        there = np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False))
        place = iter(there)
        for some, batch in _batches(data.drop_null().to_pylist()):
            charset = _judged(batch)
            if spelling is None:
                script = np.where(charset < 0, np.where(_by_letters(batch), 1, 2), charset)
            else:
                known = batch.sums(spelling.lead[batch.codes(spelling.classes, int(spelling.classes.max()) + 1)])
                script = np.where(charset == 0, 0, np.where(known >= 0, 1, 2))
            for file, s, i in zip(some, script, place):
                texts[i] = codecs.charmap_decode(file, "replace", _TABLES[SETS[s]])[0]
        return pa.array(texts, pa.string())

    read.__annotations__ = {"data": pa.Array, "return": pa.Array}  # Spark reads the kind of function from these
    return F.arrow_udf(read, "string")


def eight_bit(data: Column) -> Column:
    """Bytes of an unknown 8-bit set as text of the likeliest one. Cyrillic and Greek use the same bytes for most letters: which of
    them it is depends on how common the letters are."""
    return _reader(None)(data)


def eight_bit_of(files: DataFrame):
    """eight_bit for the files of one import, files(data): those whose set is sure tell how either script is spelled there, and that decides for all
    others, however short. A batch holds few files: this stays set in the session."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(HELD))
    return _reader(_learned(files))
