"""Alignment through segments against encoding whole texts."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import takewhile
from pathlib import Path

import pytest
import public_tokenizers

from noema.llm import alignment, queries

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, n_a string, segs string, block string"


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*(Path(p).read_bytes() for p in FILES))


def brute(pair, docs):
    """Every whole text encoded by both libraries, its links by all pairs of overlapping ranges."""
    links, groups, sizes = [], [], []
    for _, text in docs:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        own_a, own_b = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
        if not text or not b"".join(own_a) == b"".join(own_b) == (" " + text).encode():
            a, b, own_a, own_b = [], [], [], []
        spans = []
        for parts in (own_a, own_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        until = [y[1] for y in spans[1]]
        near = [takewhile(lambda j, end=x[1]: spans[1][j][0] < end, range(bisect_right(until, x[0]), len(b))) for x in spans[0]]
        links.append([(a[i], b[j]) for i, js in enumerate(near) for j in js])
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        made, before = [], 0
        after = [[s[1] for s in own] for own in spans]
        for end in ends:
            made.append("|".join(",".join(map(str, ids[bisect_right(own, before) : bisect_right(own, end)])) for ids, own in ((a, after[0]), (b, after[1]))))
            before = end
        groups.append(";".join(made))
        sizes.append((len(a), len(b), len(ends)))
    counts = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), own, g, size in zip(docs, links, groups, sizes):
        out.append((i, *size, len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(g.encode()).hexdigest() if g else "", g))
    return sorted(out, key=repr)


def made(spark, docs, settings=alignment.Settings()):
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in alignment.align(frame, *FILES, settings=settings, keep_groups=True).collect()), key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "a"), (6, "trailing  "), (7, "  leading"), (8, "line\n  two\n\n three\t tab \r\n end"), (9, "it's the dog's 12 345x6 ..."),
    (10, "ünïcode 中文 ☃ 👩‍👩‍👧   nbsp  x　 y   z"), (11, "with ▁ mark and words"), (12, "<|endoftext|> <s> </s> <unk> <0x0A>"), (13, "nul\x00 \x1c sep \x85 nel"),
    (14, "the dog the dog the dog"), (14, "the dog the dog the dog"), (None, "the cat"), (15, "x" * 5000), (16, "é combining ﬁ ligature ½ Ⅳ"), (17, "tab\t\t  mixed \x0b\x0c end"), (18, "mark▁ the dog"),
]


def test_against_whole_texts(spark, pair):
    draw = random.Random(5)
    letters = ["a", "the", " ", "  ", "\n", "\t", "'s", ".", "12", "é", "中", " ", "▁" if draw.random() < 0 else "_", "Wort", "://", "👍", " ", "-"]
    docs = ODD + [(100 + i, "".join(draw.choice(letters) for _ in range(draw.randint(1, 80)))) for i in range(300)]
    want = brute(pair, docs)
    assert made(spark, docs) == want
    assert made(spark, docs, alignment.Settings(block_chars=50, broadcast_rows=0)) == want


def test_documents(spark, sf_dir, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_token_alignment(spark, sf_dir).collect()), key=repr) == [r[:-1] for r in brute(pair, rows)]


def test_cuts(pair):
    """Cuts stand where no entry reaches across; without that proof a text is one segment."""
    assert pair.cuts and pair.segments("one  two\n three ") == ["one", " two\n three", ""] and pair.segments("a b ") == ["a", "b", ""]
    assert pair.segments("  a b") == ["  a", "b"]
    assert alignment._spaced("a b") and not alignment._spaced("  b") and not alignment._spaced("\n b") and alignment._spaced("b ")
    whole = alignment.Pair(*(Path(p).read_bytes() for p in FILES))
    whole.cuts = False
    assert whole.segments("one two") == ["one two"]


def test_empty(spark):
    assert made(spark, []) == []
    assert {r[1:8] for r in made(spark, [(1, None), (2, "▁")])} == {(0, 0, 0, 0, 0, 0, "")}
