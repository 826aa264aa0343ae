"""SentencePiece encoding and decoding with a merge-type prefix table (operator 6).

Byte-pair encoding of a string ends in one token that depends on the string alone. For each prefix of a word the
table holds that token: an automaton lists the vocabulary entries which end there, and the one that is compatible
with the last token of the prefix before it is the answer. Ids follow backwards from the end. Two tokens are
compatible if merging their concatenation would give back these two; the test walks their merge histories.

No vocabulary entry has a space mark after another character, so a run of space marks with the word after it is
encoded by itself, and tasks keep a bounded memo of words. Where no entry has a letter beside another kind of character, no
merge crosses such a place either, so new words are put together from runs of one kind, which are far fewer. Runs of marks
have equal scores and merge last, from the left. Characters outside the vocabulary become byte pieces, which never merge.

A null text counts as empty: begin and end ids only. Very long words cost time in proportion to their length.
Repeated rows and ids come out as they went in.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NORMAL, _CONTROL, _USER, _UNUSED, _BYTE = 1, 3, 4, 5, 6
NEVER = 1 << 60
#: Words that a task remembers before it starts anew.
MEMO_WORDS = 500_000


class Memo(dict):
    """A dictionary that computes what it lacks and forgets all when it is full."""

    def __init__(self, make: Callable, limit: int = MEMO_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.make(key)
        if len(key) <= 256:
            self[key] = value
        return value


class PieceModel:
    """A BPE model with byte fallback, read from the bytes of a model file."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        self.bos, self.eos, self.unk = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id, proto.trainer_spec.unk_id
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.sizes = list(map(len, self.pieces))
        if _USER in self.kinds or _UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == _BYTE}
        normal = [(p.score, i) for i, p in enumerate(proto.pieces) if p.type == _NORMAL]
        self.ids = {self.pieces[i]: i for _, i in normal}
        #: Merge order: equal scores share a rank, and then the leftmost pair goes first.
        order = {score: rank for rank, score in enumerate(sorted({s for s, _ in normal}, reverse=True))}
        self.rank = {i: order[score] for score, i in normal}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if not (len(piece) > 1 and set(piece) == {MARK}):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.histories: dict[int, tuple[list, list] | None] = {}
        self.pairs = Memo(self._compatible, 1 << 19)
        self.runs = self._kinds_apart()
        self.segments = Memo(self._segment)
        self.words = Memo(self._word)
        self.texts = Memo(self._decode_word)
        #: Of each id the text it decodes to; None for byte pieces, which are read together.
        self.plain = [None if kind == _BYTE else "" if kind == _CONTROL else " ⁇ " if i == self.unk else piece.replace(MARK, " ") for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds))]

    def _kinds_apart(self) -> re.Pattern:
        """Segments that no vocabulary entry crosses: runs of letters, of other characters, and digits if they stand alone in
        the vocabulary, each with the space marks before it. Letters that an entry joins to another kind count as others."""
        entries = [p.lstrip(MARK) for p in self.ids]
        entries = [p for p in entries if len(p) > 1]
        digits = "" if any(re.search("[0-9]", p) for p in entries) else "0-9"
        odd: set[str] = set()
        while True:
            letter = re.compile(rf"[^\W\d_{re.escape(''.join(sorted(odd)))}]")
            crossed = {a if letter.match(a) else b for p in entries for a, b in zip(p, p[1:]) if bool(letter.match(a)) != bool(letter.match(b))}
            if not crossed:
                break
            odd |= crossed
            if len(odd) > 64:
                return _SEGMENT
        alone = f"{MARK}*[{digits}]{{1,3}}|" if digits else ""
        return re.compile(f"{MARK}*{letter.pattern}+|{alone}{MARK}*(?:(?!{letter.pattern})[^{MARK}{digits}])+|{MARK}+")

    def merge(self, text: str) -> tuple[list[str], list[tuple[int, str, str]]]:
        """Plain merging, for short strings: the pieces and the merges in order."""
        parts, done = list(text), []
        while True:
            best = min(
                ((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None),
                default=None,
            )
            if best is None:
                return parts, done
            k = best[1]
            done.append((best[0], parts[k], parts[k + 1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def history(self, i: int) -> tuple[list, list] | None:
        """Of a token: the pieces at its left and at its right edge, the last first, each with the rank that made
        it and the rank that consumed it; None if merging its own string gives other tokens."""
        if i not in self.histories:
            parts, done = self.merge(self.pieces[i])
            if len(parts) > 1:
                self.histories[i] = None
            else:
                made = {a + b: (rank, a, b) for rank, a, b in done}
                edges = []
                for side in (1, 2):
                    chain, at, until = [], self.pieces[i], NEVER
                    while True:
                        born = made[at][0] if at in made else -1
                        chain.append((at, born, until))
                        if at not in made:
                            break
                        until, at = born, made[at][side]
                    edges.append(chain)
                self.histories[i] = (edges[0], edges[1])
        return self.histories[i]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        after = self.history(pair[1])
        if pair[0] < 0:  # nothing before it, or a character outside the vocabulary
            return after is not None
        before = self.history(pair[0])
        if before is None or after is None:
            return False
        left, right, x, y = before[1], after[0], 0, 0
        while True:
            a, born_a, end_a = left[x]
            b, born_b, end_b = right[y]
            i = self.ids.get(a + b)
            if i is not None:
                rank = self.rank[i]
                # on equal ranks the leftmost merge goes first
                if rank < end_a and rank <= end_b:
                    return False
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                x += 1
            else:
                y += 1

    def _run(self, n: int) -> list[int]:
        """Ids of n space marks: the leftmost pair merges first."""
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and MARK * (sizes[-2] + sizes[-1]) in self.ids:
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return [self.ids[MARK * size] for size in sizes]

    def last_tokens(self, word: str) -> list[int]:
        """The prefix table: the last token of every prefix; -1 for a character outside the vocabulary."""
        last = [-1] * len(word)
        pairs = self.pairs
        found = -1
        for end, (i, size) in self.automaton.iter(word):
            if end != found and pairs[last[end - size] if end >= size else -1, i]:
                last[end] = i
                found = end
        return last

    def _word(self, word: str) -> bytes:
        """Ids of space marks and the word after them as little-endian 32-bit integers."""
        return b"".join(map(self.segments.__getitem__, self.runs.findall(word)))

    def _segment(self, word: str) -> bytes:
        """Ids of one segment (space marks, then other characters)."""
        marks = len(word) - len(word.lstrip(MARK)) if word[0] == MARK else 0
        body = word[marks - 1 :] if marks > 1 else word
        last, sizes, out, end = self.last_tokens(body), self.sizes, [], len(body) - 1
        while end >= 0:
            i = last[end]
            if i >= 0:
                out.append(i)
                end -= sizes[i]
            else:
                out.extend(self.bytes[b] for b in reversed(body[end].encode()))
                end -= 1
        out.reverse()
        if marks > 1:
            if out[0] == self.ids[MARK]:
                out[:1] = self._run(marks)
            else:
                out[:0] = self._run(marks - 1)
        return array("I", out).tobytes()

    def encode_parts(self, text: str) -> list[bytes]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or marked[-1] == MARK:
            return list(map(self.words.__getitem__, _SEGMENT.findall(marked)))
        return [self.words[MARK + w] for w in marked[1:].split(MARK)]

    def encode(self, text: str) -> bytes:
        edge = array("I", [self.bos, self.eos]).tobytes()
        return edge[:4] + b"".join(self.encode_parts(text)) + edge[4:]

    def _decode_word(self, ids: bytes) -> str:
        codes = array("I", ids)
        found = list(map(self.plain.__getitem__, codes))
        if None not in found:
            return "".join(found)
        out, held = [], bytearray()
        for i, text in zip(codes, found):
            if text is None:
                held.append(int(self.pieces[i][1:-1], 16))
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            out.append(text)
        return "".join(out) + (held.decode(errors="replace") if held else "")

    def decode_parts(self, parts: list[bytes]) -> str:
        text = "".join(map(self.texts.__getitem__, parts))
        return text[1:] if text[:1] == " " else text

    def decode(self, ids: bytes) -> str:
        """The text of any ids; the first space mark is the dummy prefix."""
        text = self._decode_word(ids)
        return text[1:] if text[:1] == " " else text


_loaded: dict[str, PieceModel] = {}


def encode_documents(documents: DataFrame, model_path: str, begin: bool = True, keep_ids: bool = False) -> DataFrame:
    """documents with n_tokens, ids_sha256 and decoded_sha256; with keep_ids also the ids (array<int>) and decoded
    text. The model file is read on the driver and broadcast: its size doesn't depend on the data."""
    with open(model_path, "rb") as file:
        blob = file.read()
    key = hashlib.sha256(blob).hexdigest()
    sent = documents.sparkSession.sparkContext.broadcast(blob)
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
    carried = [f for f in documents.schema.fields if f.name not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded.get(key)
        if model is None:
            _loaded.clear()
            model = _loaded[key] = PieceModel(sent.value)
        edge = array("I", [model.bos, model.eos]).tobytes()
        for batch in batches:
            n, coded, plain, ids, decoded = [], [], [], [], []
            for text in batch.column("text"):
                parts = model.encode_parts(text.as_py() or "")
                whole = edge[:4] + b"".join(parts) + edge[4:]
                back = model.decode_parts(parts)
                n.append(len(whole) // 4)
                coded.append(hashlib.sha256(whole).hexdigest())
                plain.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    ids.append(array("I", whole).tolist())
                    decoded.append(back)
            columns = [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
            if keep_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), *columns], [*(f.name for f in carried), *made])

    types = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([*carried, *(T.StructField(k, t) for k, t in zip(made, types))])
    return documents.select(*(f"`{f.name}`" for f in documents.schema.fields)).mapInArrow(run, schema)
