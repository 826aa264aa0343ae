"""Language identification with interpolated Kneser-Ney character models (operator 10).

Each language has a character model of order four over the letters and marks of any script, lower-cased; all else is one
boundary between words. Spark counts the four-grams of all training texts, and from these, by grouping, the distinct
contexts that the lower orders are made of. All orders are interpolated down to a uniform choice among all symbols, so
every text has a probability. A model is a few sorted arrays: hashes of n-grams, and for each the languages it was seen
in with their terms; what a language hasn't seen takes no room. A text gets the language of the lowest cross-entropy per
symbol.

Rejection is calibrated on training texts that the models have not learned from (a hash share of them, in every
language): how far a text's cross-entropy may lie above its language's mean follows from the spread of these texts, by
their length, and from a quantile of all their deviations. Spark adds these up; a few numbers a language are collected.

Null texts, empty texts and texts without a letter get ``und`` with score 0 and are rejected. Rows with a null language
or text teach nothing. Without training rows every text is ``und``. A language no kept text of which was recognised
rejects nothing. Repeated rows are scored alike; ties go to the language that is first by name.

Broadcast: at most 2**hash_bits entries a language and order whatever the corpus. Hashes that coincide add up, so an n-gram that was never seen takes a seen one's share with a probability of the
number of entries over 2**hash_bits; the probabilities sum to one but for that.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noema.llm import textkit as K
from noema.llm.staging import Staging, fresh, prepare

UNDETERMINED = "und"
ORDER = 4
#: Symbols are 16 bits: code points, and those above folded into the private-use range, where no letter is.
SYMBOLS = 1 << 16
_kinds: np.ndarray | None = None


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    #: One in so many training texts is kept from the models, for the calibration.
    kept: int = 5
    #: Quantile of the deviations of kept texts, and the factor by which a text may exceed it.
    quantile: float = 0.999
    margin: float = 1.5
    #: Kept texts of all languages that a language's own spread is mixed with, as a number of texts.
    prior: float = 20.0
    hash_bits: int = 24
    chunk_chars: int = 1 << 19


def training_rows(doc_id: Column) -> Column:
    """True for the documents to learn from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _table() -> np.ndarray:
    """0 for a boundary, 1 for a mark, 2 for a letter, by code point."""
    global _kinds
    if _kinds is None:
        _kinds = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], dtype=np.uint8)
    return _kinds


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each word followed by one boundary; each symbol's row; and whether a row has a letter."""
    texts = [t.lower() for t in texts]
    joined = "".join(t + "\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = _table()[points]
    code = np.where(points < SYMBOLS, points, 0xE000 + points % 0x1900).astype(np.uint64)
    code[kind == 0] = 0
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    rows = np.repeat(np.arange(len(texts)), lengths)
    letters = np.zeros(len(texts), dtype=bool)
    letters[rows[kind == 2]] = True
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    return code[keep], rows[keep], letters


def fourgrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The four-gram (64 bits) that ends at each symbol, the symbol's row, and whether a row has a letter. Before a
    text there are boundaries."""
    code, rows, letters = symbols(texts)
    if not len(code):
        return code, rows, letters
    fresh_row = np.ones(len(code), dtype=bool)
    fresh_row[1:] = rows[1:] != rows[:-1]
    start = np.flatnonzero(fresh_row)
    since = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
    key = code.copy()
    for back in range(1, ORDER):
        past = np.zeros_like(code)
        past[back:] = code[:-back]
        past[since < back] = 0
        key |= past << np.uint64(16 * back)
    return key, rows, letters


def _batched(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, list[str]]]:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if len(texts) > first:
        yield first, texts[first:]


def count_fourgrams(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, key, n) over all texts of rows(text, lang): tasks add up their own counts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts):
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def out(lang, keys, n):
            for i in range(0, len(keys), 1 << 16):
                own = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys[own]), pa.string()), pa.array(keys[own].view(np.int64)), pa.array(n[own])], ["lang", "key", "n"]
                )

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, texts in _batched(batch, "text", settings.chunk_chars):
                own = langs[first : first + len(texts)]
                for lang in dict.fromkeys(own):
                    keys, n = np.unique(fourgrams([t for t, x in zip(texts, own) if x == lang])[0], return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((keys, n))
                    if len(parts) > 16:
                        held[lang] = [merge(parts)]
                        if len(held[lang][0][0]) > 1 << 21:  # a task holds so many at most
                            yield from out(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield from out(lang, *merge(parts))

    parts = rows.select("text", "lang").mapInArrow(count, "lang string, key long, n long")
    return parts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _hash(keys: np.ndarray, order: int, bits: int) -> np.ndarray:
    salt = np.uint64(order * K.BASES[0] & (1 << 64) - 1)
    return (K.mix(keys + salt) >> np.uint64(64 - bits)).astype(np.uint32)


@dataclass
class Table:
    """Sorted hashes, and for each the entries (language, value) in places edges[i] to edges[i + 1]."""

    keys: np.ndarray
    edges: np.ndarray
    langs: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, values: np.ndarray) -> Table:
        order = np.lexsort((langs, keys))
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        return cls(keys[first], np.append(first, len(keys)), langs[order].astype(np.int16), values[order].astype(np.float32))

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in keys, language, value) of all entries of the keys that are there."""
        if not len(self.keys):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0, dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[at] == keys)
        begin, size = self.edges[at[found]], self.edges[at[found] + 1] - self.edges[at[found]]
        where = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(found, size), self.langs[where], self.values[where]


@dataclass
class Model:
    langs: list[str]
    grams: list[Table]  # by order: the discounted share of an n-gram in its context
    rests: list[Table]  # by order: what a context leaves to the lower orders
    bits: int
    spread: np.ndarray | None = None  # by language: mean, variance, and variance times length of kept texts
    bound: float = np.inf  # of the deviation from the mean, in units of the spread

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        """P(last symbol | the three before it) of four-grams, by language."""
        p = np.full((len(keys), len(self.langs)), 1 / SYMBOLS, dtype=np.float32)
        for order in range(1, ORDER + 1):
            own = keys & np.uint64((1 << 16 * order) - 1)
            for table, key, add in ((self.rests[order - 1], own >> np.uint64(16), False), (self.grams[order - 1], own, True)):
                at, lang, value = table.entries(_hash(key, order, self.bits))
                if add:
                    p[at, lang] += value
                else:
                    p[at, lang] *= value
        return p

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per symbol by text and language, the number of symbols, and whether a text has a letter."""
        key, rows, letters = fourgrams(texts)
        n = np.bincount(rows, minlength=len(texts)).astype(np.int64)
        total = np.zeros((len(texts), len(self.langs)))
        if len(key) and self.langs:
            distinct, number = np.unique(key, return_inverse=True)
            values = np.log(self.probabilities(distinct))[number]
            edges = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            total[rows[edges]] = np.add.reduceat(values, edges, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n, letters

    def rejected(self, lang: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.spread is None:
            return np.zeros(len(lang), dtype=bool)
        mean, fixed, by_length = self.spread[lang].T
        return entropy - mean > self.bound * np.sqrt(fixed + by_length / np.maximum(n, 1))


def estimate(counts: DataFrame, settings: Settings = Settings()) -> Model:
    """Interpolated Kneser-Ney terms of counts(lang, key, n), by order; lower orders count distinct contexts."""
    spark = counts.sparkSession
    stage = Staging(spark, "langid")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(langs)}
    grams, rests = [], []
    current = counts.select("lang", "key", "n")
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            # the distinct symbols before an n-gram
            mask = (1 << 16 * order) - 1
            current = current.groupBy("lang", F.col("key").bitwiseAND(F.lit(mask).cast("long")).alias("key")).agg(F.count("*").alias("n"))
        current = stage.save(current, f"grams{order}")
        # a context's total and its number of different symbols
        context = current.groupBy("lang", F.shiftrightunsigned("key", 16).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        context = stage.save(context, f"contexts{order}")
        shares = current.withColumn("context", F.shiftrightunsigned("key", 16)).join(context, ["lang", "context"])
        own = shares.select("lang", "key", ((F.col("n") - settings.discount) / F.col("total")).alias("value"))
        rest = context.select("lang", F.col("context").alias("key"), (settings.discount * F.col("kinds") / F.col("total")).alias("value"))
        for frame, into in ((own, grams), (rest, rests)):
            into.insert(0, _collected(frame, number, order, settings.hash_bits))
    stage.close()
    return Model(langs, grams, rests, settings.hash_bits)


def _collected(frame: DataFrame, number: dict[str, int], order: int, bits: int) -> Table:
    """The entries of frame(lang, key, value), added up by hash in tasks before they are collected, so that at most
    2**bits a language arrive."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _hash(batch.column("key").to_numpy().view(np.uint64), order, bits).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(h), batch.column("value")], ["lang", "h", "value"])

    rows = frame.mapInArrow(hashed, "lang string, h int, value double").groupBy("lang", "h").agg(F.sum("value").alias("value")).toArrow()
    if not rows.num_rows:
        return Table.of(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int16), np.zeros(0))
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    lang = np.array([number[x] for x in coded.dictionary.to_pylist()], dtype=np.int16)[coded.indices.to_numpy()]
    return Table.of(rows.column("h").to_numpy().astype(np.uint32), lang, rows.column("value").to_numpy())


def calibrate(kept: DataFrame, model: Model, settings: Settings = Settings()) -> None:
    """Set the model's spread and bound from texts it has not learned from, kept(text, lang)."""
    stage = Staging(kept.sparkSession, "langid")
    scored = score(kept.select("text", "lang"), model, settings).where("lang_pred = lang").select("lang", F.col("cross_entropy").alias("x"), F.col("n_symbols").cast("double").alias("n"))
    scored = stage.save(scored, "kept")
    by_lang = scored.groupBy("lang").agg(F.avg("x").alias("mean"), F.count("*").alias("m"))
    own = scored.join(by_lang.select("lang", "mean"), "lang").withColumn("d", F.pow(F.col("x") - F.col("mean"), 2))
    # variance is fixed + by_length / n: least squares of d on 1 / n, by sums
    inverse = 1 / F.col("n")
    sums = own.groupBy("lang").agg(
        F.first("mean").alias("mean"), F.count("*").alias("m"), F.sum("d").alias("d"), F.sum(inverse).alias("i"), F.sum(inverse * inverse).alias("ii"), F.sum(inverse * F.col("d")).alias("id")
    ).collect()
    if not sums:
        stage.close()
        return

    def fitted(m, d, i, ii, x):
        slope = max(0.0, (m * x - i * d) / v) if (v := m * ii - i * i) > 1e-12 else 0.0
        return max(1e-4, (d - slope * i) / m), slope

    every = fitted(*(sum(r[k] for r in sums) for k in ("m", "d", "i", "ii", "id")))
    spread = np.full((len(model.langs), 3), np.inf)
    for r in sums:
        own_fit = fitted(*(r[k] for k in ("m", "d", "i", "ii", "id")))
        share = r["m"] / (r["m"] + settings.prior)
        # the mean of few texts is uncertain itself
        both = [(share * a + (1 - share) * b) * (1 + 1 / r["m"]) for a, b in zip(own_fit, every)]
        spread[model.langs.index(r["lang"])] = (r["mean"], *both)
    spread[~np.isfinite(spread).all(1)] = (0.0, np.inf, 0.0)
    rows = kept.sparkSession.createDataFrame([(x, *map(float, s)) for x, s in zip(model.langs, spread)], "lang string, mean double, fixed double, slope double")
    z = (F.col("x") - F.col("mean")) / F.sqrt(F.col("fixed") + F.col("slope") / F.col("n"))
    bound = scored.join(F.broadcast(rows), "lang").agg(F.percentile_approx(z, settings.quantile, 100_000)).first()[0]  # a row a language
    stage.close()
    model.spread, model.bound = spread, settings.margin * max(1.0, bound)


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of the languages in rows(text, lang, doc_id), calibrated on the texts it hasn't learned from."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    prepare(rows.sparkSession)
    kept = F.pmod(F.xxhash64("doc_id"), F.lit(settings.kept)) == 0
    stage = Staging(rows.sparkSession, "langid")
    model = estimate(stage.save(count_fourgrams(rows.where(~kept), settings), "counts"), settings)
    if model.langs:
        calibrate(rows.where(kept), model, settings)
    stage.close()
    return model


#: What score() adds to its rows.
ADDED = {"lang_pred": T.StringType(), "score": T.DoubleType(), "cross_entropy": T.DoubleType(), "n_symbols": T.LongType(), "rejected": T.BooleanType()}


def score(rows: DataFrame, model: Model, settings: Settings = Settings(), names: dict[str, str] | None = None, keep_text: bool = False) -> DataFrame:
    """rows with the columns of ADDED (names may rename them), the text only if asked: language, score (0 to 1),
    cross-entropy (nats per symbol), symbols, and whether it is rejected. Columns that have such a name are replaced."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    named = {k: (names or {}).get(k, k) for k in ADDED}
    carried = [f for f in rows.schema.fields if f.name not in named.values() and (keep_text or f.name != "text")]
    text = fresh(rows.columns, "text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for batch in batches:
            pred, conf, best, sizes, out = [], [], [], [], []
            for _, texts in _batched(batch, text, settings.chunk_chars):
                entropy, n, letters = m.cross_entropies(texts)
                if not m.langs:
                    letters = np.zeros(len(texts), dtype=bool)
                    entropy = np.zeros((len(texts), 1))
                j = entropy.argmin(1)
                least = entropy[np.arange(len(j)), j]
                outside = m.rejected(j, least, n) if m.langs else letters
                # posterior of equally likely languages, tempered because symbols depend on each other
                weight = np.exp(-(entropy - least[:, None]) * np.minimum(n, 40)[:, None]).sum(1)
                pred += [m.langs[k] if ok else UNDETERMINED for k, ok in zip(j, letters)]
                conf.append(np.where(letters, np.where(outside, 0.25, 1.0) / weight, 0.0))
                best += [float(x) if ok else None for x, ok in zip(least, letters)]
                sizes.append(n)
                out.append(outside | ~letters)
            flat = lambda x, t: pa.array(np.concatenate([np.zeros(0, dtype=t), *x]).astype(t))
            made = [pa.array(pred, pa.string()), flat(conf, np.float64), pa.array(best, pa.float64()), flat(sizes, np.int64), flat(out, bool)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), *made], [*(f.name for f in carried), *named.values()])

    schema = T.StructType([*carried, *(T.StructField(named[k], t) for k, t in ADDED.items())])
    return rows.select(*(F.col(f"`{f.name}`") for f in carried), F.col("text").alias(text)).mapInArrow(predict, schema)


def keep_identified(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """documents without those whose language is undetermined or rejected.

    Columns of any name stay as they are. Null, empty and letterless texts go; repeated rows stay or go together.
    """
    prepare(documents.sparkSession)
    trained = fit(documents.where(training_rows(F.col("doc_id"))), settings)
    names = {k: fresh(documents.columns, k) for k in ADDED}
    scored = score(documents, trained, settings, names, keep_text=True)
    return scored.where(~F.col(names["rejected"])).select(*(F.col(f"`{c}`") for c in documents.columns))


def identify(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of every document."""
    prepare(documents.sparkSession)
    trained = fit(documents.where(training_rows(F.col("doc_id"))), settings)
    scored = score(documents.select("doc_id", "text"), trained, settings)
    return scored.select(
        "doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )
