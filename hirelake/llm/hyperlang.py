"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs. An n-gram's vector binds its letters': the
element-wise product of the letters' vectors, the j-th last of them permuted (cyclically shifted) j
times, so order counts. A text's vector is the bundle (sum) of the vectors of all its trigrams, a
language's prototype the bundle of the vectors of its training texts; a document gets the language
whose prototype has the largest cosine with its vector.

Text is read as lower-case letters with one gap in place of every run of other characters and at
both ends; a trigram may span a gap, so short words and word ends count too. Letters below U+0800
are themselves, the others share 2048 further symbols by a hash, which bounds the letter table.

Execution. Both passes are map-only Arrow jobs over blocks of documents: trigrams are told apart and
counted (integers), and one matrix product of counts and trigram vectors gives all vectors of a
block. Training blocks add up their counts per language first; each task sends a row per language
and dimension, summed by an ordinary aggregation of whole numbers, so no order or loss of tasks
changes a prototype. Trigram vectors are made where they are needed and never stored or sent. Products
are exact (whole numbers below 2**24 in single precision, added up in double) and cosines are rounded
to 12 digits, so equal texts get equal scores whatever block they are in. Prototypes (languages x DIMENSIONS) travel with the tasks,
LANGUAGES of them at a time; more languages are compared in as many passes, each on the best so far.

The score is the cosine, from 0 on; the smaller name wins ties.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; without any training
text everything is; a null doc_id is hashed as the empty text; very long texts are read whole;
repeated rows are predicted each; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, table

HELD_OUT_MOD, HELD_OUT_REST = 3, 1
UNKNOWN = "und"
DIMENSIONS, SEED = 1024, 11
SYMBOL_BITS = 12
#: Characters and documents of a block, and n-grams of one matrix product.
BLOCK_CHARS, BLOCK_DOCUMENTS, GRAMS = 1 << 20, 256, 1 << 13
#: Languages whose prototypes travel together.
LANGUAGES = 1024


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of every code point: 0 for all that is no letter."""
    own, table_ = 1 << (SYMBOL_BITS - 1), np.zeros(0x110000, np.uint16)
    for point in range(len(table_)):
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            table_[point] = low if low < own else own + low * 0x9E3779B1 % 0xFFFFFFFB % own
    return table_


@lru_cache(1)
def _letter_vectors() -> tuple[np.ndarray, ...]:
    """Sign vectors of the symbols, shifted 2, 1 and 0 times."""
    signs = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (1 << SYMBOL_BITS, DIMENSIONS), np.int8) * np.int8(2) - np.int8(1)
    return tuple(np.roll(signs, shift, axis=1) for shift in (2, 1, 0))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """A row of signs per trigram (its three symbols in one number)."""
    mask = (1 << SYMBOL_BITS) - 1
    first, second, third = _letter_vectors()
    return first[grams >> (2 * SYMBOL_BITS)] * second[(grams >> SYMBOL_BITS) & mask] * third[grams & mask]


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """All texts as lists of pieces of together BLOCK_CHARS at most, and the place of each piece's
    text; every text begins with two gaps, and two more end the last one."""
    parts, owners, size = [], [], 0
    for at, text in enumerate([*texts, ""]):
        for low in range(0, max(len(text), 1), BLOCK_CHARS):
            piece = text[low : low + BLOCK_CHARS] if low else "\0\0" + text[:BLOCK_CHARS]
            if parts and size + len(piece) > BLOCK_CHARS:
                yield parts, owners
                parts, owners, size = [], [], 0
            parts.append(piece)
            owners.append(at)
            size += len(piece)
    yield parts, owners


def grams_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, trigram) of every trigram, in bounded arrays."""
    symbols, held, held_at = _symbols(), np.zeros(0, np.uint16), np.zeros(0, np.int64)
    for parts, owners in _pieces(texts):
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        read, at = symbols[points], np.repeat(owners, [len(p) for p in parts])
        begins = np.zeros(len(read), bool)
        first = np.flatnonzero(np.diff(at, prepend=held_at[-1] if len(held_at) else -1))
        begins[first] = begins[first + 1] = True
        before = np.concatenate((held[-1:] if len(held) else np.zeros(1, np.uint16), read[:-1]))
        keep = (read > 0) | (before > 0) | begins
        read, at = np.concatenate((held, read[keep])), np.concatenate((held_at, at[keep]))
        held, held_at = read[-2:], at[-2:]
        wide = read.astype(np.int64)
        gap = read == 0
        use = ~((gap[:-2] & gap[1:-1]) | (gap[1:-1] & gap[2:]))
        yield at[1:-1][use], (wide[:-2] << (2 * SYMBOL_BITS) | wide[1:-1] << SYMBOL_BITS | wide[2:])[use]


def _told_apart(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct trigrams, place of each trigram among them)."""
    mask, sides = (1 << SYMBOL_BITS) - 1, (2 * SYMBOL_BITS, SYMBOL_BITS, 0)
    used = sum(np.bincount((grams >> side) & mask, minlength=mask + 1) for side in sides)
    met = np.flatnonzero(used)
    if len(met) > 200:
        return np.unique(grams, return_inverse=True)
    place = np.zeros(mask + 1, np.int64)
    place[met] = np.arange(len(met))
    dense = np.zeros(len(grams), np.int64)
    for side in sides:
        dense = dense * len(met) + place[(grams >> side) & mask]
    found = np.flatnonzero(np.bincount(dense, minlength=len(met) ** 3))
    at = np.zeros(len(met) ** 3, np.int32)
    at[found] = np.arange(len(found))
    a, rest = np.divmod(found, len(met) ** 2)
    b, c = np.divmod(rest, len(met))
    return met[a] << sides[0] | met[b] << sides[1] | met[c], at[dense]


def bundles(texts: list[str], owners: np.ndarray, n: int) -> np.ndarray:
    """n x DIMENSIONS sums of the trigram vectors of each owner's texts; exact whole numbers."""
    out = np.zeros((n, DIMENSIONS))
    for at, grams in grams_of(texts):
        if not len(grams):
            continue
        distinct, place = _told_apart(grams)
        counts = np.bincount(owners[at] * len(distinct) + place, minlength=n * len(distinct)).reshape(n, -1)
        for low in range(0, len(distinct), GRAMS):  # fewer than 2**24 trigrams: exact in single precision
            out += counts[:, low : low + GRAMS].astype(np.float32) @ gram_vectors(distinct[low : low + GRAMS]).astype(np.float32)
    return out


def _blocks(texts: list[str]) -> Iterator[slice]:
    """Runs of documents of BLOCK_CHARS (or one document) and BLOCK_DOCUMENTS at most."""
    low = size = 0
    for i, text in enumerate(texts):
        if i > low and (size + len(text) > BLOCK_CHARS or i - low == BLOCK_DOCUMENTS):
            yield slice(low, i)
            low, size = i, 0
        size += len(text)
    if texts:
        yield slice(low, len(texts))


# --- prototypes ---------------------------------------------------------------------------------


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % HELD_OUT_MOD == HELD_OUT_REST


def prototypes(training: DataFrame) -> DataFrame:
    """(lang, i, value): the bundle of each language's texts. ``training``: text, lang, without nulls."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            values = pa.array([v.astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), values], names=["lang", "values"])

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for cut in _blocks(texts):
                names, owners = np.unique(np.array(langs[cut], object), return_inverse=True)
                for name, sum_ in zip(names, bundles(texts[cut], owners, len(names)), strict=True):
                    sums[name] = sums[name] + sum_ if name in sums else sum_
                if len(sums) > LANGUAGES:
                    yield out()
                    sums.clear()
        yield out()

    sums = training.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(learn, "lang string, values array<long>")
    return sums.select("lang", F.posexplode("values").alias("i", "value")).groupBy("lang", "i").agg(F.sum("value").alias("value"))


# --- prediction ---------------------------------------------------------------------------------


def _compare(df: DataFrame, names: list[str], profiles: np.ndarray, last: bool) -> DataFrame:
    """(key, text unless ``last``, best_lang, best) with the best of ``names`` and of earlier passes."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, best = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for cut in _blocks([t or "" for t in texts]):
                read = [t or "" for t in texts[cut]]
                vectors = bundles(read, np.arange(len(read) + 1), len(read) + 1)[:-1]
                length = np.sqrt((vectors * vectors).sum(axis=1))
                cosines = np.round(np.maximum(vectors @ profiles.T, 0) / np.maximum(length, 1)[:, None], 12)
                most = cosines.argmax(axis=1)
                for i in np.flatnonzero(length).tolist():
                    at, score = cut.start + i, float(min(cosines[i, most[i]], 1.0))
                    if langs[at] is None or score > best[at]:
                        langs[at], best[at] = names[most[i]], score
            found = [pa.array(langs, pa.string()), pa.array(best, pa.float64())]
            columns = [batch.column(0), *([] if last else [batch.column(1)]), *found]
            yield pa.RecordBatch.from_arrays(columns, names=["key", *([] if last else ["text"]), "best_lang", "best"])

    kind = df.schema["key"].dataType.simpleString()
    return df.select("key", "text", "best_lang", "best").mapInArrow(predict, f"key {kind}{'' if last else ', text string'}, best_lang string, best double")


def identify(docs: DataFrame, learned: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, best_lang, best) of every document, by prototypes (lang, i, value)."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.lit(None).cast("string").alias("best_lang"), F.lit(0.0).alias("best"))
    names = [r.lang for r in learned.select("lang").distinct().orderBy("lang").collect()]
    for low in range(0, len(names), LANGUAGES):
        part = names[low : low + LANGUAGES]
        values = learned.where(F.col("lang").between(part[0], part[-1])).select("lang", "i", "value").toPandas()
        profiles = np.zeros((len(part), DIMENSIONS))
        profiles[np.searchsorted(part, values["lang"].to_numpy()), values["i"].to_numpy()] = values["value"].to_numpy()
        profiles /= np.maximum(np.sqrt((profiles * profiles).sum(axis=1, keepdims=True)), 1)
        rows = _compare(rows, part, profiles, low + LANGUAGES >= len(names))
    return rows.select("key", F.coalesce("best_lang", F.lit(UNKNOWN)).alias("best_lang"), "best")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = materialise(prototypes(docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())), "prototypes")
    found = identify(docs, learned).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), F.col("best_lang").alias("lang_pred"), F.col("best").alias("score"))
