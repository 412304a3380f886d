"""Phrase collocations: exact counts of frequent phrases, scored by their weakest cut.

Method. Phrases of m words are counted only where all their parts of m - 1 words are frequent
(Apriori: a part occurs at least as often as the phrase). The counts of a range of keys are arrays:
every sender's grams are first counted by hashed bucket, and only grams of buckets that reach the least
count become candidates (no frequent gram is lost, as a bucket counts at least its grams). A minimal
perfect hash (:class:`MinimalPerfectHash`) gives each candidate a slot; a gram looked up is compared
with the key stored in its slot, so others count nowhere. Each sender's grams become one
``numpy.bincount`` array over the slots, and the arrays are added up as a tree. Words and phrases are
known by the slots of their words from then on, and the counts of cut parts are read by slots.

Execution. Everything is linear in the text and bounded in a task, at any size:

1. Blocks. Each task cuts its texts into blocks of one language, of BLOCK_BYTES at most (longer texts
   are cut at piece ends), kept as a row: the distinct words with counts, and their sequence.
2. Words. Counts are summed by (lang, word); words that reach the least count get a number ("slot") from
   the shard that holds them. A block gets the numbers of its words by a join on its distinct words.
3. Grams. Tasks count the distinct two-word grams of some blocks at a time and send them, packed, to the
   range of their keys; keys are invertible mixes of two word numbers, so they are exact and even. The
   number of ranges follows from the counted words, so that a range stays near RANGE_GRAMS entries. A
   frequent gram is one entry per sender: no range grows with a gram's frequency.
4. Three-word grams go the same way. Their Apriori filter is a bitmap of FILTER_BITS bits over the
   keys of the frequent two-word grams (16 MB at any size; it only prunes, so a full one loses nothing).
5. Cuts, drops and ranks are joins of the frequent phrases with each other and the words; ranks are
   taken within buckets of a language first, so that no task sorts a language.

Defined cases: null text is empty; a null lang is ``und``; repeated rows count each; words longer than
a block and pieces without an end are read whole; equal scores are ordered by count and then by
phrase; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, release, table
from hirelake.llm.wordhash import U, mix

LEAST, TOP, DROP_PERCENT = 10, 2000, 50
BLOCK_BYTES, HELD_BYTES = 8 << 20, 32 << 20
#: Grams counted together by a task, and entries of a range.
SENT_GRAMS, RANGE_GRAMS = 1 << 21, 1 << 21
BUCKETS, FILTER_BITS = 1 << 20, 27
WORDS_PER_SHARD = 1 << 16
ID_BITS = 31
#: Buckets of a language in the first step of the ranks.
RANK_BUCKETS = 64
#: Lower case A-Z, tab as space and piece ends (fixed characters of the contract) as line breaks.
_READ = bytes(10 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END, _SPACE = 10, 32


# --- minimal perfect hash -----------------------------------------------------------------------


class MinimalPerfectHash:
    """Slots 0..n-1 of n distinct 64-bit keys, in levels: on each, the keys that are alone at their
    place stay and the others go on to the next. Any other key gets some slot, or n."""

    ROOM = 1.5

    def __init__(self, keys: np.ndarray):
        self.n, self.levels, taken = len(keys), [], 0
        while len(keys):
            size = max(8, int(len(keys) * self.ROOM))
            at = self._places(keys, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = np.full(size, -1, np.int64)
            slots[alone] = taken + np.arange(int(alone.sum()))
            taken += int(alone.sum())
            self.levels.append(slots)
            keys = keys[~alone[at]]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), self.n, np.int64), np.arange(len(keys))
        for level, slots in enumerate(self.levels):
            found = slots[self._places(keys[open_], level, len(slots))]
            out[open_[found >= 0]] = found[found >= 0]
            open_ = open_[found < 0]
        return out


def tree_sum(arrays: Iterator[np.ndarray]) -> np.ndarray | None:
    """Sum of arrays by pairs of equal depth; at most a logarithm of them is held."""
    held: list[tuple[int, np.ndarray]] = []
    for array in arrays:
        depth = 0
        while held and held[-1][0] == depth:
            array, depth = held.pop()[1] + array, depth + 1
        held.append((depth, array))
    return sum(a for _, a in held) if held else None


def _hashed(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    return mix(mix(a + U(seed)) + b.astype(U) * U(0xD1342543DE82EF95))


def count_range(chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, total) of the grams (a, b) that reach ``least`` in all senders' (a, b, counts) together."""
    buckets = [(_hashed(a, b) % U(BUCKETS)).astype(np.int64) for a, b, _ in chunks]
    in_bucket = tree_sum(np.bincount(at, c, BUCKETS) for at, (_, _, c) in zip(buckets, chunks, strict=True))
    may = [in_bucket[at] >= least for at in buckets]
    keys = np.empty(sum(int(m.sum()) for m in may), [("a", U), ("b", np.int64)])
    keys["a"], keys["b"] = (np.concatenate([x[i][m] for x, m in zip(chunks, may, strict=True)]) for i in (0, 1))
    keys = np.unique(keys)
    if not len(keys):
        return keys["a"], keys["b"], np.zeros(0, np.int64)
    seed = 1
    while len(np.unique(hashes := _hashed(keys["a"], keys["b"], seed))) < len(keys):
        seed += 1
    mph = MinimalPerfectHash(hashes)
    stored = np.empty_like(keys)
    stored[mph.slots(hashes)] = keys

    def counted(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.minimum(mph.slots(_hashed(a, b, seed)), mph.n - 1)
        own = (stored["a"][at] == a) & (stored["b"][at] == b)
        return np.bincount(at[own], counts[own], mph.n)

    total = tree_sum(counted(a[m], b[m], c[m]) for (a, b, c), m in zip(chunks, may, strict=True))
    keep = total >= least
    return stored["a"][keep], stored["b"][keep], total[keep].astype(np.int64)


# --- blocks -------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Bytes of numbers, all first bytes first: tables and shuffles compress them better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def _numbers(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of BLOCK_BYTES at most that end where pieces end."""
    low = 0
    while len(text) - low > BLOCK_BYTES:
        end = text.rfind(b"\n", low, low + BLOCK_BYTES)
        if end < 0:
            end = text.find(b"\n", low + BLOCK_BYTES)
            if end < 0:
                break
        yield text[low:end]
        low = end + 1
    yield text[low:]


def read_words(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """(distinct words; per occurrence the word's place, complemented at the first word of a piece)."""
    data = np.frombuffer(text, np.uint8)
    inside = (data != _END) & (data != _SPACE)
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    first, last = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(last - first))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes()))
    coded = words.dictionary_encode()
    ends = np.concatenate(([0], np.cumsum(data == _END)))[first]
    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    new = np.diff(ends, prepend=-1) != 0
    return coded.dictionary.cast(pa.string()), np.where(new, ~place, place)


def blocks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(block, lang, words, counts, places): the texts, a row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def out(name: str) -> pa.RecordBatch:
            nonlocal number
            words, places = read_words(b"\n".join(held.pop(name)))
            size.pop(name)
            number += 1
            counts = np.bincount(np.where(places < 0, ~places, places), minlength=len(words))
            columns = [pa.array([number], pa.int64()), pa.array([name], pa.string()), pa.ListArray.from_arrays([0, len(words)], words), pa.array([counts], pa.list_(pa.int64())), pa.array([_planes(places)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "lang", "words", "counts", "places"])

        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for part in _cut(whole.translate(_READ)):
                    if name in held and size[name] + len(part) > BLOCK_BYTES:
                        yield out(name)
                    held.setdefault(name, []).append(part)
                    size[name] = size.get(name, 0) + len(part) + 1
                    if sum(size.values()) > HELD_BYTES:
                        yield out(max(size, key=size.get))
        for name in list(held):
            yield out(name)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, places binary")


def frequent_words(blocks_: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, f, slot) of the words that reach ``least``; slots are below 2**31 and tell apart
    words of all languages."""
    rows = blocks_.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    rows = materialise(rows.where(F.col("f") >= least), "words")
    shards = max(1, -(-rows.count() // WORDS_PER_SHARD))

    def number(shard: pa.Table) -> pa.Table:
        slots = pa.array(np.arange(shard.num_rows, dtype=np.int64) * shards) if not shard.num_rows else pa.array(np.arange(shard.num_rows, dtype=np.int64) * shards + shard["shard"][0].as_py())
        if shard.num_rows * shards >= (1 << ID_BITS) - 1:
            raise ValueError("too many distinct words for the slots' width")
        return shard.select(["lang", "word", "f"]).append_column("slot", slots)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("lang", "word"), F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("shard").applyInArrow(number, "lang string, word string, f long, slot long"), "slots")


def coded_blocks(blocks_: DataFrame, words: DataFrame) -> DataFrame:
    """(coded): per block, 2 (slot + 1) of each word, 0 for words that aren't frequent, plus 1 at the
    first word of a piece."""
    own = blocks_.select("block", "lang", F.posexplode("words").alias("i", "word")).join(words.select("lang", "word", "slot"), ["lang", "word"])
    own = own.groupBy("block").agg(F.collect_list(F.struct("i", "slot")).alias("own"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                places = _numbers(batch.column(0)[row].as_py(), np.int32)
                first = places < 0
                places = np.where(first, ~places, places)
                value = np.zeros(int(places.max(initial=0)) + 1, np.uint32)
                own = batch.column(1)[row].values
                if own is not None and len(own):
                    value[own.field("i").to_numpy()] = (own.field("slot").to_numpy() + 1) << 1
                yield pa.RecordBatch.from_arrays([pa.array([_planes(value[places] | first.astype(np.uint32))], pa.binary())], names=["coded"])

    return blocks_.select("block", "places").join(own, "block", "left").select("places", "own").mapInArrow(code, "coded binary")


# --- grams --------------------------------------------------------------------------------------


def _unmix(x: np.ndarray) -> np.ndarray:
    """What :func:`mix` was given."""
    x = x ^ (x >> U(31)) ^ (x >> U(62))
    x = x * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U(27)) ^ (x >> U(54))
    x = x * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U(30)) ^ (x >> U(60))


def _grams(coded: np.ndarray, filter_: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(key of the first two words, slot of the third or 0) of a block's grams: of two words, or with
    ``filter_`` of three whose pairs pass it."""
    slot, goes_on = (coded >> np.uint32(1)).astype(np.int64) - 1, (coded & np.uint32(1)) == 0
    pair = (slot[:-1] >= 0) & (slot[1:] >= 0) & goes_on[1:]
    at = np.flatnonzero(pair)
    key = mix(slot[at].astype(U) << U(ID_BITS) | slot[at + 1].astype(U))
    if filter_ is None:
        return key, np.zeros(len(key), np.int64)
    bit = key >> U(65 - (len(filter_) * 8).bit_length())
    passes = (filter_[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & np.uint8(1) > 0
    at, key = at[passes], key[passes]
    triple = np.flatnonzero(np.diff(at) == 1)
    return key[triple], slot[at[triple] + 2]


def send_grams(coded: DataFrame, ranges: int, filter_: bytes | None = None) -> DataFrame:
    """(range, a, b, counts): the distinct grams of some blocks each time, packed by key range."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        hashes = a if filter_ is None else _hashed(a, b)
        order = np.argsort(hashes)
        a, b, hashes = a[order], b[order], hashes[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        counts = np.diff(np.append(new, len(a))).astype(np.int32)
        a, b, hashes = a[new], b[new], hashes[new]
        at = ((hashes >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        ends = np.append(cut[1:], len(at))
        blobs = [[_planes(x[low:high]) for low, high in zip(cut, ends, strict=True)] for x in (a, b.astype(np.int32), counts)]
        if filter_ is None:
            blobs[1] = [b""] * len(cut)
        return pa.RecordBatch.from_arrays([pa.array(at[cut], pa.int64()), *[pa.array(x, pa.binary()) for x in blobs]], names=["range", "a", "b", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filter_ is None else np.frombuffer(filter_, np.uint8)
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                held.append(_grams(_numbers(batch.column(0)[row].as_py(), np.uint32), bits))
                size += len(held[-1][0])
                if size >= SENT_GRAMS:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return coded.mapInArrow(run, "range long, a binary, b binary, counts binary")


def frequent_grams(sent: DataFrame, ranges: int, least: int = LEAST) -> DataFrame:
    """(w1, w2, w3, f, bits): slots and counts of the grams that reach ``least``; a range has one more
    row, of nulls, with its part of the filter of two-word grams (their highest bits are the range)."""

    def count(rows: pa.Table) -> pa.Table:
        chunks = []
        for a, b, counts in zip(*(rows[c].to_pylist() for c in ("a", "b", "counts")), strict=True):
            key = _numbers(a, U)
            chunks.append((key, _numbers(b, np.int32).astype(np.int64) if b else np.zeros(len(key), np.int64), _numbers(counts, np.int32)))
        a, b, f = count_range(chunks, least)
        pair = _unmix(a)
        at = (a >> U(64 - FILTER_BITS)).astype(np.int64)
        low = int(at.min(initial=1 << FILTER_BITS)) & ~7
        bits = np.zeros(int(at.max(initial=low - 1)) + 1 - low, bool)
        bits[at - low] = True
        bits = low.to_bytes(4, "little") + np.packbits(bits, bitorder="little").tobytes()
        more = lambda x: pa.concat_arrays([pa.array(x.astype(np.int64)), pa.nulls(1, pa.int64())])
        columns = [more(x) for x in (pair >> U(ID_BITS), pair & U((1 << ID_BITS) - 1), b, f)]
        return pa.table([*columns, pa.array([None] * len(f) + [bits], pa.binary())], names=["w1", "w2", "w3", "f", "bits"])

    return sent.groupBy("range").applyInArrow(count, "w1 long, w2 long, w3 long, f long, bits binary")


def gram_filter(grams: DataFrame) -> bytes:
    """The bitmap of the frequent two-word grams, put together from their ranges' parts."""
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in grams.where("bits IS NOT NULL").select("bits").toLocalIterator():
        low, part = int.from_bytes(row.bits[:4], "little") >> 3, np.frombuffer(row.bits, np.uint8, offset=4)
        bits[low : low + len(part)] |= part
    return bits.tobytes()


# --- scores -------------------------------------------------------------------------------------


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact: products have up to 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, drop_percent: int = DROP_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two and three words."""
    cut = materialise(blocks(docs, text, lang), "blocks")
    sums = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    n = materialise(cut.groupBy("lang").agg(F.sum(sums).alias("n")), "sums")
    words = frequent_words(cut, least)
    coded = materialise(coded_blocks(cut, words), "coded")
    release(cut)
    total = n.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_GRAMS))
    two = materialise(frequent_grams(send_grams(coded, ranges), ranges, least), "twos")
    three = materialise(frequent_grams(send_grams(coded, ranges, gram_filter(two)), ranges, least), "threes").where("f IS NOT NULL").drop("bits")
    release(coded)
    two = two.where("f IS NOT NULL").select("w1", "w2", "f")

    f = lambda name, by: words.select(F.col("slot").alias(by), F.col("f").alias(name))
    pair = lambda name, first, second: two.select(F.col("w1").alias(first), F.col("w2").alias(second), F.col("f").alias(name))
    inside = three.select("f", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p")).groupBy("p.w1", "p.w2").agg(F.max("f").alias("longer"))
    twos = two.withColumnRenamed("f", "a").join(inside, ["w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < drop_percent * F.col("a")))
    twos = twos.join(f("l", "w1"), "w1").join(f("r", "w2"), "w2").select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    threes = three.withColumnRenamed("f", "a").join(pair("f12", "w1", "w2"), ["w1", "w2"]).join(pair("f23", "w2", "w3"), ["w2", "w3"]).join(f("f1", "w1"), "w1").join(f("f3", "w3"), "w3")
    threes = threes.withColumns({"one": _score("a", "f1", "f23"), "two": _score("a", "f12", "f3")})
    early = F.col("one") <= F.col("two")
    threes = threes.select("w1", "w2", "w3", "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("one", "two").alias("score"))
    phrases = twos.unionByName(threes)
    for i in (1, 2, 3):
        spelled = words.select(F.col("slot").alias(f"w{i}"), F.col("word").alias(f"word{i}"), *(["lang"] if i == 1 else []))
        phrases = phrases.join(spelled, f"w{i}", "left")
    phrases = phrases.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "l", "r", "score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))).orderBy(*order)
    best = phrases.withColumn("at", F.row_number().over(dealt)).where(F.col("at") <= top).drop("at")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS p, row
  FROM (SELECT *, row_number() OVER () AS row, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS x FROM documents)
), spelled AS (
  SELECT lang, row, p, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT lang, row, p, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM pieces)
), grams AS (
  SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM spelled WINDOW o AS (PARTITION BY row, p ORDER BY i)
), one AS (SELECT lang, w, count(*) AS f FROM grams GROUP BY ALL),
two AS (SELECT lang, w, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w, w2, max(f) AS f FROM (SELECT lang, w, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
scored AS (
  SELECT t.lang, t.w || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * t.f * t.f) // (x.f::HUGEINT * y.f) AS score
  FROM two t JOIN one x ON x.lang = t.lang AND x.w = t.w JOIN one y ON y.lang = t.lang AND y.w = t.w2
  LEFT JOIN longer g ON g.lang = t.lang AND g.w = t.w AND g.w2 = t.w2 WHERE g.f IS NULL OR 100 * g.f < 50 * t.f
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (
    SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
           (1000000::HUGEINT * t.f * t.f) // (x.f::HUGEINT * yz.f) AS s1, (1000000::HUGEINT * t.f * t.f) // (xy.f::HUGEINT * z.f) AS s2
    FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w JOIN one z ON z.lang = t.lang AND z.w = t.w3
    JOIN two xy ON xy.lang = t.lang AND xy.w = t.w AND xy.w2 = t.w2 JOIN two yz ON yz.lang = t.lang AND yz.w = t.w2 AND yz.w2 = t.w3
  )
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored),
n AS (SELECT lang, count(*) AS n FROM grams GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
