"""Language-model scoring by a Katz backoff bigram model with Good-Turing discounts.

Model. Tokens are words (lower-cased A-Z) and one end per text; a text starts in a start context.
P(w) = s*d(c)*c/N for a training word and the left-over mass for the one unknown type;
P(w|v) = d(c(v,w))*c(v,w)/c(v) for a seen pair, else alpha(v)*P(w), with alpha(v) the mass that the
seen pairs leave, divided by 1 - sum of P over the words seen after v; an unseen context backs off
with alpha 1. d are Good-Turing ratios r*/r: Turing's own for small r, those of a log-linear fit of
the counts of counts beyond (simple Good-Turing), so every context keeps mass for the unseen and
all distributions add up to 1 exactly.

Execution. The corpus is cut into blocks of some megabytes of text; a block is kept as a table row
with its vocabulary (56-bit word keys) and tokens. All exchange goes by key range: a block sends
its distinct keys with their training counts, sorted and delta-coded, to the range's reducer, and
gets totals back in the same order. Frequent words and pairs are thus one entry per block, never a
row per occurrence, and no range grows with a key's frequency. The number of ranges follows from the
counted tokens, so that a range holds about RANGE_TOKENS entries at any corpus size; the size of a
block grows with the corpus between two bounds. Ranges and blocks are dealt to partitions by number,
one to a partition while there are at most MOST_PARTITIONS of them, and are read from the sorted
partition one after the other: a task never holds more than one range or one block.

Blocks times ranges would grow with the square of the corpus, and a row shrink to a key. Beyond
DIRECT_RANGES ranges the exchange takes two hops: blocks send to about sqrt(ranges) coarse ranges; a
hub takes one coarse range from as many blocks, adds up what they have in common, and stands for them
before the ranges, with no more keys than a block has; answers come back the same way. At 20 million
ranges (100 TB) a row still has some 500 keys.

1. words and pairs: requests of all blocks -> totals, counts of counts, one owner block per pair
2. blocks with totals -> sums of the tokens whose pair is seen; per context, the mass and the
   unigram mass of the pairs that the block owns; the contexts that its unseen pairs wait for
3. contexts: partial sums -> alpha -> back to the waiting blocks; per-document scores

Tables of every step are partitioned Parquet in the session's shared folder.

Defined cases: null text is empty (its end only); a null doc_id is hashed as the empty text; an
empty training part gives P = 1 for the unknown type (score 0) and base_score by its formula with
N = V = 0; repeated rows and ties are scored each; a text longer than a block is a block of its own,
read whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, release, table
from hirelake.llm.wordhash import U, mix, texts_words

HELD_OUT_MOD = 10
#: Characters of a block: a BLOCKS-th of the corpus, between these bounds. A block of the upper one takes a
#: Python worker under 700 MB.
BLOCK_CHARS, MOST_BLOCK_CHARS, BLOCKS = 8 << 20, 16 << 20, 2048
#: Tokens (an upper bound of the distinct keys that blocks send) per key range.
RANGE_TOKENS = 1 << 20
MOST_PARTITIONS = 100_000
#: Ranges up to which blocks send to ranges themselves; a row has some 250 keys then.
DIRECT_RANGES = 8192
KEY_BITS = 56
#: Turing's ratios are used up to this count, the log-linear fit beyond; the fit reads n_1..n_FIT.
TURING_UP_TO, FIT = 5, 16

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END, START = U(0x656E64), U(0x7374617274)


# --- compact arrays ------------------------------------------------------------------------------


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as zstd-compressed byte planes."""
    import zstandard

    values = np.ascontiguousarray(values, "<u8")
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes()) if len(values) else b""


def _expand(blob: bytes) -> np.ndarray:
    import zstandard

    if not blob:
        return np.zeros(0, U)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _squeeze_sorted(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=U(0)))


def _expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_expand(blob), dtype=U)


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of the key ranges in sorted ``keys``."""
    return np.searchsorted(((keys >> U(KEY_BITS - 32)) * U(ranges)) >> U(32), np.arange(ranges + 1))


def _pairs(vocabulary: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context of each token as a vocabulary index, -1 at a text's start; key of each token's pair)."""
    context = np.concatenate(([0], tokens[:-1])).astype(np.int64)
    context[first] = -1
    left = np.where(context < 0, START, vocabulary[context])
    return context, mix(mix(left + U(0x9E3779B97F4A7C15)) + vocabulary[tokens]) >> U(64 - KEY_BITS)


# --- discounts -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Discounts:
    """Good-Turing ratios r*/r, below 1 for every r."""

    turing: tuple[float, ...]
    slope: float

    @staticmethod
    def fit(n: dict[int, int]) -> Discounts:
        """From counts of counts n_1..n_FIT."""
        seen = [(math.log(r), math.log(n[r])) for r in range(1, FIT + 1) if n.get(r)]
        slope = -2.0
        if len(seen) >= 2:
            mx, my = (sum(x) / len(seen) for x in zip(*seen, strict=True))
            slope = sum((x - mx) * (y - my) for x, y in seen) / sum((x - mx) ** 2 for x, _ in seen)
        slope = min(max(slope, -4.0), -1.05)
        turing = []
        for r in range(1, TURING_UP_TO + 1):
            d = (r + 1) * n.get(r + 1, 0) / (r * n[r]) if n.get(r) else 0.0
            smooth = (1 + 1 / r) ** (slope + 1)
            turing.append(d if 0.05 <= d < 1 and abs(d - smooth) < 0.5 else smooth)
        return Discounts(tuple(turing), slope)

    def of(self, counts: np.ndarray) -> np.ndarray:
        r = np.maximum(counts.astype(float), 1)
        d = (1 + 1 / r) ** (self.slope + 1)
        small = r <= TURING_UP_TO
        d[small] = np.array(self.turing)[r[small].astype(int) - 1]
        return d


@dataclass(frozen=True)
class Katz:
    """What all blocks need to know: a few numbers."""

    tokens: int
    types: int
    words: Discounts
    pairs: Discounts
    scale: float
    unknown: float

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """P(w) for words of the given training counts; 0 is the unknown type."""
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, self.scale * self.words.of(counts) * counts / self.tokens, self.unknown)


# --- steps ---------------------------------------------------------------------------------------


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """Blocks of documents: ids, held-out flags, token counts, vocabulary and tokens."""

    def block(number: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
        words, counts = texts_words([t.translate(_LOWER) for t in texts], SPACE)
        words >>= U(64 - KEY_BITS)
        ends = np.cumsum(counts)
        words = np.insert(words, ends, END)
        vocabulary, tokens = np.unique(words, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([(counts + 1).astype(np.int64)], pa.list_(pa.int64())),
                pa.array([_squeeze_sorted(vocabulary)], pa.binary()),
                pa.array([_squeeze(tokens)], pa.binary()),
                pa.array([len(tokens)], pa.int64()),
            ],
            names=["block", "ids", "held", "lengths", "vocabulary", "tokens", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for doc_id, out, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and size + len(text) > block_chars:
                    yield block(number, ids, held, texts)
                    number, ids, held, texts, size = number + 1, [], [], [], 0
                ids.append(doc_id.as_py())
                held.append(out.as_py())
                texts.append(text)
                size += len(text)
        if texts:
            yield block(number, ids, held, texts)

    return docs.mapInArrow(run, "block long, ids array<long>, held array<boolean>, lengths array<long>, vocabulary binary, tokens binary, n long")


# --- exchange -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How many key ranges there are, and how blocks are numbered without gaps to speak of."""

    ranges: int
    per_task: int
    blocks: int
    #: Coarse ranges, and blocks of a hub; 0 where blocks send to ranges themselves.
    coarse: int = 0

    @staticmethod
    def of(blocks: DataFrame) -> Layout:
        row = blocks.agg(
            F.sum("n").alias("tokens"),
            (F.max(F.shiftright("block", 32)) + 1).alias("tasks"),
            (F.max(F.col("block").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))) + 1).alias("per_task"),
        ).first()
        least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(least, -(-(row.tokens or 0) // RANGE_TOKENS))
        coarse = math.isqrt(ranges - 1) + 1 if ranges > DIRECT_RANGES else 0
        return Layout(ranges, row.per_task or 1, (row.per_task or 1) * (row.tasks or 1), coarse)

    def _number(self):
        return F.shiftright("block", 32) * self.per_task + F.col("block").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))

    def hub(self):
        """The hub of a row of a block and its coarse range ``r``."""
        return F.floor(self._number() / self.coarse) * self.coarse + F.col("r")

    def by_hub(self, rows: DataFrame, *order) -> DataFrame:
        parts = min(-(-self.blocks // self.coarse) * self.coarse, MOST_PARTITIONS)
        return rows.repartitionById(parts, (F.col("hub") % parts).cast("int")).sortWithinPartitions("hub", *order)

    def by_range(self, rows: DataFrame, *order: str) -> DataFrame:
        """Rows dealt by their range number ``r``."""
        parts = min(self.ranges, MOST_PARTITIONS)
        return rows.repartitionById(parts, (F.col("r") % parts).cast("int")).sortWithinPartitions(*order)

    def by_block(self, rows: DataFrame, *order) -> DataFrame:
        parts = min(self.blocks, MOST_PARTITIONS)
        return rows.repartitionById(parts, (self._number() % parts).cast("int")).sortWithinPartitions(*order)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in ``keys``, from sorted batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        start = 0
        for i, value in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
            if value != current:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, current = [], i, value
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _each_group(keys: list[str], answer):
    """A mapInArrow function that turns each run of rows into a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, keys):
            yield from answer(rows).to_batches()

    return run


# --- steps, continued -----------------------------------------------------------------------------


class _Block:
    """A block read back."""

    def __init__(self, row: dict):
        self.number, self.ids = row["block"], row["ids"]
        self.held = np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.vocabulary, self.tokens = _expand_sorted(row["vocabulary"]), _expand(row["tokens"]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.trains = ~self.held[self.owner]
        self.first = np.cumsum(self.lengths) - self.lengths
        self.context, keys = _pairs(self.vocabulary, self.tokens, self.first)
        self.pairs, self.pair_of = np.unique(keys, return_inverse=True)


def _requests(blocks: DataFrame, ranges: int) -> DataFrame:
    """(kind, r, block, keys, counts): each block's distinct words and pairs by key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch.slice(i, 1).to_pylist()[0])
                for kind, keys, of in ((0, b.vocabulary, b.tokens), (1, b.pairs, b.pair_of)):
                    counts = np.bincount(of[b.trains], minlength=len(keys)).astype(U)
                    parts = _cut(keys, ranges)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(parts), pa.int32()),
                            pa.array([r for r, _, _ in parts], pa.int32()),
                            pa.array([b.number] * len(parts), pa.int64()),
                            pa.array([_squeeze_sorted(keys[low:high]) for _, low, high in parts], pa.binary()),
                            pa.array([_squeeze(counts[low:high]) for _, low, high in parts], pa.binary()),
                        ],
                        names=["kind", "r", "block", "keys", "counts"],
                    )

    return blocks.mapInArrow(run, "kind int, r int, block long, keys binary, counts binary")


class _Sent:
    """What several blocks send of one range: their keys one after the other, by block."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("block")
        self.blocks = rows["block"].to_pylist()
        self.keys = [_expand_sorted(x) for x in rows["keys"].to_pylist()]
        self.edges = np.cumsum([0, *map(len, self.keys)])
        self.counts = np.concatenate([_expand(x) for x in rows["counts"].to_pylist()]).astype(np.int64)
        self.distinct, self.at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.totals = np.zeros(len(self.distinct), np.int64)
        np.add.at(self.totals, self.at, self.counts)

    def answers(self, totals: np.ndarray, owned: np.ndarray) -> list[bytes]:
        """Per block 2*total + (1 where it owns the key), in key order; the first block that trains a
        key owns it, if the key is ``owned`` here."""
        owner = np.full(len(self.distinct), len(self.at))
        trained = np.flatnonzero(self.counts)
        np.minimum.at(owner, self.at[trained], trained)
        answer = totals[self.at] * 2 + (owned[self.at] & (owner[self.at] == np.arange(len(self.at))))
        return [_squeeze(answer[i:j].astype(U)) for i, j in zip(self.edges[:-1], self.edges[1:], strict=True)]


def _cut(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, low, high) of the ranges that have sorted ``keys``."""
    bounds = _ranges(keys, ranges)
    return [(int(r), int(bounds[r]), int(bounds[r + 1])) for r in np.flatnonzero(np.diff(bounds))]


def _gathered(ranges: int):
    """A hub's rows (hub, kind) to those that it sends to the ranges in its blocks' place."""

    def answer(rows: pa.Table) -> pa.Table:
        sent = _Sent(rows)
        parts = _cut(sent.distinct, ranges)
        return pa.table(
            {
                "kind": pa.array([rows["kind"][0].as_py()] * len(parts), pa.int32()),
                "r": pa.array([r for r, _, _ in parts], pa.int32()),
                "block": pa.array([rows["hub"][0].as_py()] * len(parts), pa.int64()),
                "keys": pa.array([_squeeze_sorted(sent.distinct[i:j]) for _, i, j in parts], pa.binary()),
                "counts": pa.array([_squeeze(sent.totals[i:j].astype(U)) for _, i, j in parts], pa.binary()),
            }
        )

    return answer


def _handed_on(rows: pa.Table) -> pa.Table:
    """A hub's rows and the ranges' answers to it, to the answers to its blocks."""
    asked = rows.filter(rows["answer"].is_null())
    sent = _Sent(asked)
    got = rows.filter(rows["answer"].is_valid()).sort_by("r")
    answer = np.concatenate([_expand(x) for x in got["answer"].to_pylist()])
    n, kind, part = len(sent.blocks), rows["kind"][0].as_py(), asked["r"][0].as_py()
    return pa.table(
        {
            "block": pa.array(sent.blocks, pa.int64()),
            "kind": pa.array([kind] * n, pa.int32()),
            "r": pa.array([part] * n, pa.int32()),
            "answer": pa.array(sent.answers((answer >> U(1)).astype(np.int64), (answer & U(1)).astype(bool)), pa.binary()),
        }
    )


def _totals(rows: pa.Table) -> pa.Table:
    """Answers of one range, per block or hub; and a row without one that holds the range's counts of counts."""
    sent = _Sent(rows)
    totals, answers = sent.totals, sent.answers(sent.totals, np.ones(len(sent.totals), bool))
    r, n = np.unique(totals[totals > 0], return_counts=True)
    kind, part = rows["kind"][0].as_py(), rows["r"][0].as_py()
    blocks = [*sent.blocks, None]
    return pa.table(
        {
            "kind": pa.array([kind] * len(blocks), pa.int32()),
            "r": pa.array([part] * len(blocks), pa.int32()),
            "block": pa.array(blocks, pa.int64()),
            "answer": pa.array([*answers, b""], pa.binary()),
            "counts": pa.array([[]] * (len(blocks) - 1) + [r.astype(np.int64)], pa.list_(pa.int64())),
            "of_counts": pa.array([[]] * (len(blocks) - 1) + [n.astype(np.int64)], pa.list_(pa.int64())),
        }
    )


def _model(totals: DataFrame) -> Katz:
    """The model's few numbers, summed up from all ranges' counts of counts."""
    history = totals.where(F.col("block").isNull()).select("kind", F.explode(F.arrays_zip("counts", "of_counts")).alias("x")).select("kind", F.col("x.counts").alias("c"), F.col("x.of_counts").alias("n"))
    history = history.groupBy("kind", "c").agg(F.sum("n").alias("n"))
    small = {(x.kind, x.c): x.n for x in history.where(F.col("c") <= FIT).collect()}  # 2 * FIT rows
    words, pairs = (Discounts.fit({c: n for (k, c), n in small.items() if k == kind}) for kind in (0, 1))
    ratio = F.pow(1 + 1 / F.col("c"), F.lit(words.slope + 1))
    for r, d in enumerate(words.turing, 1):
        ratio = F.when(F.col("c") == r, F.lit(d)).otherwise(ratio)
    whole = history.where("kind = 0").agg(F.sum(F.col("c") * F.col("n")).alias("tokens"), F.sum("n").alias("types"), F.sum(F.col("c") * F.col("n") * ratio).alias("mass")).first()
    tokens, types = int(whole.tokens or 0), int(whole.types or 0)
    if not tokens:
        return Katz(0, 0, words, pairs, 1.0, 1.0)
    unknown = min(max(small.get((0, 1), 0), 1) / (tokens + 1), 0.5)
    return Katz(tokens, types, words, pairs, (1 - unknown) * tokens / float(whole.mass), unknown)


def _answer(answers: list[dict], kind: int) -> np.ndarray:
    mine = sorted((a["r"], a["answer"]) for a in answers if a["kind"] == kind)
    return np.concatenate([np.zeros(0, U), *(_expand(x) for _, x in mine)])


def _seen(model: Katz, ranges: int):
    """Step 2: blocks with their totals to document sums (r is null) and context requests (per r)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["block"]):
            b = _Block(rows.slice(0, 1).to_pylist()[0])
            answers = rows.slice(1).select(["kind", "r", "answer"]).to_pylist()
            count = (_answer(answers, 0) >> U(1)).astype(np.int64)
            answer = _answer(answers, 1)
            pair_count, owned = (answer >> U(1)).astype(np.int64), (answer & U(1)).astype(bool)
            p_word = model.unigram(count)
            starts = int(count[np.searchsorted(b.vocabulary, END)])  # a text has one start and one end
            context_count = np.where(b.context < 0, starts, count[b.context])
            c, token_pair = count[b.tokens], pair_count[b.pair_of]
            seen = token_pair > 0
            mass = model.pairs.of(pair_count) * pair_count
            with np.errstate(divide="ignore", invalid="ignore"):
                logs = np.where(seen, np.log10(mass[b.pair_of] / context_count), np.log10(p_word[b.tokens]))
            base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            per_doc = lambda x: np.bincount(b.owner, x, len(b.lengths))  # noqa: B023, E731
            # contexts as keys; the start context has a key of its own
            keys = np.append(b.vocabulary, START)
            wait = np.flatnonzero(~seen & (context_count > 0))
            waits = np.stack([b.owner[wait], np.where(b.context[wait] < 0, len(keys) - 1, b.context[wait])], 1)
            waits, times = np.unique(waits, axis=0, return_counts=True) if len(wait) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            # the first token of each owned pair tells its context and word
            one = np.zeros(len(b.pairs), np.int64)
            one[b.pair_of[::-1]] = np.arange(len(b.tokens))[::-1]
            mine = one[owned]
            context = np.where(b.context[mine] < 0, len(keys) - 1, b.context[mine])
            used = np.bincount(context, mass[owned] / np.maximum(context_count[mine], 1), len(keys))
            words = np.bincount(context, p_word[b.tokens[mine]], len(keys))
            asks = np.zeros(len(keys), bool)
            asks[waits[:, 1]] = True
            need = np.flatnonzero((used > 0) | asks)
            order = need[np.argsort(keys[need], kind="stable")]
            parts = [(r, order[low:high]) for r, low, high in _cut(keys[order], ranges)]
            waiting = {"doc": waits[:, 0].tolist(), "key": keys[waits[:, 1]].astype(np.int64).tolist(), "times": times.tolist()}
            docs = {
                "ids": b.ids, "held": b.held.tolist(), "n_tokens": b.lengths.tolist(), "n_known": per_doc((c > 0).astype(float)).astype(np.int64).tolist(),
                "base": per_doc(base).tolist(), "score": per_doc(logs).tolist(), **waiting,
            }
            none = [None] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b.number] * (len(parts) + 1), pa.int64()),
                    pa.array([None, *(r for r, _ in parts)], pa.int32()),
                    pa.array([None, *(_squeeze_sorted(keys[at]) for _, at in parts)], pa.binary()),
                    pa.array([None, *(np.array([used[at], words[at]], "<f8").tobytes() for _, at in parts)], pa.binary()),
                    pa.array([None, *(np.packbits(asks[at]).tobytes() for _, at in parts)], pa.binary()),
                    pa.array([docs, *none], _DOCS),
                ],
                names=["block", "r", "keys", "sums", "asks", "docs"],
            )

    return run


_DOCS = pa.struct(
    [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())), ("doc", pa.list_(pa.int64())), ("key", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
_DOCS_SQL = "struct<ids:array<long>,held:array<boolean>,n_tokens:array<long>,n_known:array<long>,base:array<double>,score:array<double>,doc:array<long>,key:array<long>,times:array<long>>"


class _Contexts:
    """Contexts of one range, as several blocks or hubs send them: the masses of the pairs that each owns,
    and whether it asks for the backoff weight."""

    def __init__(self, rows: pa.Table):
        self.blocks = rows["block"].to_pylist()
        self.keys = [_expand_sorted(x) for x in rows["keys"].to_pylist()]
        self.asks = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(rows["asks"].to_pylist(), self.keys, strict=True)]
        sums = np.concatenate([np.frombuffer(x, "<f8").reshape(2, -1) for x in rows["sums"].to_pylist()], 1)
        self.distinct, self.at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.sums = np.array([np.bincount(self.at, x, len(self.distinct)) for x in sums])

    def asked(self) -> np.ndarray:
        return np.bincount(self.at, np.concatenate(self.asks), len(self.distinct)) > 0


def _gathered_contexts(ranges: int):
    """A hub's contexts to the rows that it sends to the ranges in its blocks' place."""

    def answer(rows: pa.Table) -> pa.Table:
        sent = _Contexts(rows)
        asks, parts = sent.asked(), _cut(sent.distinct, ranges)
        return pa.table(
            {
                "block": pa.array([rows["hub"][0].as_py()] * len(parts), pa.int64()),
                "r": pa.array([r for r, _, _ in parts], pa.int32()),
                "keys": pa.array([_squeeze_sorted(sent.distinct[i:j]) for _, i, j in parts], pa.binary()),
                "sums": pa.array([np.ascontiguousarray(sent.sums[:, i:j], "<f8").tobytes() for _, i, j in parts], pa.binary()),
                "asks": pa.array([np.packbits(asks[i:j]).tobytes() for _, i, j in parts], pa.binary()),
            }
        )

    return answer


def _alphas(rows: pa.Table) -> pa.Table:
    """Backoff weights of one range's contexts, back to the blocks or hubs that ask for them."""
    sent = _Contexts(rows)
    return _weights_to_blocks(sent, np.log10(np.maximum(1 - sent.sums[0], 1e-9) / np.maximum(1 - sent.sums[1], 1e-9)))


def _handed_on_weights(rows: pa.Table) -> pa.Table:
    """A hub's contexts and the ranges' backoff weights for it, to those for its blocks."""
    sent, got = _Contexts(rows.filter(rows["keys"].is_valid())), rows.filter(rows["keys"].is_null())
    alpha = np.zeros(len(sent.distinct))
    for keys, values in zip(got["key"].to_pylist(), got["alpha"].to_pylist(), strict=True):
        alpha[np.searchsorted(sent.distinct, np.array(keys, np.int64).astype(U))] = values
    return _weights_to_blocks(sent, alpha)


def _weights_to_blocks(sent: _Contexts, alpha: np.ndarray) -> pa.Table:
    edges = np.cumsum([0, *map(len, sent.keys)])
    blocks, found, values = [], [], []
    for i, (number, mask) in enumerate(zip(sent.blocks, sent.asks, strict=True)):
        if mask.any():
            blocks.append(number)
            found.append(sent.keys[i][mask].astype(np.int64))
            values.append(alpha[sent.at[edges[i] : edges[i + 1]][mask]])
    return pa.table({"block": pa.array(blocks, pa.int64()), "key": pa.array(found, pa.list_(pa.int64())), "alpha": pa.array(values, pa.list_(pa.float64()))})


def _finish(model: Katz):
    """Step 3: document sums and the awaited backoff weights to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["block"]):
            docs, got = rows["docs"][0].as_py(), rows.slice(1).select(["key", "alpha"]).to_pylist()
            score = np.array(docs["score"], float)
            if docs["doc"]:
                keys = np.concatenate([np.array(g["key"], np.int64) for g in got])
                alpha = np.concatenate([np.array(g["alpha"], float) for g in got])
                order = np.argsort(keys)
                at = order[np.searchsorted(keys, np.array(docs["key"], np.int64), sorter=order)]
                score += np.bincount(np.array(docs["doc"]), np.array(docs["times"]) * alpha[at], len(score))
            n = len(score)
            columns = [docs["ids"], docs["held"], docs["n_tokens"], docs["n_known"], [model.tokens] * n, docs["base"], score]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def katz_scores(docs: DataFrame, held_out, block_chars: int | None = None) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text) by a model of those where ``held_out`` (a Column) is false."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), "text")
    if block_chars is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        block_chars = min(max(BLOCK_CHARS, total // BLOCKS), MOST_BLOCK_CHARS)
    blocks = materialise(_blocks(rows, block_chars), "blocks")
    layout = Layout.of(blocks)
    requests = _requests(blocks, layout.coarse or layout.ranges)
    if layout.coarse:
        requests = asked = materialise(requests.withColumn("hub", layout.hub()), "asked")
        requests = layout.by_hub(requests, "kind", "block").mapInArrow(_each_group(["hub", "kind"], _gathered(layout.ranges)), "kind int, r int, block long, keys binary, counts binary")
    totals = layout.by_range(requests, "kind", "r", "block")
    totals = totals.mapInArrow(_each_group(["kind", "r"], _totals), "kind int, r int, block long, answer binary, counts array<long>, of_counts array<long>")
    totals = materialise(totals, "totals")
    model = _model(totals)
    answers = totals.where(F.col("block").isNotNull()).select("block", "kind", "r", "answer")
    if layout.coarse:
        answers = asked.unionByName(answers.withColumnRenamed("block", "hub"), allowMissingColumns=True)
        answers = layout.by_hub(answers, "kind").mapInArrow(_each_group(["hub", "kind"], _handed_on), "block long, kind int, r int, answer binary")
    joined = layout.by_block(blocks.unionByName(answers, allowMissingColumns=True), "block", F.asc_nulls_first("kind"), "r")
    seen = materialise(joined.mapInArrow(_seen(model, layout.coarse or layout.ranges), f"block long, r int, keys binary, sums binary, asks binary, docs {_DOCS_SQL}"), "seen")
    release(blocks)
    release(totals)
    contexts = seen.where(F.col("r").isNotNull()).select("block", "r", "keys", "sums", "asks")
    if layout.coarse:
        release(asked)
        sent = contexts.withColumn("hub", layout.hub())
        contexts = layout.by_hub(sent, "block").mapInArrow(_each_group(["hub"], _gathered_contexts(layout.ranges)), "block long, r int, keys binary, sums binary, asks binary")
    weights = "block long, key array<long>, alpha array<double>"
    alphas = layout.by_range(contexts, "r", "block").mapInArrow(_each_group(["r"], _alphas), weights)
    if layout.coarse:
        alphas = sent.unionByName(alphas.withColumnRenamed("block", "hub"), allowMissingColumns=True)
        alphas = layout.by_hub(alphas).mapInArrow(_each_group(["hub"], _handed_on_weights), weights)
    done = seen.where(F.col("r").isNull()).select("block", "docs").unionByName(alphas, allowMissingColumns=True)
    done = layout.by_block(done, "block", F.col("docs").isNull())
    return done.mapInArrow(_finish(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_rows(mod: int = HELD_OUT_MOD):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == 0


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), held_out_rows())
