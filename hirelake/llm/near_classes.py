"""Classes of near-duplicate texts by banded signatures and exact verification.

A :class:`Likeness` says how a text is signed and how two texts are compared. The rest is common:

1. Map: each document's text key (md5), signature and band keys. Equal texts become one node.
2. Buckets: band keys shared by several texts. Everything below works on those texts only.
3. Star rounds: in each bucket every text is paired with one centre of another class (another
   centre each round); pairs whose signatures agree enough are verified exactly, and verified
   pairs unite classes. A group of any size costs a few pairs per member and is then one class,
   whose members are not compared again.
4. Rest: in buckets that still hold several classes, all texts of different classes are compared
   block by block: signatures in numpy, then, for those that agree enough, the texts themselves.
   Only links leave a task. So no partner is capped, and no group is expanded into its pairs. The
   comparisons of signatures grow with the product of the classes that share a bucket, never with
   the square of one class.

Where texts share band keys mostly by chance (``sparse``), step 2 first drops from each bucket the texts
that have no other text of a like length there, or agree enough with none: nothing later would link them there. Band keys are then worked
out from the signatures of the distinct texts and meet once, as pairs of numbers in one exchange.

Classes are the connected components of links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import free_names, materialise
from hirelake.llm.components import components

#: Rounds of stars, and partners (those sharing the most buckets) that a text is compared with in
#: each; what stars leave apart is compared exhaustively afterwards.
STAR_ROUNDS, STAR_PARTNERS = 3, 2
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Rows of 16-byte keys up to which a table is broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 200_000
#: Characters of text per numpy batch.
BATCH_CHARS = 1 << 21
#: Texts of a bucket up to which all its pairs are compared by signatures before anything else (``sparse``).
SMALL_BUCKET = 16


class Likeness(Protocol):
    """How texts are signed and compared. ``dtype`` and ``size`` describe a signature row. One that has
    ``keys_of`` is sparse, see the module; its signatures are rows of bits (0 or 1), and ``far`` tells which
    lengths no two texts alike have."""

    dtype: type
    size: int
    least_agreement: float

    def sign(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a text has a signature, signature rows, rows of 64-bit band keys)."""

    def prepare(self, texts: list[str]) -> list[Any]:
        """What :meth:`alike` compares, of each text."""

    def alike(self, a: Any, b: Any) -> bool:
        """The exact test."""


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def text_key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _batches(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 64
        if size >= limit or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def _sparse(how: Likeness) -> bool:
    return hasattr(how, "keys_of")


def _rows(blobs: Iterable[bytes], how: Likeness) -> np.ndarray:
    """Signature rows as they were signed; bits are stored packed."""
    data = b"".join(blobs)
    if _sparse(how):
        return np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, -(-how.size // 8)), axis=1, count=how.size)
    return np.frombuffer(data, how.dtype).reshape(-1, how.size)


def sign(docs: DataFrame, how: Likeness) -> DataFrame:
    """(doc_id, tkey, signature, characters, band keys) of every document; those of a sparse likeness are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for start, part in _batches(texts):
                has, rows, keys = how.sign(part)
                if _sparse(how):
                    rows, keys = np.packbits(rows, axis=1), [None] * len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(part)),
                        batch.column(1).slice(start, len(part)),
                        pa.array([s.tobytes() if h else None for s, h in zip(rows, has, strict=True)], pa.binary()),
                        pa.array([len(t) for t in part], pa.int64()),
                        pa.array([k.view(np.int64) if h and k is not None else None for k, h in zip(keys, has, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "tkey", "sig", "chars", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), "text").mapInArrow(run, "doc_id long, tkey binary, sig binary, chars long, bands array<long>")


def _share(how: Likeness):
    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        return pd.Series((_rows(a, how) == _rows(b, how)).mean(1))

    return share


def _agree(pairs: DataFrame, sigs: DataFrame, how: Likeness) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""
    with_a = pairs.join(sigs.select(F.col("tkey").alias("a"), F.col("sig").alias("sig_a")), "a")
    with_b = with_a.join(sigs.select(F.col("tkey").alias("b"), F.col("sig").alias("sig_b")), "b")
    return with_b.where(_share(how)("sig_a", "sig_b") >= how.least_agreement).select("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame, how: Likeness) -> DataFrame:
    """The pairs that pass the exact test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for low in range(0, len(left), 128):
                both = how.prepare(left[low : low + 128] + right[low : low + 128])
                half = len(both) // 2
                keep += [low + i for i in range(half) if how.alike(both[i], both[half + i])]
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    with_a = pairs.join(texts.select(F.col("tkey").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("tkey").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _unite(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (tkey, cls) after joining the classes that ``links`` (a, b) connect."""
    a, b = (classes.select(F.col("tkey").alias(x), F.col("cls").alias(f"cls_{x}")) for x in "ab")
    edges = links.join(a, "a").join(b, "b").where("cls_a != cls_b").select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
    edges = materialise(edges, "class-edges")
    if not edges.limit(1).count():
        return classes
    roots = components(edges).select(F.col("node").alias("cls"), "root")
    return materialise(classes.join(roots, "cls", "left").select("tkey", F.coalesce("root", "cls").alias("cls")), "classes")


def _deal(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(bk, grp, block, tkey, cls) of the texts in buckets that hold several classes.

    A class that fills blocks of its own in a bucket is a group (``grp`` is its name); the texts of
    all smaller classes of the bucket are one group together (empty name). Groups are cut into
    blocks of about BLOCK texts and BLOCK_BYTES of text, whichever are fewer texts.
    """
    mixed = members.groupBy("bk").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("bk")
    rows = materialise(members.join(mixed, "bk").join(texts.select("tkey", "size"), "tkey"), "several")
    own = rows.groupBy("bk", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    fills = (F.col("n") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES)
    own = materialise(own.withColumn("grp", F.when(fills, F.col("cls")).otherwise(F.lit(b""))), "own")
    parts = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("bytes") / BLOCK_BYTES, F.lit(1.0)))
    groups = materialise(own.groupBy("bk", "grp").agg(parts.cast("long").alias("parts")), "groups")
    named = rows.join(own.select("bk", "cls", "grp"), ["bk", "cls"]).join(groups, ["bk", "grp"])
    return named.select("bk", "grp", F.pmod(F.xxhash64("tkey"), "parts").alias("block"), "tkey", "cls")


def _likely_links(how: Likeness):
    """Pairs of blocks to the pairs of texts of different classes whose signatures agree enough.

    A pair is looked at in the first bucket that it shares only. What a pair of blocks has to verify
    stays one row: the texts' keys and classes, and the pairs as two lists of places, best first.
    """

    def likely(bk: int, left: list[dict], right: list[dict]) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
        both = left + right
        sig = _rows((r["sig"] for r in both), how)
        bands = np.array([r["bands"] for r in both], np.int64)
        here = bands == bk
        names: dict[bytes, int] = {}
        cls = np.array([names.setdefault(r["cls"], len(names)) for r in both])
        rows, columns, shares = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(len(left)):
            other = len(left) + np.flatnonzero(cls[len(left) :] != cls[i])
            share = (sig[other] == sig[i]).mean(1)
            other, share = other[share >= how.least_agreement], share[share >= how.least_agreement]
            first = here[i, np.argmax(bands[other] == bands[i], 1)]
            rows.append(np.full(int(first.sum()), i))
            columns.append(other[first])
            shares.append(share[first])
        i, j, share = np.concatenate(rows), np.concatenate(columns), np.concatenate(shares)
        best = np.lexsort((j, i, -share))
        need, place = np.unique(np.concatenate((i[best], j[best])), return_inverse=True)
        return [both[x]["tkey"] for x in need], [both[x]["cls"] for x in need], place[: len(i)], place[len(i) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                found = likely(row["bk"], row["left"], row["right"])
                if len(found[0]):
                    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(t)) for x, t in zip(found, kinds, strict=True)], names=["tkeys", "classes", "i", "j"])

    return run


def _verified_links(how: Likeness):
    """Rows of :func:`_likely_links` with their texts to links, one for each two classes united."""

    def links(row: dict) -> Iterator[tuple[bytes, bytes]]:
        keys, classes = row["tkeys"], row["classes"]
        texts = {t["tkey"]: t["text"] for t in row["texts"]}
        ready = how.prepare([texts[k] for k in keys])
        root = {c: c for c in classes}

        def find(c: bytes) -> bytes:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for x, y in zip(row["i"], row["j"], strict=True):
            a, b = find(classes[x]), find(classes[y])
            if a != b and how.alike(ready[x], ready[y]):
                root[a] = b
                yield keys[x], keys[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [*links(batch.slice(k, 1).to_pylist()[0])]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.binary()) for n in (0, 1)], names=["a", "b"])

    return run


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(bk, one, two): names (grp, block) of the blocks of a bucket to be compared, each pair once."""
    name = F.struct("grp", "block")
    pairs = blocks.select("bk", name.alias("one")).join(blocks.select("bk", name.alias("two")), "bk")
    return pairs.where((F.col("one") <= F.col("two")) & ((F.col("one.grp") != F.col("two.grp")) | (F.col("one.grp") == F.lit(b""))))


def _rest(members: DataFrame, sigs: DataFrame, texts: DataFrame, how: Likeness) -> DataFrame:
    """Links (a, b) between classes that share a bucket, found and verified block by block.

    Blocks of one and the same class never meet, so an odd text in a bucket of many united copies
    costs a comparison of signatures with each of them and no more. Texts are fetched only for
    pairs whose signatures agree.
    """
    dealt = _deal(members, texts).join(sigs, "tkey")
    blocks = dealt.groupBy("bk", "grp", "block").agg(F.collect_list(F.struct("tkey", "cls", "sig", "bands")).alias("rows"))
    blocks = materialise(blocks, "blocks")
    left, right = (blocks.select("bk", F.struct("grp", "block").alias(n), F.col("rows").alias(as_)) for n, as_ in (("one", "left"), ("two", "right")))
    likely = _block_pairs(blocks).join(left, ["bk", "one"]).join(right, ["bk", "two"]).select("bk", "left", "right")
    likely = likely.mapInArrow(_likely_links(how), "tkeys array<binary>, classes array<binary>, i array<int>, j array<int>")
    likely = materialise(likely.withColumn("pair", F.monotonically_increasing_id()), "rest")
    fetched = likely.select("pair", F.explode("tkeys").alias("tkey")).join(texts.select("tkey", "text"), "tkey")
    fetched = fetched.groupBy("pair").agg(F.collect_list(F.struct("tkey", "text")).alias("texts"))
    return likely.join(fetched, "pair").select("tkeys", "classes", "i", "j", "texts").mapInArrow(_verified_links(how), "a binary, b binary")


def _with_keys(sigs: DataFrame, how: Likeness) -> DataFrame:
    """(tkey, sig) with the band keys of the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                rows = _rows(part.column(1).to_pylist(), how)
                keys = pa.array(list(how.keys_of(rows).view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), keys], names=["tkey", "sig", "bands"])

    return sigs.select("tkey", "sig").mapInArrow(run, "tkey binary, sig binary, bands array<long>")


def _meetings(nodes: DataFrame, how: Likeness) -> tuple[DataFrame, DataFrame]:
    """((tkey, bk) of the texts that may be like another one of their bucket, distinct texts with their signatures).

    In order of length, a bucket is cut where the next text is too long to be like any before; in parts of
    at most SMALL_BUCKET texts signatures are compared, those of larger parts are kept as they are."""
    own = nodes.groupBy("tkey").agg(F.first("sig").alias("sig"), F.first("chars").alias("chars")).withColumn("number", F.monotonically_increasing_id())
    own = materialise(own, "texts-signed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                rows = _rows(part.column(1).to_pylist(), how)
                keys = how.keys_of(rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(part.column(i).to_numpy(), keys.shape[1])) for i in (0, 2))], names=["bk", "number", "chars"])

    dealt = own.select("number", "sig", "chars").mapInArrow(run, "bk long, number long, chars long").repartition("bk")
    by_length = Window.partitionBy("bk").orderBy("chars", "number")
    cut = how.far(F.lag("chars").over(by_length), F.col("chars"))
    part = F.sum(F.when(F.coalesce(cut, F.lit(True)), 1).otherwise(0)).over(by_length.rowsBetween(Window.unboundedPreceding, 0))
    several = dealt.withColumn("part", part).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bk", "part"))).where("n > 1")
    buckets = several.groupBy("bk", "part", F.when(F.col("n") > SMALL_BUCKET, F.col("number")).alias("alone")).agg(F.collect_list("number").alias("of"))
    buckets = materialise(buckets, "meetings")  # one row for each small bucket, one for each text of a large one
    pairs = buckets.where("alone IS NULL").select("bk", "of", F.posexplode("of").alias("i", "a")).select("bk", "a", F.explode(F.slice("of", F.col("i") + 2, F.lit(SMALL_BUCKET))).alias("b"))
    with_sig = lambda x: own.select(F.col("number").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("chars").alias(f"chars_{x}"))
    agreed = pairs.join(with_sig("a"), "a").join(with_sig("b"), "b")
    agreed = agreed.where(~how.far(F.least("chars_a", "chars_b"), F.greatest("chars_a", "chars_b"))).where(_share(how)("sig_a", "sig_b") >= how.least_agreement)
    agreed = agreed.select("bk", F.explode(F.array("a", "b")).alias("number"))
    kept = agreed.unionByName(buckets.where("alone IS NOT NULL").select("bk", F.col("alone").alias("number"))).distinct()
    return kept.join(own.select("number", "tkey"), "number").select("tkey", "bk"), own.select("tkey", "sig")


def near_duplicate_classes(docs: DataFrame, how: Likeness) -> tuple[DataFrame, DataFrame]:
    """(signed documents with doc_id and tkey, classes with tkey and cls of texts in a class of several)."""
    signed = materialise(sign(docs, how), "signed")
    nodes = signed.where(F.col("sig").isNotNull())
    if _sparse(how):
        multi, own = _meetings(nodes, how)
    else:
        banded = nodes.select("tkey", F.explode("bands").alias("bk")).distinct()
        shared = banded.groupBy("bk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bk")
        multi = banded.join(shared, "bk")
    multi = materialise(multi, "buckets")
    keys = materialise(multi.select("tkey").distinct(), "keys")
    few = small(keys)
    if _sparse(how):
        sigs = materialise(_with_keys(own.join(few, "tkey"), how), "sigs")
    else:
        sigs = materialise(nodes.join(few, "tkey").groupBy("tkey").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")), "sigs")
    texts = docs.select(text_key().alias("tkey"), F.coalesce("text", F.lit("")).alias("text")).join(few, "tkey")
    texts = materialise(texts.groupBy("tkey").agg(F.first("text").alias("text")).withColumn("size", F.octet_length("text")), "texts")
    classes = keys.select("tkey", F.col("tkey").alias("cls"))
    tested: DataFrame | None = None
    for turn in range(STAR_ROUNDS):
        members = multi.join(classes, "tkey")
        centres = (
            members.groupBy("bk")
            .agg(F.min(F.struct(F.xxhash64("tkey", F.lit(turn)).alias("h"), "tkey", "cls")).alias("c"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
            .where("lo != hi")
            .select("bk", F.col("c.tkey").alias("centre"), F.col("c.cls").alias("centre_cls"))
        )
        pairs = (
            members.join(centres, "bk")
            .where("cls != centre_cls")
            .groupBy("tkey", F.least("tkey", "centre").alias("a"), F.greatest("tkey", "centre").alias("b"))
            .agg(F.count(F.lit(1)).alias("shared"))
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        best = Window.partitionBy("tkey").orderBy(F.desc("shared"), "a", "b")  # at most BANDS rows each
        pairs = pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= STAR_PARTNERS).select("a", "b").distinct()
        likely = materialise(_agree(pairs, sigs, how), "likely")
        classes = _unite(classes, materialise(_verify(likely, texts, how), "links"))
        tested = likely if tested is None else tested.unionByName(likely)
    links = _rest(multi.join(classes, "tkey"), sigs, texts, how)
    classes = _unite(classes, materialise(links, "links"))
    return signed.select("doc_id", "tkey"), classes


def classify_documents(docs: DataFrame, how: Likeness) -> DataFrame:
    """A row per document: doc_id, tkey, class_id, class_size (documents), keep_key.

    The document that stays of a class is the one of least doc_id (nulls last), then text key.
    """
    rows, classes = near_duplicate_classes(docs, how)
    linked = classes.where("tkey != cls").select("tkey", "cls")
    counted = rows.groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("copies")).join(linked, "tkey", "left").withColumn("cls", F.coalesce("cls", "tkey"))
    counted = materialise(counted, "members")
    groups = counted.groupBy("cls").agg(
        F.min("doc_id").alias("class_id"),
        F.sum("copies").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("stays"),
    )
    groups = materialise(groups, "groups")  # so that the join below can split a class of any size
    stays = F.col("stays.tkey").eqNullSafe(F.col("tkey")) & F.col("stays.doc_id").eqNullSafe(F.col("doc_id"))
    return counted.join(groups, "cls").select("doc_id", "tkey", "copies", "class_id", "class_size", stays.alias("kept"))


def drop_near_duplicates(docs: DataFrame, how: Likeness) -> DataFrame:
    """One document of each class, columns unchanged. Texts are not shuffled while the rows to drop are few.

    Of rows that agree in doc_id and text any one stays, with its other columns."""
    members = materialise(classify_documents(docs, how), "classed")
    doc_id, key = free_names(docs, "_doc_id", "_text_key")
    named = lambda rows: rows.select(F.col("doc_id").alias(doc_id), F.col("tkey").alias(key))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (text_key() == F.col(key))
    left = docs.join(small(named(members.where(~F.col("kept")))), same, "left_anti")
    repeated = named(members.where(F.col("kept") & (F.col("copies") > 1)))
    if not repeated.limit(1).count():
        return left
    few = small(materialise(repeated, "repeated"))
    once = left.join(few, same, "left_semi").withColumn(key, text_key()).dropDuplicates(["doc_id", key]).drop(key)
    return left.join(few, same, "left_anti").unionByName(once)
