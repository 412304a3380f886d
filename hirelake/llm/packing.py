"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

A document's tokens, with the end id, are cut every ``length`` tokens; whole pieces fill a sequence
each. The rest pieces are packed by their histogram alone: lengths longest first, each count of
pieces is placed into the packs with the least in them that still fit, pack patterns and their
counts being updated together, so the work is in the number of distinct lengths (at most
``length``), not in the number of documents. The pattern counts are then joined back: pieces of
one length are ranked, and ranges of ranks map to patterns, instances and offsets.

Tokenising is a map-only step that returns piece digests; ids leave it as checksums only (or
whole, with ``with_ids``). Ranks come from bucketed prefix sums. The driver holds one histogram.

Where the order of the documents matters (:func:`pack_in_order`), they are cut into windows of about
``window`` tokens in that order, each packed by its own histogram in a task of its own; sequences are
numbered window by window, in a window by their first piece.

Defined cases: null text is empty, and an empty text is its end id alone; equal or repeated rows
are packed each on its own; pieces that agree in all columns are interchangeable, so they are
counted before the shuffle and written out in parts of bounded size; a very long text is tokenised
whole, in one task, and its pieces are rows like any other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm.common import cut_copies, materialise, order_key, prefix_sums, table

LENGTH = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k"
#: Tokens of a window of documents in order; what a piece counts beside its tokens there, so that a
#: window has a bounded number of pieces; windows whose sequences are numbered together.
WINDOW, PIECE, SPAN = 4 << 20, 32, 4096


@lru_cache(2)
def encoder(name: str = TOKENIZER):
    """Encode function of a public byte-level BPE vocabulary, cached per Python worker.

    ``tiktoken`` runs the rank file that belongs to ``<name>.json``; the tests hold its ids
    against the ``tokenizers`` library's. The vocabulary's added tokens are taken from the JSON
    file: where a text has the string of one, it gives that token's id, as the library does.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{name}: an added token that takes more than its own string")
    special = {t["content"]: t["id"] for t in added}
    return partial(tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special).encode, allowed_special="all")


def token_pieces(docs: DataFrame, length: int = LENGTH, name: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False, placed: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids][, file, row]) of every piece of every document;
    ``file`` and ``row`` are columns of ``docs``."""
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), *(["file", "row"] if placed else [])]
    types = {"ids": pa.binary(), "file": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out: dict[str, list] = {c: [] for c in own}
                places = zip(*[part.column(i).to_pylist() for i in (2, 3)], strict=True) if placed else repeat((None, None))
                for doc_id, text, (file, row) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), places, strict=False):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    data = memoryview(ids.tobytes())
                    for start in range(0, len(ids), length):
                        piece = data[4 * start : 4 * (start + length)]
                        values = {"doc_id": doc_id, "start": start, "length": len(piece) // 4, "ids_crc32": zlib.crc32(piece), "doc_tokens": len(ids), "ids": bytes(piece) if with_ids else b"", "file": file, "row": row}
                        for column in own:
                            out[column].append(values[column])
                yield pa.RecordBatch.from_arrays([pa.array(out[c], types.get(c, pa.int64())) for c in own], names=own)

    schema = ", ".join(f"{c} { {'ids': 'binary', 'file': 'string'}.get(c, 'long')}" for c in own)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["file", "row"] if placed else [])).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """[(pattern, count)]: lengths of the pieces of a pack, in order, and how many packs have them.

    Packs are kept by the space used; a length goes, longest first, to the emptiest packs. Where
    these cannot hold it no pack can, and new packs are opened.
    """
    by_used: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        if size > length:
            raise ValueError("a piece is longer than a sequence")
        while left:
            used = min(by_used, default=length + 1)
            if used + size > length:
                by_used.setdefault(size, []).append(((size,), left))
                break
            pattern, count = by_used[used].pop()
            if not by_used[used]:
                del by_used[used]
            taken = min(left, count)
            if taken < count:
                by_used.setdefault(used, []).append((pattern, count - taken))
            by_used.setdefault(used + size, []).append((pattern + (size,), taken))
            left -= taken
    return [p for used in sorted(by_used, reverse=True) for p in sorted(by_used[used], reverse=True)]


def placements(patterns: list[tuple[tuple[int, ...], int]], base: int = 0) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, first sequence, copies in a pack, offset of the first).

    Pieces of one length take ranks pattern by pattern; in a pattern that holds a length several
    times, rank r of its range is copy r mod times of instance r div times.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    for pattern, count in patterns:
        offset = 0
        for size in dict.fromkeys(pattern):  # equal lengths stand next to each other
            times = pattern.count(size)
            out.setdefault(size, []).append((ranks.get(size, 0), base, times, offset))
            ranks[size] = ranks.get(size, 0) + times * count
            offset += size * times
        base += count
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack_documents(docs: DataFrame, length: int = LENGTH, name: str = TOKENIZER) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    keys = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    pieces = materialise(token_pieces(docs, length, name), "pieces")
    counted = pieces.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("copies"))
    counted = materialise(counted.withColumn("okey", order_key(F.concat_ws(":", "doc_id", "start"))), "packs")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("copies").alias("n")).collect()}  # at most ``length`` rows
    whole = histogram.pop(length, 0)
    where = placements(shortest_pack_first(histogram, length), whole)
    ranked = prefix_sums(cut_copies(counted), ["length"], ["okey", *keys, "part"], "copies")
    ranked = ranked.select(*keys, "length", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = frame["rank"].to_numpy(np.int64).copy(), np.zeros(len(frame), np.int64)
            sizes, ranks = frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64)
            for size in np.unique(sizes):
                if size == length:
                    continue  # a whole sequence: its rank is its id
                mine, rows = np.flatnonzero(sizes == size), where[int(size)]
                first, start, times, at = rows[np.searchsorted(rows[:, 0], ranks[mine], "right") - 1].T
                sequence[mine] = start + (ranks[mine] - first) // times
                offset[mine] = at + (ranks[mine] - first) % times * size
            yield frame.assign(sequence_id=sequence, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return ranked.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of a table read from files with the ``file`` and ``row`` that each row lies in; files
    sort by the number that their writer gave them."""
    path = F.col("_metadata.file_path")
    number = F.lpad(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1), 10, "0")
    return df.select(*columns, F.concat_ws(" ", number, path).alias("file"), F.col("_metadata.row_index").alias("row"))


def place_window(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces in order; sequences are numbered by their first piece."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_size = np.argsort(sizes, kind="stable")
    distinct, first = np.unique(sizes[by_size], return_index=True)
    ranked = dict(zip(distinct.tolist(), np.split(by_size, first[1:]), strict=True))
    whole = ranked.pop(length, np.zeros(0, np.int64))
    sequence[whole] = np.arange(len(whole))
    where = placements(shortest_pack_first({size: len(mine) for size, mine in ranked.items()}, length), len(whole))
    for size, mine in ranked.items():
        ranks, rows = np.arange(len(mine)), where[size]
        low, start, times, at = rows[np.searchsorted(rows[:, 0], ranks, "right") - 1].T
        sequence[mine] = start + (ranks - low) // times
        offset[mine] = at + (ranks - low) % times * size
    leader = np.unique(sequence, return_index=True)[1]
    number = np.empty(len(leader), np.int64)
    number[np.argsort(leader)] = np.arange(len(leader))
    return number[sequence], offset


def pack_in_order(docs: DataFrame, length: int = LENGTH, name: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """The columns of :func:`pack_documents`; the order of the documents is that of the sequences but for
    the pieces of a window.

    A table read from files is in the order of its files and their rows, another one in that of its partitions.
    """
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    try:
        pieces = materialise(token_pieces(_placed(docs, "doc_id", "text"), length, name, placed=True), "pieces")
    except AnalysisException:  # not read from files
        pieces = _placed(materialise(token_pieces(docs, length, name), "pieces"), *keys)
    weight = F.col("length") + PIECE
    files, base = sorted((r["file"], r["n"]) for r in pieces.groupBy("file").agg(F.sum(weight).alias("n")).collect()), 0  # a row per file
    bases = []
    for file, n in files:
        bases.append((file, base))
        base += n
    bases = F.broadcast(docs.sparkSession.createDataFrame(bases, "file string, base long"))
    running = Window.partitionBy("file").orderBy("row", "start").rowsBetween(Window.unboundedPreceding, 0)
    at = pieces.withColumn("at", F.sum(weight).over(running)).join(bases, "file").withColumn("at", F.col("base") + F.col("at") - weight)
    last = max(base // window, 1) - 1
    at = at.select(*keys, "at", F.least(F.floor(F.col("at") / window), F.lit(last)).cast("long").alias("window"))

    def pack(part: pa.Table) -> pa.Table:
        order = np.argsort(part["at"].to_numpy())
        sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sequence[order], offset[order] = place_window(part["length"].to_numpy()[order], length)
        return part.drop_columns(["at"]).append_column("own", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = materialise(at.groupBy("window").applyInArrow(pack, ", ".join(f"{c} long" for c in [*keys, "window", "own", "offset"])), "packs")
    counts = packed.groupBy("window").agg((F.max("own") + 1).alias("n")).withColumn("span", F.floor(F.col("window") / SPAN))
    spans = counts.groupBy("span").agg(F.sum("n").alias("all"))
    spans = spans.select("span", (F.sum("all").over(Window.orderBy("span")) - F.col("all")).alias("base"))  # a row per SPAN windows
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("span").orderBy("window")) - F.col("n")).join(spans, "span")
    counts = counts.select("window", (F.col("base") + F.col("before")).alias("base"))
    return packed.join(counts, "window").select(*keys, (F.col("base") + F.col("own")).alias("sequence_id"), "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
