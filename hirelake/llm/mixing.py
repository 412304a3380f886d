"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of about ``block_bytes`` in md5 order of doc_id. Target weights are
quantised to a_i/period (largest remainders, every weighted source at least 1). Block j of source
i (from 0) is released at slot floor(j*period/a_i) and due at ceil((j+1)*period/a_i); of the
released blocks the one due first runs (ties: source order). On one resource with weights adding
up to 1 this meets every deadline, so at every slot each source is less than one block away from
its target share. The schedule repeats after ``period`` slots with every lag back at zero, so one
period of at most ``period`` rows (a parameter) is all that is ever computed or joined, at any
input size: block j runs at slot (j div a_i)*period + place(i, j mod a_i). More sources than slots
lengthen the period (to at least twice their number), so each still has a share of its own.

The shares hold up to the first slot whose source has run dry, the end of epoch 0. The schedule
goes on without the dry source in a new epoch: the other sources' weights are quantised anew and a
new period starts, and so on until every source has run dry, so there are at most as many epochs as
sources. An epoch has at most ``period`` places, and no more than it has blocks. Weights that come from the sources' sizes lead to the
end, so every document has a slot; weights that are given must hold, so the mix ends with epoch 0
and later documents have a null ``slot``. ``to_end`` overrides either.

Weights are given as {source: weight}, or, by default, are the sources' byte counts to the power
``temperature``, which lifts small sources against a hot one.

Defined cases: a null source is a source of its own, as is the empty one; sources without a
weight are never scheduled; null text counts as empty (size 1); documents equal in source and
doc_id share a block and position; a document belongs to the block that it begins in, so a text
longer than a block leaves blocks without a document; an empty table gives an empty result; other
columns, whatever their names, are ignored by the schedule and kept by :func:`mix_documents`. More
than 2**31 documents equal in source and doc_id fail in the queries, as ``copy`` is an int there. The driver
holds a few numbers per source and epoch; its work grows with the square of the number of sources (some
seconds for 5,000), not with the documents.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import free_names, materialise, order_key, prefix_sums, release, spread_copies, table, text_of

PERIOD = 1000
BLOCK_BYTES = 1 << 16
TEMPERATURE = 0.7


def quantise(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole numbers of slots in a period; they add up to ``period``."""
    weights = {s: w for s, w in weights.items() if w > 0}
    if len(weights) > period:
        raise ValueError(f"{len(weights)} weighted sources don't fit a period of {period} slots")
    if not weights:
        return {}
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    rest = sorted(weights, key=lambda s: (-(exact[s] - int(exact[s])), s))
    i = 0
    while sum(slots.values()) < period:
        slots[rest[i % len(rest)]] += 1
        i += 1
    rank = {name: -i for i, name in enumerate(sorted(slots))}
    most = [(exact[s] - n, rank[s], s) for s, n in slots.items() if n > 1]
    heapq.heapify(most)
    for _ in range(sum(slots.values()) - period):
        _, _, s = most[0]
        slots[s] -= 1
        if slots[s] > 1:
            heapq.heapreplace(most, (exact[s] - slots[s], rank[s], s))
        else:
            heapq.heappop(most)
    return slots


def pfair_period(slots: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block in the period, slot) of one period, earliest deadline first."""
    period = sum(slots.values())
    names = sorted(slots)
    release = lambda i, j: j * period // slots[names[i]]
    due = lambda i, j: -(-(j + 1) * period // slots[names[i]])
    waiting = [(0, i, 0) for i in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(i, j), i, j))
        _, i, j = heapq.heappop(ready)
        yield names[i], j, slot
        if j + 1 < slots[names[i]]:
            heapq.heappush(waiting, (release(i, j + 1), i, j + 1))


def epochs(stock: dict[str, float], blocks: dict[str, int], period: int = PERIOD) -> tuple[list[tuple[str, int, int, int, int, int]], list[tuple[str, int, int, int]]]:
    """The schedule to the end, for weights and numbers of blocks.

    Rows (source, epoch, first block, block after the last, share, first slot) and places (source,
    epoch, block in the period, slot in the period). Weighted sources without blocks take part in epoch
    0, where their slots stay empty.
    """
    spans, places = [], []
    done = dict.fromkeys(blocks, 0)
    epoch, begin, weights = 0, 0, stock
    while any(s in weights for s in blocks if done[s] < blocks[s]):
        slots = quantise(weights, period)
        where: dict[str, list[int]] = {s: [] for s in slots}
        left = {s: blocks[s] - done[s] for s in slots if s in blocks}
        for s, _, slot in pfair_period(slots):
            if s in left and len(where[s]) == left[s]:  # it runs dry within the first period
                horizon = slot
                break
            where[s].append(slot)
        else:
            horizon = min(n // slots[s] * period + where[s][n % slots[s]] for s, n in left.items())
        for s in left:
            taken = horizon // period * slots[s] + bisect_left(where[s], horizon % period)
            if taken:
                spans.append((s, epoch, done[s], done[s] + taken, slots[s], begin))
                places += [(s, epoch, at, place) for at, place in enumerate(where[s][:taken])]
                done[s] += taken
        epoch, begin = epoch + 1, begin + horizon
        weights = {s: stock[s] for s in left if done[s] < blocks[s]}
    return spans, places


def _source_key():
    """Source as text that tells null from any string."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def _groups(docs: DataFrame) -> DataFrame:
    """Bytes and number of documents of each source and doc_id, with the order key."""
    return (
        docs.select("doc_id", _source_key().alias("skey"), "source", (F.octet_length(text_of()) + 1).cast("long").alias("size"))
        .groupBy("skey", "source", "doc_id")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
        .withColumn("okey", order_key("doc_id"))
    )


def mix_schedule(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    period: int = PERIOD,
    block_bytes: int = BLOCK_BYTES,
    temperature: float = TEMPERATURE,
    to_end: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(placed, sources): every source and doc_id with block, slot and epoch, and a row per source.

    ``sources`` has the slots of a period of epoch 0 and ``cutoff``, the
    order key from which on documents have no slot.
    """
    spark = docs.sparkSession
    groups = written = materialise(_groups(docs), "mix")
    if weights is None:
        sizes = groups.groupBy("skey").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "skey")
        stock = {r.skey: float(r.bytes) ** temperature for r in sizes.collect()}  # a row per source
    else:
        stock = {("n" if s is None else f"s{s}"): float(w) for s, w in weights.items()}
    if len(stock) > period:
        period *= -(-2 * len(stock) // period)
    slots = quantise(stock, period)
    shares = spark.createDataFrame([(s, a) for s, a in slots.items()], "skey string, share int")

    blocks = (
        prefix_sums(groups, ["skey"], ["okey", "doc_id", "source"], "bytes")
        .withColumn("block", F.floor(F.col("before") / block_bytes))
        .join(F.broadcast(shares), "skey", "left")
    )
    blocks = materialise(blocks.select("skey", "source", "doc_id", "okey", "copies", "bytes", "share", "block"), "blocks")
    in_stock = blocks.where(F.col("share").isNotNull()).groupBy("skey").agg((F.max("block") + 1).alias("blocks"))
    spans, places = epochs({s: stock[s] for s in slots}, {r.skey: r.blocks for r in in_stock.collect()}, period)  # a row per weighted source
    spans = spark.createDataFrame(spans, "_skey string, epoch int, first long, after long, _share int, begin long")
    places = spark.createDataFrame(places, "_pkey string, _epoch int, at int, place int")
    in_span = (F.col("skey") == F.col("_skey")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("after"))
    whole = weights is None if to_end is None else to_end
    in_place = (F.col("skey") == F.col("_pkey")) & (F.col("epoch") == F.col("_epoch")) & (F.col("nth") % F.col("_share") == F.col("at"))
    placed = (
        blocks.join(F.broadcast(spans), in_span, "left")
        .withColumn("nth", F.col("block") - F.col("first"))
        .join(F.broadcast(places), in_place, "left")
        .withColumn("due_slot", (F.col("begin") + F.floor(F.col("nth") / F.col("_share")) * period + F.col("place")).cast("long"))
        .withColumn("slot", F.when((F.col("epoch") == 0) | F.lit(whole), F.col("due_slot")))
        .select("skey", "source", "doc_id", "okey", "copies", "bytes", "share", "block", "slot", "epoch")
    )
    placed = materialise(placed, "mixed")
    release(written)
    release(blocks)
    sources = placed.groupBy("skey").agg(
        F.min(F.when(F.col("slot").isNull(), F.col("okey"))).alias("cutoff"),
        F.max("share").alias("share"),
    )
    return placed, sources


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The scheduled documents with all their columns, in the order of their slots.

    Partitions hold even ranges of slots, one after the other, and are sorted by slot.
    """
    placed, _ = mix_schedule(docs, **how)
    own = ("source", "doc_id", "okey", "slot")
    source, doc_id, okey, slot = names = free_names(docs, *(f"_{c}" for c in own))
    slots = placed.where(F.col("slot").isNotNull()).select(*[F.col(c).alias(name) for c, name in zip(own, names, strict=True)])
    count = (slots.agg(F.max(slot)).first()[0] or 0) + 1
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = F.col("source").eqNullSafe(F.col(source)) & F.col("doc_id").eqNullSafe(F.col(doc_id))
    mixed = docs.join(slots.hint("shuffle_hash"), same)
    mixed = mixed.repartitionById(parts, F.floor(F.col(slot) * parts / count).cast("int"))
    return mixed.sortWithinPartitions(slot, okey).drop(*names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source, target share (of 1000, in epoch 0), block, epoch and slot."""
    placed, _ = mix_schedule(table(spark, sf_dir, "documents"))
    rows = placed.select("doc_id", "source", F.col("share").cast("long").alias("share"), F.col("block").cast("long").alias("block"), "epoch", "slot", "copies")
    return spread_copies(rows).withColumn("copy", F.col("copy").cast("int"))


#: The same rows under the query's former name.
op1_mixing_to_end = op1_mixing


#: The same schedule in SQL, slot by slot over all epochs (for weights of which none rounds below one slot).
OP1_SQL = f"""
WITH RECURSIVE g AS (
  SELECT CASE WHEN source IS NULL THEN 'n' ELSE concat('s', source) END AS skey, source, doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS okey,
         sum(strlen(coalesce(text, '')) + 1) AS bytes, count(*) AS copies
  FROM documents GROUP BY ALL
), b AS (
  SELECT *, CAST(sum(bytes) OVER (PARTITION BY skey ORDER BY okey, doc_id ROWS UNBOUNDED PRECEDING) - bytes AS BIGINT) // {BLOCK_BYTES} AS block FROM g
), e AS (
  SELECT skey, pow(CAST(sum(bytes) AS DOUBLE), {TEMPERATURE}) AS weight, max(block) + 1 AS blocks FROM b GROUP BY skey
), n AS (
  SELECT list(skey ORDER BY skey) AS keys, list(weight ORDER BY skey) AS weights, list(blocks ORDER BY skey) AS blocks, range(1, count(*) + 1) AS ids, list_transform(list(skey), lambda x: CAST(0 AS BIGINT)) AS none FROM e
), sim(turn, epoch, slot, done, own, shares, pick, nr) AS (
  SELECT CAST(0 AS BIGINT), -1, CAST(0 AS BIGINT), none, none, none, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM n
  UNION ALL
  SELECT turn + CASE WHEN dry THEN 0 ELSE 1 END, epoch + CASE WHEN dry THEN 1 ELSE 0 END, CASE WHEN dry THEN 0 ELSE slot + 1 END,
         CASE WHEN dry THEN done ELSE list_transform(ids, lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END) END,
         CASE WHEN dry THEN none ELSE list_transform(ids, lambda i: own[i] + CASE WHEN i = p THEN 1 ELSE 0 END) END,
         CASE WHEN dry THEN list_transform(ids, lambda i: CASE WHEN exact[i] > 0 THEN base[i] + CASE WHEN 1 + len(list_filter(ids, lambda j: exact[j] > 0 AND (exact[j] - floor(exact[j]) > exact[i] - floor(exact[i]) OR (exact[j] - floor(exact[j]) = exact[i] - floor(exact[i]) AND j < i)))) <= {PERIOD} - list_sum(base) THEN 1 ELSE 0 END ELSE 0 END) ELSE shares END,
         CASE WHEN dry THEN 0 ELSE p END, CASE WHEN dry THEN 0 ELSE done[p] END
  FROM (
    SELECT *, list_transform(exact, lambda x: CASE WHEN x > 0 THEN CAST(greatest(1, floor(x)) AS BIGINT) ELSE 0 END) AS base FROM (
      SELECT *, p = 0 OR done[p] >= blocks[p] AS dry, list_transform(ids, lambda i: CASE WHEN done[i] < blocks[i] THEN weights[i] / total * {PERIOD} ELSE 0 END) AS exact FROM (
        SELECT *, list_sum(list_transform(ids, lambda i: CASE WHEN done[i] < blocks[i] THEN weights[i] ELSE 0 END)) AS total,
               CAST(coalesce(list_min(list_transform(list_filter(ids, lambda i: shares[i] > 0 AND own[i] * {PERIOD} // greatest(shares[i], 1) <= slot), lambda i: ((own[i] + 1) * {PERIOD} + shares[i] - 1) // greatest(shares[i], 1) * 10000 + i)), 0) % 10000 AS BIGINT) AS p
        FROM sim, n WHERE list_sum(done) < list_sum(blocks))))
), places AS (
  SELECT keys[pick] AS skey, nr AS block, epoch, turn - 1 AS slot FROM sim, n WHERE pick > 0
), first AS (
  SELECT unnest(keys) AS skey, unnest(shares) AS share FROM sim, n WHERE epoch = 0 AND slot = 0
)
SELECT doc_id, source, share, b.block, CAST(epoch AS INTEGER) AS epoch, slot, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy
FROM b JOIN places USING (skey, block) JOIN first USING (skey)
"""
