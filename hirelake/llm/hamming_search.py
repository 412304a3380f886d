"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code is cut into segments of about log2(number of codes) bits, each indexed by its value. A code
within distance d of a query agrees with it up to floor(d/segments) bits in some segment. So search
radii grow round by round: in round r all values r bits away from the query's are looked up in each
segment, found codes are verified on their full distance, and a query is done once its kth distance
is at most segments*(r+1)-1, below which nothing can be missing. Ties go to the smaller id.

Equal codes are one index entry with their k+1 least ids, so copies cost nothing. A candidate comes
from one segment only (its nearest, then first) and only while it can still enter the top k. All
of it is DataFrame operations; the index is broadcast while it is small, else joined by shuffle.
The steps follow from the expected work (values looked up, times codes per value): where the next
radius has too many values, queries that are still open go on with more and shorter segments, which
reach farther with fewer values. Once the steps would meet more codes than there are, they are compared
with all codes instead, in blocks of queries, with the same result.

Defined cases: null vectors are neither queries nor neighbours; NaN counts as not positive, as does a
component that a short vector lacks, and components after the 64th are not read; rows equal in id and
code count once; a query is not its own neighbour; fewer than k others give fewer rows; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, table

BITS, K = 64, 10
QUERY_MOD = 50
#: Index entries (16 bytes each) up to which the index is broadcast.
BROADCAST_ENTRIES = 1_000_000
#: How often a comparison of all codes reads them.
PASSES = 2
#: Values per query and step up to which segments are looked up, and open queries that are broadcast
#: at once beyond it.
MOST_MASKS, QUERY_BLOCK = 1 << 18, 10_000


def sign_code(vector: str) -> Column:
    """64 sign bits of a vector as a long; bit i is set where component i is positive."""
    bit = F.transform(F.slice(F.col(vector), 1, BITS), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    if BITS != 64:
        raise ValueError("codes are longs")
    return F.when(F.col(vector).isNotNull(), F.aggregate(bit, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


@dataclass(frozen=True)
class Step:
    """A round of look-ups: radii in ``count`` segments; afterwards every code up to ``reach`` is found."""

    count: int
    radii: tuple[int, ...]
    reach: int

    def masks(self) -> list[tuple[int, int]]:
        return [(i, sum(1 << b for b in at)) for i, (_, bits) in enumerate(_segments(self.count)) for r in self.radii for at in combinations(range(bits), r)]

    def values(self) -> int:
        return sum(math.comb(bits, r) for _, bits in _segments(self.count) for r in self.radii)

    def work(self, codes: int) -> float:
        """Values looked up and codes expected there, per query."""
        return sum(math.comb(bits, r) * (1 + codes / 2**bits) for _, bits in _segments(self.count) for r in self.radii)


def search_steps(codes: int) -> list[Step]:
    """The steps while each has at most MOST_MASKS values and all have less work than comparing all codes (PASSES times).

    A step goes on with the segments at hand, or starts anew with more of them where that is less
    work for each bit that it reaches farther; a new start looks up all radii at once.
    """
    count = max(1, min(BITS, round(BITS / max(1.0, math.log2(max(codes, 2))))))
    steps: list[Step] = []
    radius, reach, spent = -1, -1, 0.0
    while reach < BITS:
        options = [Step(count, (radius + 1,), count * (radius + 2) - 1)]
        if steps:
            for more in range(count + 1, BITS // 4 + 1):
                last = (reach + 1) // more  # the least radius that reaches farther
                options.append(Step(more, tuple(range(last + 1)), more * (last + 1) - 1))
        options = [o for o in options if o.radii[-1] <= BITS // o.count and o.values() <= MOST_MASKS and spent + o.work(codes) <= PASSES * codes]
        if not options:
            break
        best = min(options, key=lambda o: o.work(codes) / (o.reach - reach))
        steps.append(best)
        count, radius, reach, spent = best.count, best.radii[-1], best.reach, spent + best.work(codes)
    return steps


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of each of ``count`` segments."""
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(edges[:-1], edges[1:], strict=True)]


def _values(code: str, segments: list[tuple[int, int]]) -> Column:
    cut = [F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned(F.col(code), low).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")).alias("value")) for i, (low, bits) in enumerate(segments)]
    return F.explode(F.array(*cut))


def _first_at(segments: list[tuple[int, int]]) -> Column:
    """Index of the segment in which query and code differ least (the first of these)."""
    x = F.col("q").bitwiseXOR(F.col("code"))
    away = [F.bit_count(F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long"))) for low, bits in segments]
    return F.array_position(F.array(*away), F.array_min(F.array(*away))) - 1


def _compare_all(index: DataFrame, open_queries: DataFrame, k: int) -> DataFrame:
    """(q, code, n, distance) of the codes that can be among the nearest k, by comparing all codes.

    A first pass counts codes by distance (at most BITS + 1 rows a query leave the map side) and so
    gives the kth distance; a second one returns the codes up to it.
    """
    blocks = max(1, -(-open_queries.count() // QUERY_BLOCK))
    codes = index.select("code", F.size("ids").alias("n"))
    out = None
    for i in range(blocks):
        mine = F.broadcast(open_queries.select("q").where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i))
        pairs = codes.join(mine).select("q", "code", "n", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"))
        counts = pairs.groupBy("q", "distance").agg(F.sum("n").alias("n"))
        nearer = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)  # at most BITS + 1 rows
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where(F.col("before") <= k)
        far = materialise(counts.groupBy("q").agg(F.max("distance").alias("far")), "far")
        near = pairs.join(F.broadcast(far), "q").where(F.col("distance") <= F.col("far")).select("q", "code", "n", "distance")
        near = materialise(near, "near")
        out = near if out is None else out.unionByName(near)
    return out


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) for ``queries`` (id, code) among ``codes`` (id, code)."""
    spark = codes.sparkSession
    rows = codes.where("code IS NOT NULL AND id IS NOT NULL").select("id", "code").distinct()
    least = Window.partitionBy("code").orderBy("id")
    rows = rows.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    index = materialise(rows.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    n = index.count()
    asked = materialise(queries.where("code IS NOT NULL AND id IS NOT NULL").select("id", "code").distinct(), "queries")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    active = asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)).repartition(parts, "q")
    active = materialise(active, "active")
    found: DataFrame | None = None
    done: list[DataFrame] = []
    segments: list[tuple[int, int]] = []
    unfinished = True
    for step in search_steps(n):
        if len(segments) != step.count:  # a new start, that finds again what open queries have found
            segments, found = _segments(step.count), None
            postings = materialise(index.select("code", F.size("ids").alias("n"), _values("code", segments).alias("s")).select("code", "n", "s.seg", "s.value"), "postings")
            if n * len(segments) <= BROADCAST_ENTRIES:
                postings = F.broadcast(postings)
        masks = F.broadcast(spark.createDataFrame(step.masks(), "seg int, mask long"))  # at most MOST_MASKS rows
        probes = active.select("q", "bound", _values("q", segments).alias("s")).select("q", "bound", "s.seg", "s.value").join(masks, "seg")
        probes = probes.select("q", "bound", "seg", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        new = (
            probes.join(postings, ["seg", "value"])
            .withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))))
            .where((F.col("distance") <= F.col("bound")) & (_first_at(segments) == F.col("seg")))
            .select("q", "code", "n", "distance")
        )
        every = new if found is None else found.unionByName(new)
        nearer = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        every = every.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where(F.col("before") <= k)
        every = materialise(every.drop("before"), "found")
        bounds = every.groupBy("q").agg(F.max("distance").alias("far"), F.sum("n").alias("held"))
        bounds = active.select("q").join(bounds, "q", "left").select("q", F.when(F.col("held") > k, F.col("far")).otherwise(F.lit(BITS)).alias("bound"))
        left = materialise(bounds.where(F.col("bound") > step.reach), "active")
        finished = every.join(left.select("q"), "q", "left_anti")
        done.append(materialise(finished, "done"))
        unfinished = bool(left.limit(1).count())
        if not unfinished:
            break
        found, active = materialise(every.join(left.select("q"), "q", "left_semi"), "found"), left.repartition(parts, "q")
    if unfinished:
        done.append(_compare_all(index, active, k))
    hits = done[0]
    for more in done[1:]:
        hits = hits.unionByName(more)
    ranked = (
        asked.select(F.col("id").alias("query_id"), F.col("code").alias("q"))
        .join(hits, "q")
        .join(index.select("code", "ids"), "code")
        .select("query_id", "distance", F.explode("ids").alias("neighbor_id"))
        .where("query_id != neighbor_id")
    )
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "neighbor_id", F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every vector whose id is divisible by 50, against all vectors."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), sign_code("embedding").alias("code"))
    return top_k(codes, codes.where(F.col("id") % QUERY_MOD == 0))


OP5_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= 10
"""
