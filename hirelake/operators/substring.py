"""Substring search over an index of character n-grams.

Rows are numbered in groups of 64 as they lie in their files. The index has a row for each gram, field
and group: a long whose bits are the rows that hold the gram. A gram is three code points of the
lower-cased text, packed into one whole number, so it is exact; texts are padded by two zeros, so that
needles of one or two characters are ranges of grams. The index lies in order of the gram, its files
and row groups are pruned by their statistics, and a gram that all rows hold is spread over as many
files as its groups need.

A search intersects the bit sets of the needle's grams and reads only the groups that are left: the
rows are partitioned by the task that wrote them and the join prunes partitions at run time. Every
candidate is verified by ``contains``, so the result equals that of a scan. Python runs only while the
index is built, on Arrow batches.

Defined cases: an empty needle finds all rows, as in a scan; a null field holds nothing; a long text is
cut into overlapping pieces when its grams are taken; repeated rows are found each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.operators.search import SEARCH_FIELDS, icontains
from hirelake.storage import materialise, scratch

GRAM, BITS, GROUP_BITS = 3, 21, 6
#: A row's number is its task's, shifted by this, plus its place there.
TASK_BITS = 33
#: Grams of a needle that are looked up; any of them give a superset of the hits.
MOST_GRAMS = 16
#: Groups whose bit sets are broadcast to the rows; more are joined by a shuffle.
BROADCAST_GROUPS = 1_000_000
#: Code points of a text whose grams are taken at a time.
PIECE = 1 << 20
_ADDED = ["_part", "_group", "_slot"]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _packed(points: np.ndarray) -> np.ndarray:
    return (points[:-2] << (2 * BITS)) | (points[1:-1] << BITS) | points[2:]


def grams_of(text: str) -> np.ndarray:
    """The distinct grams of a text, in order."""
    points = np.append(_points(text), [0] * (GRAM - 1))
    pieces = [np.unique(_packed(points[at : at + PIECE + GRAM - 1])) for at in range(0, len(points) - GRAM + 1, PIECE)]
    return np.unique(np.concatenate(pieces)) if len(pieces) > 1 else pieces[0] if pieces else np.zeros(0, np.int64)


def _bit_sets(fields: int):
    """(field, group, gram, bits) of runs of rows of one group; a group may come in several runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                for field in range(fields):
                    texts = batch.column(field + 2).slice(low, high - low).to_pylist()
                    grams = [grams_of(t) if t else np.zeros(0, np.int64) for t in texts]
                    keys = np.concatenate(grams)
                    if not len(keys):
                        continue
                    bits = np.repeat(np.left_shift(np.uint64(1), slot[low:high].astype(np.uint64)), [len(g) for g in grams])
                    order = np.argsort(keys, kind="stable")
                    keys, bits = keys[order], bits[order]
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    n = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, field, np.int32)), pa.array(np.full(n, group[low], np.int64)), pa.array(keys[first]), pa.array(np.bitwise_or.reduceat(bits, first).view(np.int64))],
                        names=["field", "group", "gram", "bits"],
                    )

    return run


class SubstringIndex:
    """Rows and the bit sets of their grams, as Parquet under ``path``: written by :meth:`build`, used
    again by any session that opens the path with the same fields."""

    GRAMS = "field int, group long, gram long, bits long"

    def __init__(self, spark: SparkSession, path: str, fields: list[str] | None = None):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), fields or SEARCH_FIELDS

    @classmethod
    def build(cls, rows: DataFrame, fields: list[str] | None = None, path: str | None = None) -> SubstringIndex:
        made = cls(rows.sparkSession, path or scratch(rows.sparkSession, "substring"), fields)
        number = F.monotonically_increasing_id()
        placed = rows.withColumn("_number", number).withColumns(
            {"_part": F.shiftright("_number", TASK_BITS).cast("int"), "_group": F.shiftright("_number", GROUP_BITS), "_slot": F.col("_number").bitwiseAND(F.lit((1 << GROUP_BITS) - 1)).cast("int")}
        )
        placed = placed.drop("_number")
        placed.limit(0).write.parquet(f"{made.path}/columns")  # an empty table has no other file that tells them
        placed.write.partitionBy("_part").option("compression", "zstd").parquet(f"{made.path}/rows")
        texts = made.rows().select("_group", "_slot", *[F.lower(F.col(f)).alias(f"_{i}") for i, f in enumerate(made.fields)])
        grams = texts.mapInArrow(_bit_sets(len(made.fields)), cls.GRAMS)
        grams.repartitionByRange("gram", "group").sortWithinPartitions("gram", "group").write.option("compression", "zstd").parquet(f"{made.path}/grams")
        return made

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/columns").schema).parquet(f"{self.path}/rows")

    def grams(self) -> DataFrame:
        return self.spark.read.schema(self.GRAMS).parquet(f"{self.path}/grams")

    def candidates(self, q: str) -> DataFrame:
        """(_part, _group, bits): the rows that hold all looked-up grams of ``q`` in one of the fields."""
        low = self.spark.range(1).select(F.lower(F.lit(q))).first()[0]  # lower case as the rows have it
        points = _points(low)
        if len(points) >= GRAM:
            wanted = np.unique(_packed(points))
            wanted = np.unique(wanted[np.linspace(0, len(wanted) - 1, min(len(wanted), MOST_GRAMS)).astype(int)]).tolist()
            rows, piece = self.grams().where(F.col("gram").isin(wanted)), F.col("gram")
        else:
            least = int(_packed(np.append(points, [0] * (GRAM - len(points))))[0])
            wanted = [least]
            rows, piece = self.grams().where(F.col("gram").between(least, least + (1 << BITS * (GRAM - len(points))) - 1)), F.lit(least)
        rows = rows.select("field", "group", piece.alias("piece"), "bits").repartition("group")  # one exchange for all three steps
        each = rows.groupBy("group", "field", "piece").agg(F.bit_or("bits").alias("bits"))
        both = each.groupBy("group", "field").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
        found = both.groupBy("group").agg(F.bit_or("bits").alias("bits")).where("bits <> 0")
        return found.select(F.shiftright("group", TASK_BITS - GROUP_BITS).cast("int").alias("_part"), F.col("group").alias("_group"), "bits")

    def _hit(self, q: str) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(icontains(f, q), F.lit(False)) for f in self.fields])

    def search(self, q: str | None) -> DataFrame:
        """The rows with ``q`` in any of the fields, as :func:`hirelake.operators.search.keyword_search` has them."""
        return self.rows().drop(*_ADDED) if not q else self._read(q).where(self._hit(q)).drop(*_ADDED)

    def _read(self, q: str) -> DataFrame:
        groups = materialise(self.candidates(q), "groups")
        if groups.count() <= BROADCAST_GROUPS:
            groups = F.broadcast(groups.where("bits <> 0"))
        return self.rows().join(groups, ["_part", "_group"]).where(F.getbit("bits", "_slot") == 1).drop("bits")

    def work(self, q: str) -> DataFrame:
        """One row: how many rows there are, are candidates, and are hits."""
        read = self._read(q).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(self._hit(q)).alias("hits"))
        return self.rows().agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(read))
