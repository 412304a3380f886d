"""What the training-data operators share: table access, the shared folder, prefix sums.

Nothing here collects rows. Intermediate tables go to the session's shared folder, see
:mod:`hirelake.storage`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.storage import materialise, release, shared_dir

__all__ = ["bucket_of", "cut_copies", "free_names", "materialise", "order_key", "prefix_sums", "release", "shared_dir", "spread_copies", "table", "text_of"]

#: Hex digits of the md5 order key that split a group into 16**3 even buckets.
BUCKET_DIGITS = 3
#: Copies of one row that are written out in one place; more of them are dealt out first.
COPIES = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def order_key(column: str | Column) -> Column:
    """md5 of the key as text: an even, reproducible shuffle order (null sorts as 'null')."""
    column = F.col(column) if isinstance(column, str) else column
    return F.md5(F.coalesce(column.cast("string"), F.lit("null")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def cut_copies(df: DataFrame, okey: str = "okey", into: str = "part") -> DataFrame:
    """Counted rows of at most COPIES ``copies`` each, told apart by ``into``.

    The parts of a row get order keys of their own (the first keeps its key), so that
    :func:`prefix_sums` deals them over its buckets: no task writes out a whole group of copies.
    """
    parts = df.withColumn(into, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES).cast("long"))))
    own = F.when(F.col(into) == 0, F.col(okey)).otherwise(F.md5(F.concat_ws(":", F.col(okey), F.col(into).cast("string"))))
    return parts.withColumns({"copies": F.least(F.col("copies") - F.col(into) * COPIES, F.lit(COPIES).cast("long")), okey: own})


def spread_copies(df: DataFrame, into: str = "copy") -> DataFrame:
    """A row per copy, numbered from 1, in place of ``copies``.

    ``df`` should be a table that is cheap to read twice: rows of more than COPIES copies are cut
    and dealt out over all tasks before they are written out.
    """
    first, last, part = free_names(df, "first", "last", "part")
    few = df.where(F.col("copies") <= COPIES).withColumn(into, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    many = df.where(F.col("copies") > COPIES).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES).cast("long"))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.withColumns({first: F.col(part) * COPIES + 1, last: F.least(F.col("copies"), (F.col(part) + 1) * COPIES)}).drop(part).repartition(parts)
    many = many.withColumn(into, F.explode(F.sequence(first, last))).drop(first, last)
    return few.unionByName(many).drop("copies")


def bucket_of(key: Column) -> Column:
    return F.substring(key, 1, BUCKET_DIGITS)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``before`` (sum of ``value`` over earlier rows of the group) and ``group_total``.

    ``order[0]`` must be an :func:`order_key`. A group is dealt into 4096 even buckets of that
    key, so no group of any size meets in one task; only the buckets' totals (groups x 4096 rows
    at most) are summed up in order. Rows of ``df`` must be distinct in ``group + order``:
    callers aggregate repeated rows first, which Spark does before the shuffle.
    """
    cut = df.withColumn("_bucket", bucket_of(F.col(order[0])))
    totals = cut.groupBy(*group, "_bucket").agg(F.sum(value).alias("_in_bucket"))
    by_group = Window.partitionBy(*group)
    totals = totals.withColumn(
        "_base",
        F.sum("_in_bucket").over(by_group.orderBy("_bucket")) - F.col("_in_bucket"),
    ).withColumn("group_total", F.sum("_in_bucket").over(by_group))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    cut = cut.withColumn(
        "_within",
        F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value),
    )
    totals = totals.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_bucket").alias("_g_bucket"), "_base", "group_total")
    match = F.col("_bucket") == F.col("_g_bucket")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return (
        cut.join(totals, match)
        .withColumn("before", F.col("_base") + F.col("_within"))
        .drop("_bucket", "_g_bucket", "_base", "_within", *[f"_g_{c}" for c in group])
    )
