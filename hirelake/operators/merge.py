"""Keyed merges: joins of a source with a target whose result replaces the target.

Times are parameters, so a merge is a function of its inputs; new ids follow from the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake import lexicons as L
from hirelake.functions.text import blank, flag, strip


def last_values(source: DataFrame, key: str, columns: list[str], line: str) -> DataFrame:
    """Per key the last non-empty (stripped) value of each column, in order of ``line``."""
    keyed = source.withColumn("_key", strip(blank(key))).where("_key <> ''")
    values = [F.max_by(strip(F.col(c)), F.when(strip(blank(c)) != "", F.col(line))).alias(c) for c in columns]
    return keyed.groupBy("_key").agg(*values, F.count(F.lit(1)).alias("_rows")).withColumnRenamed("_key", key)


def with_new_ids(rows: DataFrame, target: DataFrame, is_new: Column, key: str, dealt: Column | None = None) -> DataFrame:
    """``id`` of new rows: the target's greatest plus their rank.

    New keys are dealt into 4096 buckets by md5 (of ``dealt``, the key if that is not given) and numbered
    within, so no task holds them all; ids follow (md5 prefix, key).
    """
    top = target.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    dealt = F.col(key) if dealt is None else dealt
    fresh = rows.where(is_new).select(F.col(key).alias("_k"), F.substring(F.md5(dealt.cast("string")), 1, 3).alias("_cut"))
    sizes = fresh.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.sum("_n").over(Window.orderBy("_cut")) - F.col("_n"))
    ranked = fresh.withColumn("_at", F.row_number().over(Window.partitionBy("_cut").orderBy("_k"))).join(sizes, "_cut").select("_k", (F.col("_base") + F.col("_at")).alias("_rank"))
    joined = rows.join(ranked, F.col(key).eqNullSafe(F.col("_k")), "left").join(F.broadcast(top))
    return joined.withColumn("id", F.coalesce("id", F.col("_top") + F.col("_rank"))).drop("_k", "_rank", "_top")


SEED_COLUMNS = ["homepage_url", "recruits_url", "page_type", "post_type", "region"]


def seed_merge(target: DataFrame, source: DataFrame, line: str = "line", columns: list[str] | None = None, hiring: str | None = "hiring", key: str = "name", source_key: str = "company_name") -> DataFrame:
    """Companies after merging seed rows: non-empty values overwrite, empty ones keep; blank names
    are skipped; ``hiring`` is a three-way flag, ambiguous cells keep the old value."""
    columns = SEED_COLUMNS if columns is None else columns
    prepared = source.withColumn("_flag", F.when(flag(F.col(hiring)).isNotNull(), F.col(hiring))) if hiring else source
    latest = last_values(prepared, source_key, [*columns, *(["_flag"] if hiring else [])], line).withColumnRenamed(source_key, "_name").drop("_rows")
    latest = latest.select("_name", *[F.col(c).alias(f"_new_{c}") for c in latest.columns if c != "_name"])
    joined = target.join(latest, F.col(key) == F.col("_name"), "full_outer")
    out = joined.withColumn("_is_new", F.col(key).isNull()).withColumn(key, F.coalesce(key, "_name"))
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    if hiring:
        out = out.withColumn(hiring, F.coalesce(flag("_new__flag"), F.col(hiring), F.lit(False)))
    return out.drop("_name", *[c for c in out.columns if c.startswith("_new_")])


def merge_metrics(target: DataFrame, source: DataFrame, key: str = "name", source_key: str = "company_name") -> DataFrame:
    """created, updated, skipped: rows of the source; repeated names count as updates."""
    names = source.select(strip(blank(source_key)).alias("_name"))
    known = target.select(F.col(key).alias("_known")).distinct()
    by_name = names.groupBy("_name").agg(F.count(F.lit(1)).alias("n")).join(known, F.col("_name") == F.col("_known"), "left")
    blank_name, is_new = F.col("_name") == "", F.col("_known").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_name.agg(
        total(F.when(~blank_name & is_new, 1)).alias("created"),
        total(F.when(~blank_name, F.col("n") - is_new.cast("int"))).alias("updated"),
        total(F.when(blank_name, F.col("n"))).alias("skipped"),
    )


def job_upsert(target: DataFrame, source: DataFrame, now: Column, line: str = "line", fields: dict[str, int] | None = None) -> DataFrame:
    """Postings after upserting crawled ones by ``post_url``, with ``_change`` in
    {inserted, changed, same, kept}.

    Inserts take values as they are, cut to their limits; updates take stripped non-empty values
    that differ, set the status back to active, and touch ``crawled_at`` only if anything changed.
    The company of a known posting never changes; blank URLs are dropped; of several source rows
    of a URL the last counts.
    """
    fields = L.FIELD_LIMITS if fields is None else fields
    rows = source.where(blank("post_url") != "")
    last = rows.groupBy("post_url").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("post_url", line)]), line).alias("new"))
    last = last.withColumnRenamed("post_url", "_url")
    joined = target.join(last, F.col("post_url") == F.col("_url"), "full_outer")
    known, given = F.col("post_url").isNotNull(), F.col("_url").isNotNull()
    out, changed = joined, F.lit(False)
    for c, limit in fields.items():
        raw = F.substring(F.col(f"new.{c}"), 1, limit)
        value = F.substring(strip(blank(f"new.{c}")), 1, limit)
        differs = known & given & (value != "") & ~value.eqNullSafe(F.col(c))
        out = out.withColumn(f"_set_{c}", F.when(differs, value).when(~known, raw).otherwise(F.col(c)))
        changed = changed | differs
    changed = F.coalesce(changed | (known & given & ~F.col("status").eqNullSafe("active")), F.lit(False))
    out = out.withColumn("_change", F.when(~known, "inserted").when(~given, "kept").when(changed, "changed").otherwise("same"))
    touched = F.col("_change").isin("inserted", "changed")
    out = out.withColumns(
        {
            "company_id": F.coalesce("company_id", "new.company_id"),
            "status": F.when(touched, F.lit("active")).otherwise(F.col("status")),
            "crawled_at": F.when(touched, now).otherwise(F.col("crawled_at")),
            "first_seen_at": F.when(F.col("_change") == "inserted", now).otherwise(F.col("first_seen_at")),
            "is_active": F.coalesce("is_active", F.lit(True)),
            "post_url": F.coalesce("post_url", "_url"),
        }
    )
    return out.drop(*fields).withColumnsRenamed({f"_set_{c}": c for c in fields}).drop("_url", "new")


def replace_by_key(target: DataFrame, source: DataFrame, key: str, line: str) -> DataFrame:
    """Source rows (the last of each key) replace the target's rows of their keys; others stay."""
    columns = [c for c in target.columns if c != key]
    last = source.groupBy(key).agg(F.max_by(F.struct(*columns), line).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
    return target.join(last.select(key), key, "left_anti").unionByName(last.select(target.columns))


def set_values(target: DataFrame, updates: DataFrame, key: str, columns: list[str], line: str) -> DataFrame:
    """Columns set by key, later updates winning; NULL keeps."""
    last = updates.groupBy(F.col(key).alias("_key")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(line))).alias(f"_{c}") for c in columns])
    out = target.join(last, F.col(key) == F.col("_key"), "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop("_key", *[f"_{c}" for c in columns])


def cascade_delete(children: DataFrame, deleted: DataFrame, foreign_key: str, key: str) -> DataFrame:
    """Children whose parent is not deleted."""
    return children.join(deleted.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Violations of a unique constraint: key and number of rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
