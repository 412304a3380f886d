"""Intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``.

Executors and the driver all see that folder. Only where the setting is absent and the master is
local, so that all of them are one process (tests, notebooks), a temporary folder is made and set.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
#: Tables that the innermost :func:`finish` of this thread has seen written.
_seen: ContextVar[list[str] | None] = ContextVar("_seen", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="hirelake-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation of what is already written."""
    return _written_table(df, tag)[0]


def _written_table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted at the end of the process."""
    path = f"{shared_dir(spark)}/hirelake-{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    if (seen := _seen.get()) is not None:
        seen.append(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than cores, dealt over all cores; larger tables, whose scans fill the cluster
    anyway, as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 0 < len(df.inputFiles()) < cores else df


def release(df: DataFrame) -> None:
    """Delete the files of a table from :func:`materialise` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        for path in [p for p in _written if p.split("://")[-1] in file]:
            _delete(path)


def finish(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """Write the result of ``make`` and delete all other tables that this thread wrote on the way to it."""
    outer, own = _seen.get(), []
    token = _seen.set(own)
    try:
        out, result = _written_table(make(), tag)
    finally:
        _seen.reset(token)
    if outer is not None:
        outer.append(result)
    for path in own:
        if path != result and path in _written:
            _delete(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete(path: str) -> None:
    delete(_written.pop(path), path)


@atexit.register
def _tidy() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone at exit
            break
