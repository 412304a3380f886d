"""CSV and JSON sources, read with all-string or declared schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake import schemas
from hirelake.storage import materialise

#: Encodings of CSV files, in the order in which they are tried, and Spark's names of them.
SPARK_NAMES = {"utf-8-sig": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}
ENCODINGS = list(SPARK_NAMES)
_CHARSETS = "spark.sql.legacy.javaCharsets"


def detect_encoding(spark: SparkSession, path: str) -> str | None:
    """The first encoding that decodes all of the file (or folder); None if none does.

    Lines are tested where they are read: no byte of a line break is part of a longer character in
    any of the encodings.
    """
    lines = spark.read.text(path).select("value")
    if not lines.where(~F.call_function("is_valid_utf8", "value")).limit(1).count():
        return "utf-8-sig"
    others = [e for e in ENCODINGS if e != "utf-8-sig"]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fails = [False] * len(others)
        for batch in batches:
            for line in batch.column(0).to_pylist():
                for i, encoding in enumerate(others):
                    try:
                        if not fails[i]:
                            line.decode(encoding)
                    except UnicodeDecodeError:
                        fails[i] = True
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in fails], names=others)

    tested = lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(test, ", ".join(f"`{e}` boolean" for e in others))
    row = tested.agg(*[F.max(f"`{e}`").alias(e) for e in others]).first()
    return next((e for e in others if not row[e]), None)


def read_csv(spark: SparkSession, path: str, strict: bool = False, required: list[str] | None = None) -> DataFrame:
    """CSV files as strings, with a ``line`` column (file, place in it) that gives their order.

    Encodings are tried in order. If none fits, a strict read raises and a lenient one reads UTF-8
    with replacement characters dropped. Missing required columns raise. A file is one task, as its
    quoted values may hold line breaks; files of a folder are read side by side.
    """
    encoding = detect_encoding(spark, path)
    if encoding is None and strict:
        raise ValueError(f"{path}: none of {', '.join(ENCODINGS)} decodes it")
    if encoding in (None, "utf-8-sig"):
        df = _parse(spark, path, "UTF-8")
    else:  # Spark 4 reads other than Unicode encodings only with this setting, which the session gets back
        before = spark.conf.get(_CHARSETS)
        spark.conf.set(_CHARSETS, "true")
        try:
            df = materialise(_parse(spark, path, SPARK_NAMES[encoding]), "csv")
        finally:
            spark.conf.set(_CHARSETS, before)
    if encoding is None:
        df = df.select(*[F.replace(F.col(f"`{c}`"), F.lit("\ufffd"), F.lit("")).alias(c) for c in df.columns if c != "line"], "line")
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return df


def _parse(spark: SparkSession, path: str, charset: str) -> DataFrame:
    rows = spark.read.option("header", True).option("encoding", charset).option("multiLine", True).option("escape", '"').csv(path)
    named = [F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in rows.columns]
    return rows.select(*named, F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).alias("line"))


def read_company_seed(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path, required=["company_name"])
    wanted = ["company_name", "homepage_url", "recruits_url", "page_type", "post_type", "hiring", "region"]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted], "line")


def parse_requests(df: DataFrame, schema: str = schemas.COUNSELING_REQUEST, column: str = "value") -> DataFrame:
    """JSON request bodies as columns; invalid ones give NULLs."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    return df.withColumn("_r", parsed).select(*[c for c in df.columns if c != column], "_r.*")


def safe_json(c: str, schema: str):
    """A JSON text as a struct; NULL if it is NULL or invalid."""
    return F.from_json(F.col(c), schema, {"mode": "PERMISSIVE"})
