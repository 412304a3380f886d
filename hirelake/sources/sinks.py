"""CSV export and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = ["name", "homepage_url", "recruits_url"]
BOM = "﻿"


def export_rows(companies: DataFrame) -> DataFrame:
    """The exported columns, NULL as empty, by id."""
    return companies.orderBy("id").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in EXPORT_COLUMNS])


def export_csv(companies: DataFrame, path: str) -> None:
    """A folder with one CSV file whose header starts with a byte order mark."""
    rows = export_rows(companies)
    rows.coalesce(1).toDF(BOM + EXPORT_COLUMNS[0], *EXPORT_COLUMNS[1:]).write.option("header", True).option("emptyValue", "").option("escape", '"').mode("overwrite").csv(path)


def json_rows(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """One JSON object per row; the company key is shown as ``company``."""
    names = {"company_id": "company"} if rename is None else rename
    return df.select(F.to_json(F.struct(*[F.col(c).alias(names.get(c, c)) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
