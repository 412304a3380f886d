import duckdb
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from hirelake.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, sf, con, name):
    compare(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


#: Queries over pages of which several share an address: each page is a posting.
SHARED = ["stream_upsert", "stream_upsert_twice", "stream_on_schedule", "new_ids_unique", "stream_kept_counts"]


@pytest.mark.parametrize("name", SHARED)
def test_pages_that_share_an_address_against_sql(spark, sf, tmp_path, name):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    shared = pages.withColumn("url", F.when(F.col("page_id") % 5 == 0, F.lit("http://one.example.net/")).otherwise(F.col("url")))
    shared.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    compare(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.SQL[name])


def test_companies_whose_pages_share_an_address_against_sql(spark, sf, tmp_path):
    """Some of them but for a slash at the end."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    shared = F.when(F.col("page_id") % 5 == 0, F.lit("http://one.example.net/")).when(F.col("page_id") % 5 == 1, F.lit("http://one.example.net"))
    pages.withColumn("url", F.coalesce(shared, "url")).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    compare(catalog.QUERIES["listing_fallback"](spark, str(tmp_path)), con, catalog.SQL["listing_fallback"])


@pytest.mark.parametrize("name", ["stream_upsert_twice", "stream_kept_counts"])
def test_changed_pages_at_the_bounds_of_a_posting_against_sql(spark, tmp_path, name):
    """A change moves a word out of the part that is looked at, or makes a text long enough."""
    texts = ["the " + "x" * 2988 + " que", "the que " + "x" * 26, "the que " + "x" * 40]
    rows = [(i, f"http://p{i}.example.net/", f"<html><head><title>t</title></head><body><h1>Top</h1>\n<p>{texts[i // 4 % 3]}</p></body></html>") for i in range(24)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert con.execute(catalog.SQL["new_ids_unique"]).fetchone()[0] == 16
    compare(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
