import pytest
from pyspark.sql import functions as F

from hirelake.operators.pages import crawl_frontier
from hirelake.streaming.frontier import Frontier, page_links

SITE = {
    "a": ["b", "c"], "b": ["d"], "c": ["d", "e", "a"], "d": ["f"], "e": ["g"], "f": ["h"], "g": ["e"], "h": ["i"], "s": ["f"], "x": ["a"], "lone": [],
}


def _pages(spark, extra=()):
    link = lambda t: f'<a href="https://site.kr/{t}">jobs</a>'
    rows = [(i, f"https://site.kr/{u}", "<p>text</p>" + "".join(map(link, to)) + '<a href="https://other.kr/z">jobs</a><a href="/q">about</a>') for i, (u, to) in enumerate(SITE.items())]
    return spark.createDataFrame([*rows, *extra], "page_id long, url string, html string")


def _run(walk, spark, at):
    query = walk.start(spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", 1).parquet(at))
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@pytest.mark.parametrize("batches", [["abcdefghsx"], ["hgfe", "dcsx", "ba"], ["s", "f", "abx", "hdecg"]])
def test_same_depths_however_pages_arrive(spark, tmp_path, batches):
    pages = _pages(spark, [(90, "https://site.kr/a", '<a href="https://site.kr/lone">jobs</a>'), (91, None, "<a>"), (92, "https://site.kr/none", None)])
    seeds = spark.createDataFrame([("https://site.kr/a",), ("https://site.kr/a",), ("https://site.kr/missing",), (None,)], "url string")
    at = str(tmp_path / "pages")
    letter = F.coalesce(F.regexp_extract("url", "kr/(.*)", 1), F.lit(""))
    for group in [*batches, ""]:
        rows = pages.where(letter.isin(*group)) if group else pages.where(~letter.isin(*"".join(batches)))
        rows.select("url", "html").coalesce(1).write.mode("append").parquet(at)
    walk = Frontier(spark, str(tmp_path / "walk"), 3, ["jobs"])
    walk.seed(seeds)
    _run(walk, spark, at)
    wanted = crawl_frontier(pages, seeds.where("url IS NOT NULL"), 3, ["jobs"])
    assert {tuple(r) for r in walk.reached().collect()} == {tuple(r) for r in wanted.collect()}
    assert walk.reached().where("url LIKE '%/f'").first().depth == 3


def test_later_pages_and_seeds_shorten_ways(spark, tmp_path):
    pages, at = _pages(spark), str(tmp_path / "pages")
    pages.where("url NOT LIKE '%/c'").select("url", "html").coalesce(1).write.parquet(at)
    walk = Frontier(spark, str(tmp_path / "walk"), 3, ["jobs"])
    walk.seed(pages.where("url LIKE '%/a'"))
    _run(walk, spark, at)
    assert {(r.url[-1], r.depth) for r in walk.reached().collect()} == {("a", 0), ("b", 1), ("d", 2), ("f", 3)}
    assert [(r.url[-1], r.depth) for r in walk.wanted().collect()] == [("c", 1)]
    pages.where("url LIKE '%/c'").select("url", "html").coalesce(1).write.mode("append").parquet(at)
    walk.seed(pages.where("url LIKE '%/s'"), "more")
    _run(walk, spark, at)  # from its checkpoint
    seeds = pages.where("url LIKE '%/a' OR url LIKE '%/s'").select("url")
    assert {tuple(r) for r in walk.reached().collect()} == {tuple(r) for r in crawl_frontier(pages, seeds, 3, ["jobs"]).collect()}
    assert [(r.url[-1], r.depth) for r in walk.wanted().collect()] == [("i", 3)]  # a link without a page


def test_pages_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    pages = _pages(spark).select("url", "html")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    one = spark.read.parquet(str(tmp_path / "pages"))
    assert one.rdd.getNumPartitions() == 1
    links = page_links(one, ["jobs"])
    assert links.select(F.spark_partition_id()).distinct().count() > 1
    assert {r.url[-1] for r in links.collect()} == {r.url[-1] for r in pages.collect()}
