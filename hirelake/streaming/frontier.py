"""The crawl frontier as a stream: pages arrive in any order, addresses and depths come out.

Every address has a small state: its least depth so far, whether its page is here, the links of the
page, and the depth that these were last told. A page that is reached (offered by a reached page, or
a seed) tells its candidate links its depth plus one; such offers are written by batch, one per
address, and are read again as input of the next batch. A shorter way found later is told again, so
the least depths don't depend on how pages are split into batches. State is keyed by address and not
by site: a site of any size is spread over all tasks, and an address that many pages link to meets
one offer per batch.

Exactly once: a batch writes a folder of its own number and writes it anew if it is run again; its
offers are read by later batches only. Depths are least values, so nothing counts twice.

Defined cases: rows without an address are left out; an address that is never reached has no row, nor
has an offered one without a page, but for seeds; pages of one address add up their links; repeated
pages change nothing. With ``forget`` an address not heard of for that long loses its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hirelake import lexicons as L
from hirelake.functions.markup import read_pages
from hirelake.functions.urls import netloc, same_org
from hirelake.operators.pages import link_score

_FOUND = "url string, depth int"
_STATE = "depth int, fetched boolean, told int, links array<string>"
_NEVER = 1 << 30


def page_links(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """(url, link, depth): the candidate links of pages; a page without one has a row without link.

    Pages are dealt out before they are read: a file of theirs may be one block, and so one task."""
    pages = pages.repartition(2 * pages.sparkSession.sparkContext.defaultParallelism)
    rows = read_pages(pages.select("url", "html"), "anchors").select("url", F.explode_outer("anchors").alias("a")).select("url", "a.*")
    good = same_org(netloc("url"), netloc("link")) & (link_score(F.col("text"), F.col("label"), keywords) > 0)
    rows = rows.select("url", F.when(good, F.col("link")).alias("link"), F.lit(None).cast("int").alias("depth"), "pos")
    return rows.where(F.col("link").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0)).drop("pos")


def _step(max_depth: int, forget_ms: int | None):
    """One address's news: what it is reached at, if that is new, and its offers."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        depth, fetched, told, links = state.get if state.exists else (_NEVER, False, _NEVER, [])
        before = depth if depth == 0 or fetched else _NEVER  # the depth that is out already
        known, new = set(links), set()
        for frame in frames:
            offers = frame["depth"].dropna()
            fetched = fetched or len(offers) < len(frame)
            depth = min([depth, *offers.astype(int)])
            new |= set(frame["link"].dropna())
        new -= known
        out = [(key[0], depth, False)] if depth < before and (depth == 0 or fetched) else []
        if fetched and depth < max_depth:
            out += [(link, depth + 1, True) for link in (known | new if depth < told else new)]
            told = depth
        state.update((depth, fetched, told, sorted(known | new)))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        if out:
            yield pd.DataFrame(out, columns=["url", "depth", "offer"])

    return step


class Frontier:
    """Addresses and depths under ``path``, kept by a stream of pages."""

    def __init__(self, spark: SparkSession, path: str, max_depth: int = 3, keywords: list[str] = L.PRIORITY_KEYWORDS, forget_ms: int | None = None):
        self.spark, self.path, self.max_depth, self.keywords, self.forget_ms = spark, path.rstrip("/"), max_depth, keywords, forget_ms

    def seed(self, seeds: DataFrame, name: str = "start") -> None:
        """Begin walks at ``seeds`` (url); a later call takes another name."""
        rows = seeds.select("url").where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0))
        rows.write.mode("overwrite").parquet(f"{self.path}/found/seeds-{name}/offer=true")
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/found/seeds-{name}/offer=false")

    def _found(self, offer: str) -> DataFrame:
        return self.spark.read.schema(_FOUND).parquet(f"{self.path}/found/*/offer={offer}").groupBy("url").agg(F.min("depth").alias("depth"))

    def reached(self) -> DataFrame:
        """(url, depth) of what the walks have reached."""
        return self._found("false")

    def wanted(self) -> DataFrame:
        """(url, depth) of the addresses to fetch next: offered, and not reached."""
        return self._found("true").join(self.reached().select("url"), "url", "left_anti")

    def start(self, pages: DataFrame, interval: str | None = None):
        """Start the stream over streamed ``pages`` (url, html), every ``interval`` or as fast as it goes.

        ``processAllAvailable`` of the query waits until no page and no offer is left."""
        offers = self.spark.readStream.schema(_FOUND).parquet(f"{self.path}/found/*/offer=true").select("url", F.lit(None).cast("string").alias("link"), "depth")
        news = page_links(pages, self.keywords).unionByName(offers).where("url IS NOT NULL")
        timeout = GroupStateTimeout.ProcessingTimeTimeout if self.forget_ms else GroupStateTimeout.NoTimeout
        told = news.groupBy("url").applyInPandasWithState(_step(self.max_depth, self.forget_ms), f"{_FOUND}, offer boolean", _STATE, "append", timeout)

        def batch(rows: DataFrame, number: int) -> None:
            least = rows.groupBy("url", "offer").agg(F.min("depth").alias("depth"))
            least.write.mode("overwrite").partitionBy("offer").parquet(f"{self.path}/found/{number:012d}")

        writer = told.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(processingTime=interval) if interval else writer).start()
