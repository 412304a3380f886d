"""Links of pages and what kind of page they make it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake import lexicons as L
from hirelake.functions.markup import page_title, read_pages
from hirelake.functions.posting import accept_as_job, benefit_list, posting_facts, region
from hirelake.functions.text import any_in, blank, count_in, once
from hirelake.functions.urls import netloc, normalize_url, parent_path, redirect_target, same_org
from hirelake.storage import materialise

__all__ = ["anchors", "candidate_links", "classify_pages", "crawl_frontier", "detail_jobs", "direct_links", "external_pages", "heading_blocks", "job_links", "link_score", "listing_counts", "one_page_jobs", "page_text", "page_title", "search_candidates"]

BLOCK_CHARS, BODY_CHARS = 80, 40


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, text, label, link) of every <a> element, in page order."""
    rows = read_pages(pages.select("page_id", "url", "html"), "anchors").select("page_id", "url", F.explode("anchors").alias("a"))
    return rows.select("page_id", "url", "a.pos", "a.href", "a.text", "a.label", "a.link")


def page_text(pages: DataFrame, into: str = "page_text") -> DataFrame:
    """Pages with the collapsed text of their body."""
    return read_pages(pages, "page_text").withColumnRenamed("page_text", into)


def external_pages(links: DataFrame, domains: list[str] = L.EXTERNAL_DOMAINS, of: str = "href") -> DataFrame:
    """page_id of pages with a link to an external job platform: a domain in the link as written
    (``href``), as an absolute URL (``link``), or in its host alone (``host``)."""
    target = netloc("link") if of == "host" else F.col(of)
    return links.where(any_in(F.lower(target), domains)).select("page_id").distinct()


def job_links(links: DataFrame, keywords: list[str] = L.JOB_ANCHORS, excluded: list[str] = L.EXCLUDED_ANCHORS, domains: list[str] = L.EXTERNAL_DOMAINS) -> DataFrame:
    """Links of listing pages that read as postings: (page_id, pos, job_url), first of each URL."""
    text = F.lower("text")
    usable = (F.col("href") != "") & ~F.col("href").startswith("#") & ~F.lower("href").startswith("javascript:")
    keep = usable & same_org(netloc("url"), netloc("link")) & (F.col("text") != "") & ~any_in(text, excluded) & any_in(text, keywords)
    rows = links.where(keep).join(external_pages(links, domains, "host"), "page_id", "left_anti")
    rows = rows.withColumn("job_url", F.regexp_replace("link", r"/+$", ""))
    return rows.groupBy("page_id", "job_url").agg(F.min("pos").alias("pos"))


def link_score(text: Column, label: Column, keywords: list[str] = L.PRIORITY_KEYWORDS) -> Column:
    return 10 * count_in(F.concat(F.lower(blank(text)), F.lit(" "), F.lower(blank(label))), [k.lower() for k in keywords])


def candidate_links(links: DataFrame, keywords: list[str] = L.PRIORITY_KEYWORDS, visited: DataFrame | None = None) -> DataFrame:
    """Links worth following: positive score, not visited, ranked by score then page order."""
    rows = links.withColumn("score", link_score(F.col("text"), F.col("label"), keywords)).where("score > 0 AND link IS NOT NULL")
    if visited is not None:
        rows = rows.join(visited.select(F.col("url").alias("link")), "link", "left_anti")
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).select("page_id", "pos", "link", "score", "rank")


def direct_links(links: DataFrame, keywords: list[str] = L.PRIORITY_KEYWORDS, domains: list[str] = L.EXTERNAL_DOMAINS) -> DataFrame:
    """Per page the first priority link inside the organisation."""
    keep = (link_score(F.col("text"), F.col("label"), keywords) > 0) & F.col("link").isNotNull() & ~any_in(F.lower("link"), domains) & same_org(netloc("url"), netloc("link"))
    return links.where(keep).groupBy("page_id").agg(F.min_by("link", "pos").alias("direct_link"))


def listing_counts(links: DataFrame, keywords: list[str] = L.PRIORITY_KEYWORDS) -> DataFrame:
    """Per page the most priority links that share a parent path."""
    rows = links.where((F.col("href") != "") & (link_score(F.col("text"), F.col("label"), keywords) > 0))
    return rows.groupBy("page_id", parent_path("link").alias("parent")).agg(F.count(F.lit(1)).alias("n")).groupBy("page_id").agg(F.max("n").alias("most"))


def most_of_a_kind(links: str, keywords: list[str] = L.PRIORITY_KEYWORDS) -> Column:
    """The same within a page's list of links: the longest run of equal parent paths in their order."""
    wanted = F.filter(links, lambda a: (a["href"] != "") & (link_score(a["text"], a["label"], keywords) > 0))
    parents = F.array_sort(F.transform(wanted, lambda a: F.coalesce(parent_path(a["link"]), F.lit(""))))
    begin = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, parent: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(parent), s["run"] + 1).otherwise(1)
        return F.struct(parent.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(parents, begin, step, lambda s: s["most"])


def classify_pages(
    pages: DataFrame, depth: int | str = 0, keywords: list[str] = L.PRIORITY_KEYWORDS, listing_words: list[str] = L.LISTING_WORDS, one_page_words: list[str] = L.ONE_PAGE_WORDS, domains: list[str] = L.EXTERNAL_DOMAINS
) -> DataFrame:
    """(page_id, url, page_type, post_type): external, else listing, else main at depth 0 or
    one_page below it; NULL where none fits. A listing needs 5 links of a kind at depth 0, else 3."""
    at = F.lit(depth) if isinstance(depth, int) else F.col(depth)
    read = read_pages(pages.withColumn("_depth", at).select("page_id", "url", "html", "_depth"), "page_text", "anchors")
    df = read.withColumns({"_low": F.lower("page_text"), "_external": F.exists("anchors", lambda a: any_in(F.lower(a["href"]), domains)), "most": most_of_a_kind("anchors", keywords)})
    listing = any_in(F.col("_low"), listing_words) & (F.col("most") >= F.when(F.col("_depth") == 0, 5).otherwise(3))
    kind = (
        F.when(F.col("_external"), "external")
        .when(listing, "listing")
        .when(any_in(F.col("_low"), one_page_words), F.when(F.col("_depth") == 0, "main").otherwise("one_page"))
    )
    return df.select("page_id", "url", kind.alias("page_type"), F.when(kind == "external", "external_link").when(kind.isNotNull(), "text").alias("post_type"))


def crawl_frontier(pages: DataFrame, seeds: DataFrame, max_depth: int = 3, keywords: list[str] = L.PRIORITY_KEYWORDS) -> DataFrame:
    """(url, depth) of the pages that a walk from ``seeds`` (url) reaches over candidate links inside
    the organisation, among fetched ``pages``; at most ``max_depth`` joins."""
    links = anchors(pages).where(same_org(netloc("url"), netloc("link")) & (link_score(F.col("text"), F.col("label"), keywords) > 0)).select("url", "link").distinct()
    links = materialise(links, "links")
    reached = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    front = reached
    for depth in range(1, max_depth + 1):
        front = front.select("url").join(links, "url").select(F.col("link").alias("url")).distinct().join(reached, "url", "left_anti").join(pages.select("url").distinct(), "url", "left_semi").withColumn("depth", F.lit(depth))
        front = materialise(front, "front")
        reached = reached.unionByName(front)
    return reached


def search_candidates(pages: DataFrame, blocked: list[str] = L.BLOCKED_HOSTS) -> DataFrame:
    """Homepage found on each search-result page: addresses of result URLs before those of titles."""

    def home(x: Column) -> Column:
        fallback = F.when((x["tier"] == 1) & (x["text"] != ""), x["text"]).otherwise(x["href"])
        address = F.coalesce(F.nullif(redirect_target(x["href"]), F.lit("")), fallback)
        return F.when(x["tier"].isNotNull(), once(address, lambda a: normalize_url(a, blocked)))

    def placed(a: Column) -> Column:
        css = F.concat(F.lit(" "), F.regexp_replace(a["css"], r"\s", " "), F.lit(" "))
        tier = once(css, lambda c: F.when(c.contains(" result__url "), 1).when(c.contains(" result__a "), 2))
        return F.struct(tier.alias("tier"), a["href"].alias("href"), a["text"].alias("text"))

    found = F.transform(F.transform("anchors", placed), lambda x: F.struct(x["tier"].alias("tier"), home(x).alias("home")))
    rows = read_pages(pages.select("page_id", "html"), "anchors").select("page_id", F.posexplode(found).alias("pos", "x")).select("page_id", "pos", "x.tier", "x.home").where("home IS NOT NULL")
    return rows.groupBy("page_id").agg(F.min_by("home", F.struct("tier", "pos")).alias("homepage_url"))


def heading_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, i, title, body): one row per h2/h3, i counting all of them; the text is that of
    the elements that follow it beside it, up to the next h1-h3."""
    rows = read_pages(pages.select("page_id", "url", "html"), "blocks").select("page_id", "url", F.explode("blocks").alias("b"))
    return rows.select("page_id", "url", "b.i", "b.title", "b.body")


def one_page_jobs(pages: DataFrame, keywords: list[str] = L.ACCEPT_KEYWORDS, classifier=None) -> DataFrame:
    """Postings of one-page sites: one per heading block, or the whole page if it has no h2/h3."""
    read = read_pages(pages.select("page_id", "url", "html"), "document_title", "page_text", "blocks")
    title = F.coalesce(F.nullif("document_title", F.lit("")), F.lit("채용 공고"))
    of_block = F.transform("blocks", lambda b: F.struct(F.concat("url", F.lit("#job-"), b["i"]).alias("post_url"), b["title"].alias("title"), b["body"].alias("body")))
    whole = F.array(F.struct(F.col("url").alias("post_url"), title.alias("title"), F.col("page_text").alias("body")))
    both = read.select("page_id", F.explode(F.when(F.size("blocks") > 0, F.filter(of_block, lambda b: b["title"] != "")).otherwise(whole)).alias("b")).select("page_id", "b.*")
    return both.where((F.length("body") >= BLOCK_CHARS) & accept_as_job("body", keywords, classifier)).select(
        "page_id", "post_url", "title", F.substring("body", 1, 20000).alias("job_description"), region("body").alias("location"), benefit_list("body").alias("benefits")
    )


def detail_jobs(pages: DataFrame, keywords: list[str] = L.ACCEPT_KEYWORDS, from_listing: bool = False, classifier=None) -> DataFrame:
    """The posting of each detail page: title, text and facts; pages that don't read as postings go,
    unless they were reached from a listing."""
    df = read_pages(pages.select("page_id", "url", "html"), "title", "page_text").where((F.length("page_text") >= BODY_CHARS) & (F.coalesce("title", F.lit("")) != ""))
    if not from_listing:
        df = df.where(accept_as_job("page_text", keywords, classifier))
    return df.select("page_id", F.col("url").alias("post_url"), "title", *[c.alias(n) for n, c in posting_facts("page_text").items()])
