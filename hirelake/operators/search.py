"""Filters, N:1 joins, sorting and paging over postings and companies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
SEARCH_FIELDS = ["title", "job_description", "qualifications", "preferred_qualifications"]


def icontains(c: str | Column, needle: str) -> Column:
    """Case-insensitive literal substring."""
    return F.contains(F.lower(F.col(c) if isinstance(c, str) else c), F.lower(F.lit(needle)))


def active_filter(df: DataFrame, active: str | None, column: str = "is_active") -> DataFrame:
    """Only active or only inactive rows; any other parameter filters nothing."""
    wanted = {"1": True, "true": True, "True": True, "t": True, "yes": True, "y": True, "0": False, "false": False, "False": False, "f": False, "no": False, "n": False}.get(active or "")
    return df if wanted is None else df.where(F.col(column) if wanted else ~F.col(column))


def keyword_search(df: DataFrame, q: str | None, fields: list[str] | None = None) -> DataFrame:
    """Rows with ``q`` in any of the fields."""
    fields = fields or SEARCH_FIELDS
    return df if not q else df.where(reduce(lambda a, b: a | b, [F.coalesce(icontains(f, q), F.lit(False)) for f in fields]))


def in_list(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows with the column in ``values``; an empty list filters nothing."""
    return df.where(F.col(column).isin(list(values))) if values else df


def with_company(postings: DataFrame, companies: DataFrame, key: str = "company_id", company_key: str = "id") -> DataFrame:
    """N:1 join; company columns are prefixed. Spark broadcasts companies while they are small."""
    renamed = companies.select(*[F.col(c).alias("_company_key" if c == company_key else f"company_{c}") for c in companies.columns])
    return postings.join(renamed, F.col(key) == F.col("_company_key")).drop("_company_key")


def page(df: DataFrame, number: int = 1, size: int = PAGE_SIZE, order: list[Column] | None = None) -> DataFrame:
    """A page of the ordered rows; the size is at most MAX_PAGE_SIZE."""
    size = max(1, min(size, MAX_PAGE_SIZE))
    return df.orderBy(*(order or [F.desc("id")])).offset((max(number, 1) - 1) * size).limit(size)


def page_after(df: DataFrame, last: int | None = None, size: int = PAGE_SIZE, key: str = "id") -> DataFrame:
    """The page that follows the row with key ``last`` (the first page without one), greatest key first.

    The key in the page's link takes the place of the page number: however far back a page lies, each
    task keeps at most a page of rows, and rows that are added meanwhile shift no page. Rows with a null
    key are on no page; rows of one key are on one page together only where keys are unique.
    """
    rows = df.where(F.col(key).isNotNull() if last is None else F.col(key) < last)
    return rows.orderBy(F.desc(key)).limit(max(1, min(size, MAX_PAGE_SIZE)))


def page_after_envelope(df: DataFrame, last: int | None = None, size: int = PAGE_SIZE, key: str = "id", results: list[str] | None = None) -> DataFrame:
    """One row: the page's rows in order, and the query string of the next page (NULL on the last one)."""
    size = max(1, min(size, MAX_PAGE_SIZE))
    more = df.where(F.col(key).isNotNull() if last is None else F.col(key) < last).orderBy(F.desc(key)).limit(size + 1)  # one row more than a page
    rows = more.agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_key"), F.struct(*(results or df.columns)).alias("row"))))).alias("rows"))
    page_ = F.slice("rows", 1, size)
    link = F.concat(F.lit("?after="), F.element_at(page_, -1)["_key"].cast("string"), F.lit(f"&page_size={size}"))
    return rows.select(F.when(F.size("rows") > size, link).alias("next"), F.transform(page_, lambda x: x["row"]).alias("results"))


def page_envelope(df: DataFrame, number: int, size: int = PAGE_SIZE, order: list[Column] | None = None, results: list[str] | None = None) -> DataFrame:
    """One row: count, whether there is a next and a previous page, the query strings of these (NULL
    where there is none) and the page's rows, as an array of structs in order (at most MAX_PAGE_SIZE)."""
    size = max(1, min(size, MAX_PAGE_SIZE))
    order = order or [F.desc("id")]
    rows = page(df, number, size, order).select(F.row_number().over(Window.orderBy(*order)).alias("at"), F.struct(*(results or df.columns)).alias("row"))  # one page
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]).alias("results"))
    link = lambda n: F.lit(f"?page={n}&page_size={size}")
    total = df.agg(F.count(F.lit(1)).alias("count"))
    total = total.select("count", (F.col("count") > number * size).alias("has_next"), F.lit(number > 1).alias("has_previous"))
    total = total.withColumns({"next": F.when(F.col("has_next"), link(number + 1)), "previous": F.when(F.col("has_previous"), link(number - 1))})
    return total.join(F.broadcast(rows))


def search_jobs(
    postings: DataFrame, companies: DataFrame, active: str | None = None, q: str | None = None, company: str | None = None, region: str | None = None, number: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    """The postings list: filters, company filters through the key, newest first, one page."""
    df = keyword_search(active_filter(postings, active), q)
    joined = with_company(df, companies)
    if company:
        joined = joined.where(icontains("company_name", company))
    if region:
        joined = joined.where(icontains("company_region", region))
    return page(joined, number, size)


def facet(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def missing_homepages(companies: DataFrame, limit: int | None = None) -> DataFrame:
    """Companies without a homepage (NULL only), by id."""
    df = companies.where(F.col("homepage_url").isNull()).orderBy("id")
    return df.limit(limit) if limit else df


def discover_targets(companies: DataFrame, limit: int | None = None, none_is_missing: bool = False) -> DataFrame:
    """Companies with a homepage and no careers page, by id."""
    missing = F.col("recruits_url").isNull() | (F.col("recruits_url") == "")
    if none_is_missing:
        missing = missing | (F.lower("recruits_url") == "none")
    df = companies.where(F.col("homepage_url").isNotNull() & missing).orderBy("id")
    return df.limit(limit) if limit else df


def collect_targets(companies: DataFrame, limit: int | None = None) -> DataFrame:
    """Companies whose careers page can be read as text."""
    df = companies.where(
        F.col("recruits_url").isNotNull() & ~(F.col("recruits_url") == "") & F.col("page_type").isin("listing", "one_page", "main") & (F.col("post_type") == "text")
    ).orderBy("id")
    df = df.select("id", "name", "recruits_url", "page_type", "post_type")
    return df.limit(limit) if limit and limit > 0 else df
