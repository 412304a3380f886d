"""Queries over postings and companies: filters, joins through the key, sorting, paging, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import search
from hirelake.operators.substring import SubstringIndex
from hirelake.plans import inputs
from hirelake.plans import sqltext as S
from hirelake.sources.sinks import export_rows

_Q, _COMPANY, _REGION = "TION", "Src1", "seoul"
_WITH = f"WITH jobs AS ({inputs.JOBS}), companies AS ({inputs.COMPANIES}), sites AS ({inputs.SITES})"
_FIELDS = " OR ".join(f"coalesce(contains(lower({c}), lower('{_Q}')), false)" for c in search.SEARCH_FIELDS)


def jobs_search_page(spark, sf):
    """Active postings with a keyword, of companies with a name and region, newest first, second page."""
    rows = search.search_jobs(inputs.jobs(spark, sf), inputs.companies(spark, sf), "1", _Q, _COMPANY, _REGION, number=2, size=5)
    return rows.select("id", "title", "company_id", "company_name", "company_region")


def jobs_search_envelope(spark, sf):
    rows = search.keyword_search(search.active_filter(inputs.jobs(spark, sf), "true"), _Q)
    return search.page_envelope(rows, 2, 20).select("count", "has_next", "has_previous")


def jobs_search_results(spark, sf):
    """The whole answer of the list: count, links and rows of the second page."""
    rows = search.keyword_search(search.active_filter(inputs.jobs(spark, sf), "true"), _Q)
    got = search.page_envelope(rows, 2, 10, results=["id", "company_id", "location"])
    return got.select("count", "next", "previous", F.to_json("results", {"ignoreNullFields": "false"}).alias("results"))


def jobs_page_after(spark, sf):
    """The third page, reached by the keys in the links of the pages before."""
    rows = search.keyword_search(search.active_filter(inputs.jobs(spark, sf), "true"), _Q).select("id", "company_id", "location")
    last = None
    for _ in range(2):  # as a reader of the pages would
        last = int(search.page_after_envelope(rows, last, 10).first()["next"].split("=")[1].split("&")[0])
    got = search.page_after_envelope(rows, last, 10)
    return got.select("next", F.to_json("results", {"ignoreNullFields": "false"}).alias("results"))


def jobs_active_filter(spark, sf):
    return search.active_filter(inputs.jobs(spark, sf), "no").select("id", "company_id")


def jobs_keyword(spark, sf):
    return search.keyword_search(inputs.jobs(spark, sf), "Of The ", ["job_description"]).select("id")


#: Needles of one, two and more characters, of other scripts, with signs and without a row.
_NEEDLES = ["Of The ", "TION", "é", "ß", "ÑÑ!", "q", ".\n", "%_", "ungen auf", "없음"]


def jobs_keyword_indexed(spark, sf):
    """Postings that hold each of several needles in one of two fields, by one index of grams."""
    index = SubstringIndex.build(inputs.jobs(spark, sf).select("id", "title", "job_description", "preferred_qualifications"), ["job_description", "preferred_qualifications"])
    found = [index.search(q).select(F.lit(i).alias("needle"), "id") for i, q in enumerate(_NEEDLES)]
    return reduce(DataFrame.unionByName, found)


def orders_company_contains(spark, sf):
    """A filter through the key: orders of customers whose name contains a text."""
    customers = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    joined = search.with_company(inputs.table(spark, sf, "orders"), customers, "o_custkey")
    return joined.where(search.icontains("company_name", "#0000001")).select("o_orderkey", "company_name")


def suppliers_region_contains(spark, sf):
    nations = inputs.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("region"))
    joined = search.with_company(inputs.table(spark, sf, "supplier"), nations, "s_nationkey")
    return joined.where(search.icontains("company_region", "Nation_1")).select("s_suppkey", "company_region")


def admin_facets(spark, sf):
    jobs = inputs.table(spark, sf, "orders")
    return search.facet(jobs, "o_orderstatus").withColumnRenamed("o_orderstatus", "facet").unionByName(search.facet(jobs, "o_orderpriority").withColumnRenamed("o_orderpriority", "facet"))


def admin_search(spark, sf):
    """The admin search: a text in the title, the URL or the company's name."""
    rows = search.with_company(inputs.jobs(spark, sf), inputs.companies(spark, sf))
    return search.keyword_search(rows, "RC1", ["title", "post_url", "company_name"]).select("id", "company_name")


def in_list_filter(spark, sf):
    return search.in_list(inputs.table(spark, sf, "customer"), "c_nationkey", [1, 5, 9]).select("c_custkey", "c_nationkey")


def point_lookup(spark, sf):
    return inputs.table(spark, sf, "orders").where(F.col("o_orderkey") == 7).select("o_orderkey", "o_custkey", "o_orderstatus").limit(1)


def missing_homepages(spark, sf):
    return search.missing_homepages(inputs.sites(spark, sf)).select("id", "name")


def discover_targets(spark, sf):
    return search.discover_targets(inputs.sites(spark, sf)).select("id", "homepage_url")


def collect_targets(spark, sf):
    return search.collect_targets(inputs.sites(spark, sf))


def export_companies(spark, sf):
    return export_rows(inputs.sites(spark, sf))


QUERIES = {f.__name__: f for f in (jobs_search_page, jobs_search_envelope, jobs_search_results, jobs_page_after, jobs_active_filter, jobs_keyword, jobs_keyword_indexed, orders_company_contains, suppliers_region_contains, admin_facets, admin_search, in_list_filter, point_lookup, missing_homepages, discover_targets, collect_targets, export_companies)}

SQL = {
    "jobs_search_page": f"""{_WITH} SELECT j.id, j.title, j.company_id, c.name AS company_name, c.region AS company_region FROM jobs j JOIN companies c ON j.company_id = c.id
        WHERE j.is_active AND ({_FIELDS}) AND contains(lower(c.name), lower('{_COMPANY}')) AND contains(lower(c.region), lower('{_REGION}')) ORDER BY j.id DESC LIMIT 5 OFFSET 5""",
    "jobs_search_envelope": f"{_WITH} SELECT count(*) AS count, count(*) > 40 AS has_next, true AS has_previous FROM jobs WHERE is_active AND ({_FIELDS})",
    "jobs_search_results": f"""{_WITH}, found AS (SELECT id, company_id, location FROM jobs WHERE is_active AND ({_FIELDS})), p AS (SELECT * FROM found ORDER BY id DESC LIMIT 10 OFFSET 10)
        SELECT (SELECT count(*) FROM found) AS count, CASE WHEN (SELECT count(*) FROM found) > 20 THEN '?page=3&page_size=10' END AS next, '?page=1&page_size=10' AS previous, CAST(to_json(list(p ORDER BY id DESC)) AS VARCHAR) AS results FROM p""",
    "jobs_page_after": f"""{_WITH}, found AS (SELECT id, company_id, location FROM jobs WHERE is_active AND ({_FIELDS})), p AS (SELECT * FROM found ORDER BY id DESC LIMIT 10 OFFSET 20)
        SELECT CASE WHEN (SELECT count(*) FROM found) > 30 THEN '?after=' || min(id) || '&page_size=10' END AS next, CAST(to_json(list(p ORDER BY id DESC)) AS VARCHAR) AS results FROM p""",
    "jobs_active_filter": f"{_WITH} SELECT id, company_id FROM jobs WHERE NOT is_active",
    "jobs_keyword": "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'of the ')",
    "jobs_keyword_indexed": " UNION ALL ".join(
        f"SELECT {i} AS needle, doc_id AS id FROM documents WHERE contains(lower(text), lower({S.text(q)})) OR coalesce(contains(lower(source), lower({S.text(q)})), false)" for i, q in enumerate(_NEEDLES)
    ),
    "orders_company_contains": "SELECT o_orderkey, c_name AS company_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '#0000001')",
    "suppliers_region_contains": "SELECT s_suppkey, n_name AS company_region FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_1')",
    "admin_facets": "SELECT o_orderstatus AS facet, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1",
    "admin_search": f"{_WITH} SELECT j.id, c.name AS company_name FROM jobs j JOIN companies c ON j.company_id = c.id WHERE contains(lower(j.title), 'rc1') OR contains(lower(j.post_url), 'rc1') OR contains(lower(c.name), 'rc1')",
    "in_list_filter": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 5, 9)",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "missing_homepages": f"{_WITH} SELECT id, name FROM sites WHERE homepage_url IS NULL",
    "discover_targets": f"{_WITH} SELECT id, homepage_url FROM sites WHERE homepage_url IS NOT NULL AND (recruits_url IS NULL OR recruits_url = '')",
    "collect_targets": f"{_WITH} SELECT id, name, recruits_url, page_type, post_type FROM sites WHERE recruits_url IS NOT NULL AND recruits_url <> '' AND page_type IN ('listing', 'one_page', 'main') AND post_type = 'text'",
    "export_companies": f"{_WITH} SELECT coalesce(name, '') AS name, coalesce(homepage_url, '') AS homepage_url, coalesce(recruits_url, '') AS recruits_url FROM sites",
}
