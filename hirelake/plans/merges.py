"""Queries over keyed merges, constraints and deletions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake import lexicons as L
from hirelake import schemas
from hirelake.operators import merge
from hirelake.plans import inputs

_SEED = """
SELECT event_id AS line, CASE WHEN event_id % 50 = 0 THEN ' ' ELSE concat(' c', user_id % 400, ' ') END AS company_name,
       CASE event_id % 3 WHEN 0 THEN concat('https://e', event_id) ELSE '' END AS homepage_url, CASE event_id % 4 WHEN 0 THEN concat(' /r', event_id) WHEN 1 THEN NULL ELSE '' END AS recruits_url,
       CASE event_id % 11 WHEN 0 THEN 'listing' ELSE '' END AS page_type, event_type AS post_type, CASE event_id % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' ELSE '' END AS hiring
FROM events
"""
_NOW = "TIMESTAMP_NTZ '2025-01-02 03:04:05'"
_OLD = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
_TARGET = f"""
SELECT id, company_id, title, post_url, salary, location, CASE WHEN id % 10 = 1 THEN 'closed' ELSE 'active' END AS status, {{old}} AS crawled_at, {{old}} AS first_seen_at, is_active
FROM ({inputs.JOBS}) AS j WHERE id % 3 <> 0
"""
_CRAWLED = f"""
SELECT id AS line, CASE WHEN id % 20 = 0 THEN '' ELSE post_url END AS post_url, company_id, CASE id % 4 WHEN 0 THEN concat(' ', title, ' v2 ') WHEN 2 THEN '' ELSE title END AS title,
       CASE WHEN id % 5 = 0 THEN NULL ELSE salary END AS salary, location FROM ({inputs.JOBS}) AS j WHERE id % 2 = 0
"""


def _seed(spark, sf):
    inputs.register(spark, sf, "events")
    return spark.sql(_SEED)


def seed_merge(spark, sf):
    target = inputs.sites(spark, sf).withColumn("hiring", F.col("id") % 2 == 0)
    merged = merge.seed_merge(target, _seed(spark, sf), columns=["homepage_url", "recruits_url", "page_type", "post_type"])
    return merged.select("name", "homepage_url", "recruits_url", "page_type", "post_type", "hiring")


def seed_merge_metrics(spark, sf):
    return merge.merge_metrics(inputs.sites(spark, sf), _seed(spark, sf))


def job_upsert(spark, sf):
    inputs.register(spark, sf, "documents", "labels")
    target, crawled = spark.sql(_TARGET.format(old=_OLD)), spark.sql(_CRAWLED)
    out = merge.job_upsert(target, crawled, F.expr(_NOW), fields={"title": 255, "salary": 255, "location": 255})
    out = merge.with_new_ids(out, target, F.col("_change") == "inserted", "post_url")
    return out.select("id", "company_id", "post_url", "title", "salary", "location", "status", F.date_format("crawled_at", "yyyy-MM-dd").alias("crawled"), F.date_format("first_seen_at", "yyyy-MM-dd").alias("seen"), F.col("_change").alias("change"))


#: Texts around every field's limit.
_LONG = ", ".join(f"repeat('{name[0]}', CAST({limit - 10} + doc_id % 21 AS INT)) AS {name}" for name, limit in L.FIELD_LIMITS.items())


def field_limits(spark, sf):
    """Lengths of the stored fields of postings whose texts are about as long as their limits."""
    inputs.register(spark, sf, "documents")
    crawled = spark.sql(f"SELECT doc_id AS line, concat('u', doc_id) AS post_url, CAST(NULL AS BIGINT) AS company_id, {_LONG} FROM documents")
    out = merge.job_upsert(spark.createDataFrame([], schemas.JOB_POSTINGS), crawled, F.expr(_NOW))
    return out.select("post_url", *[F.length(c).alias(c) for c in L.FIELD_LIMITS])


def trainee_upsert(spark, sf):
    target = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("student_code"), F.col("c_mktsegment").alias("course"), F.col("c_acctbal").alias("value"))
    source = inputs.table(spark, sf, "orders").select(F.col("o_custkey").alias("student_code"), F.col("o_orderpriority").alias("course"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("line"))
    return merge.replace_by_key(target, source, "student_code", "line")


def careers_update(spark, sf):
    updates = inputs.table(spark, sf, "events").select((F.col("user_id") % 400).alias("id"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("page_type"), F.lit("text").alias("post_type"), F.col("event_id").alias("line"))
    return merge.set_values(inputs.sites(spark, sf), updates, "id", ["page_type", "post_type"], "line").select("id", "page_type", "post_type")


def cascade_delete(spark, sf):
    gone = inputs.table(spark, sf, "customer").where("c_nationkey = 3")
    return merge.cascade_delete(inputs.table(spark, sf, "orders"), gone, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def unique_violations(spark, sf):
    return merge.duplicate_keys(inputs.table(spark, sf, "documents"), "text").select("n", F.md5("text").alias("key"))


QUERIES = {f.__name__: f for f in (seed_merge, seed_merge_metrics, job_upsert, field_limits, trainee_upsert, careers_update, cascade_delete, unique_violations)}

_last = lambda c: f"arg_max(trim({c}), line) FILTER (WHERE trim(coalesce({c}, '')) <> '') AS {c}"
_SEED_CTE = f"WITH sites AS ({inputs.SITES}), seed AS ({_SEED})"
SQL = {
    "seed_merge": f"""{_SEED_CTE}, n AS (SELECT trim(company_name) AS key, {_last('homepage_url')}, {_last('recruits_url')}, {_last('page_type')}, {_last('post_type')},
        arg_max(hiring, line) FILTER (WHERE hiring IN ('Y', 'no')) AS flag FROM seed WHERE trim(company_name) <> '' GROUP BY 1)
        SELECT coalesce(s.name, n.key) AS name, coalesce(n.homepage_url, s.homepage_url) AS homepage_url, coalesce(n.recruits_url, s.recruits_url) AS recruits_url, coalesce(n.page_type, s.page_type) AS page_type,
          coalesce(n.post_type, s.post_type) AS post_type, coalesce(n.flag = 'Y', s.id % 2 = 0, false) AS hiring FROM sites s FULL OUTER JOIN n ON s.name = n.key""",
    "seed_merge_metrics": f"""{_SEED_CTE}, k AS (SELECT trim(company_name) AS key, count(*) AS n FROM seed GROUP BY 1), m AS (SELECT k.*, s.name IS NULL AS fresh FROM k LEFT JOIN sites s ON s.name = k.key)
        SELECT CAST(count(*) FILTER (WHERE key <> '' AND fresh) AS BIGINT) AS created, CAST(coalesce(sum(n - CAST(fresh AS INTEGER)) FILTER (WHERE key <> ''), 0) AS BIGINT) AS updated, CAST(coalesce(sum(n) FILTER (WHERE key = ''), 0) AS BIGINT) AS skipped FROM m""",
    "job_upsert": f"""WITH t AS ({_TARGET.format(old="TIMESTAMP '2024-01-01 00:00:00'")}), s AS (SELECT * FROM ({_CRAWLED}) WHERE post_url <> ''),
        m AS (SELECT t.id, coalesce(t.company_id, s.company_id) AS company_id, coalesce(t.post_url, s.post_url) AS post_url, t.title AS t0, t.salary AS s0, t.location AS l0, s.title AS t1, s.salary AS s1, s.location AS l1, t.status, t.post_url IS NOT NULL AS known, s.post_url IS NOT NULL AS given
          FROM t FULL OUTER JOIN s ON t.post_url = s.post_url),
        v AS (SELECT *, known AND given AND trim(coalesce(t1, '')) <> '' AND trim(t1)[1:255] IS DISTINCT FROM t0 AS ct, known AND given AND coalesce(s1, '') <> '' AND s1 IS DISTINCT FROM s0 AS cs, known AND given AND coalesce(l1, '') <> '' AND l1 IS DISTINCT FROM l0 AS cl FROM m),
        w AS (SELECT *, CASE WHEN NOT known THEN 'inserted' WHEN NOT given THEN 'kept' WHEN ct OR cs OR cl OR status <> 'active' THEN 'changed' ELSE 'same' END AS change FROM v),
        x AS (SELECT *, row_number() OVER (PARTITION BY known ORDER BY substr(md5(post_url), 1, 3), post_url) AS fresh FROM w)
        SELECT coalesce(id, (SELECT max(id) FROM t) + fresh) AS id, company_id, post_url, CASE WHEN NOT known THEN t1[1:255] WHEN ct THEN trim(t1)[1:255] ELSE t0 END AS title, CASE WHEN NOT known THEN s1 WHEN cs THEN s1 ELSE s0 END AS salary,
          CASE WHEN NOT known THEN l1 WHEN cl THEN l1 ELSE l0 END AS location, CASE WHEN change IN ('inserted', 'changed') THEN 'active' ELSE status END AS status,
          CASE WHEN change IN ('inserted', 'changed') THEN '2025-01-02' ELSE '2024-01-01' END AS crawled, CASE WHEN change = 'inserted' THEN '2025-01-02' ELSE '2024-01-01' END AS seen, change FROM x""",
    "field_limits": f"SELECT concat('u', doc_id) AS post_url, {', '.join(f'CAST(least({limit - 10} + doc_id % 21, {limit}) AS INTEGER) AS {name}' for name, limit in L.FIELD_LIMITS.items())} FROM documents",
    "trainee_upsert": """WITH s AS (SELECT o_custkey AS student_code, arg_max(o_orderpriority, o_orderkey) AS course, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1)
        SELECT student_code, course, value FROM s UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT student_code FROM s)""",
    "careers_update": f"""{_SEED_CTE}, u AS (SELECT user_id % 400 AS id, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 = 0) AS page_type, 'text' AS post_type FROM events GROUP BY 1)
        SELECT s.id, coalesce(u.page_type, s.page_type) AS page_type, coalesce(u.post_type, s.post_type) AS post_type FROM sites s LEFT JOIN u ON s.id = u.id""",
    "cascade_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "unique_violations": "SELECT count(*) AS n, md5(text) AS key FROM documents GROUP BY text HAVING count(*) > 1",
}
