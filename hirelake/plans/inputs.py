"""The model's tables as seen in the test tables: one SQL text each, for Spark and the oracle alike.

Postings are documents, companies their sources, candidates the first user turns of conversations,
pages the fetched pages. Korean values that the default rules know come from id arithmetic, so all
rules are met on every table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.text import found_in

JOBS = """
SELECT d.doc_id AS id, try_cast(substr(d.source, 4) AS BIGINT) AS company_id, split_part(d.text, chr(10), 1) AS title,
       concat('https://', d.source, '.example.com/jobs/', d.doc_id) AS post_url, d.text AS job_description, CAST(NULL AS STRING) AS qualifications,
       d.source AS preferred_qualifications,
       CASE d.lang WHEN 'en' THEN '식대, 재택근무' WHEN 'fr' THEN '종합검진/운동비' WHEN 'de' THEN '경조휴무 경조금' ELSE '' END AS benefits,
       CASE d.doc_id % 5 WHEN 0 THEN '서울' WHEN 1 THEN '경기 성남' WHEN 2 THEN '부산' WHEN 3 THEN '대구/서울' ELSE NULL END AS location,
       CASE d.doc_id % 4 WHEN 0 THEN '신입' WHEN 1 THEN '경력 3년' WHEN 2 THEN 'Experienced or New' ELSE '정규직' END AS employment_type,
       CASE WHEN d.doc_id % 7 = 0 THEN '협의' ELSE concat('연봉 ', d.doc_id % 60 * 100 + 1000, '만원') END AS salary,
       coalesce(l.quality, 1) = 1 AS is_active, 'active' AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
COMPANIES = """
SELECT DISTINCT try_cast(substr(source, 4) AS BIGINT) AS id, source AS name,
       CASE try_cast(substr(source, 4) AS BIGINT) % 3 WHEN 0 THEN '플랫폼 ai' WHEN 1 THEN '게임' ELSE NULL END AS industry,
       CASE try_cast(substr(source, 4) AS BIGINT) % 2 WHEN 0 THEN 'Seoul Gangnam' ELSE 'Busan' END AS region
FROM documents
"""
#: Words looked for in candidates' first turns.
SKILLS = ["the", "tion", "ich", "que", "est", "ung", "los", "ment", "and", "sch"]
TURNS = """
SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id
"""
STUDENT_VALUES = {
    "location": "CASE conv_id % 5 WHEN 0 THEN '수도권' WHEN 1 THEN '지방 가능' WHEN 2 THEN '지역 무관' WHEN 3 THEN '서울' ELSE '' END",
    "employment": "CASE conv_id % 4 WHEN 0 THEN '신입' WHEN 1 THEN '신입+경력' WHEN 2 THEN '경력' ELSE NULL END",
    "welfare": "CASE conv_id % 3 WHEN 0 THEN '재택' WHEN 1 THEN '검진' ELSE '식대' END",
    "salary_min": "CASE WHEN conv_id % 6 = 0 THEN NULL ELSE CAST(conv_id % 50 * 100 + 1500 AS DOUBLE) END",
    "industry": "CASE conv_id % 3 WHEN 0 THEN '게임' WHEN 1 THEN 'ai' ELSE '' END",
    "etc": "CASE conv_id % 2 WHEN 0 THEN 'src1' ELSE 'src' END",
    "condition": "CASE conv_id % 9 WHEN 0 THEN '기술스택' WHEN 1 THEN '근무지' WHEN 2 THEN '급여' WHEN 3 THEN '복리후생' WHEN 4 THEN '구인구분' ELSE '' END",
}
SITES = """
SELECT page_id AS id, concat('c', page_id) AS name,
       CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN '' ELSE concat('https://', split_part(split_part(url, '://', 2), '/', 1)) END AS homepage_url,
       CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'none' ELSE url END AS recruits_url,
       CASE page_id % 4 WHEN 0 THEN 'listing' WHEN 1 THEN 'one_page' WHEN 2 THEN 'external' ELSE 'main' END AS page_type,
       CASE page_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'text' END AS post_type
FROM pages
"""


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "documents", "labels")
    return spark.sql(JOBS)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "documents")
    return spark.sql(COMPANIES)


def jobs_with_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = companies(spark, sf_dir).select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), "industry")
    return jobs(spark, sf_dir).join(company, "company_id")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "conversations")
    df = spark.sql(TURNS).withColumns({k: F.expr(v) for k, v in STUDENT_VALUES.items()})
    listed = {c: F.array(c) for c in ("welfare", "etc")} | {"required": F.array("condition"), "skills": found_in(F.lower("text"), SKILLS)}
    return df.withColumns(listed).select(
        F.col("conv_id").alias("student_id"), F.col("conv_id").alias("position"), "skills", "location", "employment", "welfare", "salary_min", "industry", "etc", "required"
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "pages")
    return spark.sql(SITES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
