import numpy as np
from pyspark.sql import functions as F

from hirelake.operators import search
from hirelake.operators.substring import PIECE, SubstringIndex, grams_of

ROWS = "id long, title string, body string"


def test_search_equals_a_scan(spark):
    rng = np.random.default_rng(3)
    letters = list("abAB .%_é한글😀\n")
    texts = [(i, None if i % 11 == 0 else "".join(rng.choice(letters, rng.integers(0, 12))), "".join(rng.choice(letters, rng.integers(0, 30)))) for i in range(400)]
    texts += [(i, "same", "SAME Text") for i in range(400, 600)] + [(600, "", ""), (601, "ab", None), (601, "ab", None)]
    rows = spark.createDataFrame(texts, ROWS).repartition(3)
    fields = ["title", "body"]
    index = SubstringIndex.build(rows, fields)
    needles = ["a", "B", "é", "글", "한글", "😀", "😀a", "ab", "aba", "SAME t", "%_", "\n", "ab" * 4, "nowhere", " ", "", None, "é한글"]
    for q in needles:
        ours = sorted(r.id for r in index.search(q).select("id").collect())
        assert ours == sorted(r.id for r in search.keyword_search(rows, q, fields).select("id").collect()), q
    again = SubstringIndex(spark, index.path, fields)
    assert again.search("same text").count() == 200 and again.search("same").columns == rows.columns
    work = index.work("same text").first()
    assert (work.rows, work.candidates, work.hits) == (603, 200, 200)


def test_grams_of_long_texts_and_ends(spark):
    text = "x" * (PIECE + 1) + "yz"
    assert {tuple((int(g) >> s) & 0x1FFFFF for s in (42, 21, 0)) for g in grams_of(text)} == {tuple(map(ord, g)) for g in ("xxx", "xxy", "xyz", "yz\0", "z\0\0")}
    assert not len(grams_of(""))
    rows = spark.createDataFrame([(1, "t", text), (2, "t", "zy")], ROWS)
    index = SubstringIndex.build(rows, ["body"])
    assert [r.id for r in index.search("XYZ").collect()] == [1] and [r.id for r in index.search("zY").collect()] == [2]


def test_empty_table_and_pruned_plan(spark):
    assert SubstringIndex.build(spark.createDataFrame([], ROWS), ["body"]).search("abc").count() == 0
    rows = spark.range(4000).repartition(8).select("id", F.lit("t").alias("title"), F.concat(F.lit("row "), F.col("id")).alias("body"))
    index = SubstringIndex.build(rows, ["body"])
    found = index.search("row 3999")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in found.collect()] == [3999]
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan
    work = index.work("3999").first()
    assert work.candidates < 20


def test_page_of_the_list_over_an_index(spark):
    jobs = spark.range(300).select("id", (F.col("id") % 7).alias("company_id"), F.concat(F.lit("Job "), F.col("id")).alias("title"), *[F.lit("x").alias(c) for c in search.SEARCH_FIELDS[1:]], (F.col("id") % 3 > 0).alias("is_active"))
    companies = spark.range(7).select("id", F.concat(F.lit("c"), F.col("id")).alias("name"), F.lit("r").alias("region"))
    index = SubstringIndex.build(jobs)
    ours = search.search_jobs(index.search("job 2"), companies, "1", company="C3", number=1, size=5).collect()
    assert ours == search.search_jobs(jobs, companies, "1", "job 2", "C3", number=1, size=5).collect() and len(ours) == 5
