"""Hand-derived expectations of the text rules."""

import pytest
from pyspark.sql import functions as F

from hirelake.functions import extract, posting, urls
from hirelake.functions import text as T
from hirelake.operators import imports


def value(spark, column, **cells):
    types = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], types).select(column.alias("v")).first().v


@pytest.mark.parametrize("text,want", [("1억 2,300만", 10000), ("연봉 3,700 이상", 3500), ("협의", None), ("３７００ 이상", 3500), (None, None)])
def test_salary_floor(spark, text, want):
    assert value(spark, T.salary_floor500("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("3,700만원", 3700), ("4,000~5,200", 4000), ("1.2억", None), ("협의", None), ("1,2", 12), (None, None)])
def test_salary_min(spark, text, want):
    assert value(spark, T.salary_min("t"), t=text) == want


def test_tokens(spark):
    assert sorted(value(spark, T.token_set("t"), t="Python/Django, React|SQL python")) == ["django", "python", "react", "sql"]
    assert value(spark, T.token_set("t"), t=None) == [] and value(spark, T.token_set("t"), t=" \t") == []
    assert value(spark, T.token_set_of_list("t"), t=["C++ dev", " ", None]) == ["c++ dev", "none"]


def test_welfare(spark):
    got = value(spark, T.welfare_set(T.token_set("t")), t="원격재택, 종합검진 경조휴무 경조금 자율출퇴근 교내육성비")
    assert set(got) == {"재택근무", "건강검진", "경조휴가", "경조사비", "자율출퇴근제", "교육비"}


def test_flag(spark):
    assert [value(spark, T.flag("t"), t=x) for x in (" Y ", "no", "maybe", "", None)] == [True, False, None, None, None]


def test_counselling_note(spark):
    note = "<p>서울 근무 희망&nbsp;(꼭 판교 지역이어야 합니다).</p> Python, Django, React 공부. 연봉 3,700 이상 희망. 재택, 건강 검진, 자율 근무제 좋아요"
    df = extract.extract_facts(spark.createDataFrame([(note,)], "text string"))
    r = df.first()
    assert (r["근무인원"], r["업종분류"], r["구인구분"], r["근무지"], r["급여"]) == (None, None, "신입", "수도권", 3500)
    assert r["기술스택"] == ["Python", "Django", "React", "Go"] and r["구인기술"] == "Python, Django, React, Go"
    assert r["복리후생"] == ["재택근무", "건강검진", "자율출퇴근제"] and r["필수조건"] == ["근무지"]
    some = extract.extract_facts(spark.createDataFrame([(note,)], "text string"), only_fields=["급여", "x"])
    assert some.columns == ["text", "급여"]


def test_required_conditions(spark):
    text = "급여는 반드시 최소 4,000만원. 신입 가능. Python Django 필수! 인원 12명 필히"
    got = value(spark, extract.required(F.col("t")), t=text)
    assert got == ["급여", "기술스택", "구인기술", "근무인원"]
    assert value(spark, extract.required(F.col("t")), t="재택 원함") == []


def test_model_hook_fills_and_overrides(spark):
    hook = lambda t: F.struct(F.lit("부산").alias("place"), F.lit("신입+경력").alias("career"))
    r = extract.extract_facts(spark.createDataFrame([("아무 말",)], "text string"), corrector=hook).first()
    assert r["근무지"] == "부산" and r["구인구분"] == "신입+경력"


def test_posting_rules(spark):
    assert value(spark, posting.labeled_block("t", ["자격 요건"]), t="자격 요건: 3년 Python 우대 사항 Django") == "3년 Python"
    assert [value(spark, posting.accept_as_job("t"), t=x) for x in ("입사지원", "채용", "jobs and recruit", None)] == [True, False, True, False]
    assert [value(spark, posting.salary_phrase("t"), t=x) for x in ("급여 3,700만원 별도", "연봉 협의", "x")] == ["급여 3,700만원", "연봉 협의", ""]
    assert value(spark, posting.benefit_list("t"), t="재택근무, 식대") == "식대, 재택근무"
    assert value(spark, posting.accept_as_job("t", classifier=lambda c: c.contains("zz")), t="zz") is True


def test_urls(spark):
    pairs = [("www.a.co.kr", "b.co.kr", True), ("a.com", "a.net", False), ("jobs.a.com:80", "a.com", True), ("", "a.com", False), ("host", "host", True)]
    assert [value(spark, urls.same_org("a", "b"), a=a, b=b) for a, b, _ in pairs] == [w for _, _, w in pairs]
    loose = ["//X.co.kr/p", "www.naver.com", "x.io", " ", None, "http://h.kr/a?b"]
    assert [value(spark, urls.normalize_url("t"), t=x) for x in loose] == ["https://X.co.kr", None, "https://x.io", None, None, "http://h.kr"]
    base = "https://h.kr/a/b?q=1#f"
    hrefs = {"c": "https://h.kr/a/c", "/c": "https://h.kr/c", "//x.y/z": "https://x.y/z", "?p=2": "https://h.kr/a/b?p=2", "#k": "https://h.kr/a/b?q=1#k", "http://q/": "http://q/", "../c": "https://h.kr/c", "./d": "https://h.kr/a/d"}
    assert {h: value(spark, urls.join_url("b", "h"), b=base, h=h) for h in hrefs} == hrefs
    assert [value(spark, urls.parent_path("t"), t="https://h" + p) for p in ("/a/b/c", "/a/b", "/a", "")] == ["/a", "", "", ""]
    assert value(spark, urls.redirect_target("t"), t="/l/?x=1&uddg=https%3A%2F%2Fa.kr%2F") == "https://a.kr/"


def test_import_helpers(spark):
    assert [value(spark, imports.gender("t"), t=x) for x in ("여자", " 남", "x", None)] == ["F", "M", "", ""]
    assert [value(spark, imports.to_int("t"), t=x) for x in (" 12 ", "12a", "", None)] == [12, None, None, None]
    assert value(spark, imports.required_codes("t"), t="재택 및 식대") == "BENEFIT_식대,BENEFIT_재택근무"
    assert value(spark, imports.welfare_list("t"), t="재택 근무, 식 대") == "식대,재택근무"
    assert [str(value(spark, imports.to_date("t"), t=x)) for x in ("2024-05-06", "2024-05-06 07:08:09", "soon")] == ["2024-05-06", "2024-05-06", "None"]


def test_lexicon_hits_are_those_of_contains(spark):
    import random

    from hirelake.functions.lexicon import Lexicon, lexicon_hits, masks
    from hirelake.functions.text import found_in, token_set

    rng = random.Random(3)
    words = ["he", "she", "her", "hers", "us", "", "한국", "국어", "e h", "she"[:2], *["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)]]
    words = list(dict.fromkeys(words))
    texts = [None, "", "ushers", "한국어 한국", "the hers", *["".join(rng.choices("abc ", k=rng.randint(0, 80))) for _ in range(80)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = lexicon_hits(df.withColumn("slow", found_in(F.col("t"), words)), {"hits": "t"}, words).collect()
    assert [r.hits for r in rows] == [r.slow or [] for r in rows] and any(len(r.hits) > 9 for r in rows)
    assert lexicon_hits(df, {"hits": "t"}, []).where("size(hits) > 0").count() == 0
    odd = "a,b/c|d\te\u3000f\x1cg  h"
    tokens = df.limit(1).select(token_set(F.lit(odd)).alias("x")).first().x
    lexicon = Lexicon([*tokens, "zz"])
    assert lexicon.among_tokens(odd, None) == list(range(len(tokens)))
    assert [m.to_pylist() for m in masks([[0, 2, 5], []], 2, 2)] == [[0b11, 0], [0b01, 0]]


def test_supplied_models_are_loaded_once_and_asked_in_batches(spark, tmp_path):
    """A model that notes its loads and what it is asked, against a plain loop."""
    from hirelake.functions import model

    def load():
        (tmp_path / "loads").open("a").write("x")

        def ask(texts, labels):
            (tmp_path / "asked").open("a").write(f"{len(texts)} ")
            return [(labels[len(t) % len(labels)] if "z" not in t else "other", len(t) / 10) for t in texts]

        return ask

    texts = [None, "", "a", "bb", "ccc", "zz", "x" * 30, *["t" * i for i in range(1, 20)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    label = model.best_label("noted", load, ["p", "q"], threshold=0.3, batch=5)
    rows = df.select("i", label(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [None if not t or "z" in t or len(t) < 3 else ["p", "q"][len(t) % 2] for t in texts]
    df.select(label(F.col("t")).alias("l")).collect()
    asked = [int(n) for n in (tmp_path / "asked").read_text().split()]
    assert max(asked) == 5 and sum(asked) == 2 * sum(bool(t) for t in texts)
    assert len((tmp_path / "loads").read_text()) <= 4  # workers of this session, not batches
    facts = extract.extract_facts(df.select(F.col("t").alias("text")), corrector=model.fact_corrector("noted", load)).collect()
    assert {r["구인구분"] for r in facts if r.text and "z" not in r.text} == {"신입", "신입+경력"}
    accepted = posting.accept_as_job("t", classifier=model.posting_classifier("noted", load, chars=8))
    assert [r.a for r in df.select("i", accepted.alias("a")).orderBy("i").collect()] == [bool(t) and "z" not in t and len(t[:8]) >= 7 and len(t[:8]) % 2 == 0 for t in texts]


def test_pages_by_key_are_those_by_number(spark):
    from hirelake.operators import search

    df = spark.range(47).select((F.col("id") * 3).alias("id"), (F.col("id") % 5).alias("v")).unionByName(spark.createDataFrame([(None, 1)], "id long, v long"))
    known, last = df.where("id IS NOT NULL"), None
    for number in range(1, 7):
        want = [r.id for r in search.page(known, number, 10).collect()]
        got = search.page_after_envelope(df, last, 10).first()
        assert [r.id for r in search.page_after(df, last, 10).collect()] == [r.id for r in got.results] == want
        assert got.next == (f"?after={want[-1]}&page_size=10" if number < 5 else None)
        last = want[-1] if want else last
    assert search.page_after(df, 0).count() == 0 and search.page_after_envelope(df, 0).first().results == []
