"""Helpers of the trainee import as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import lexicons as L
from hirelake.functions.text import blank, found_in, strip

REQUIRED_CODES = {"재택": "BENEFIT_재택근무", "식대": "BENEFIT_식대"}


def welfare_list(c: str | Column, items: list[str] = L.BENEFITS) -> Column:
    """Benefits named in a cell (spaces ignored), sorted, comma-joined."""
    return F.array_join(F.array_sort(found_in(F.replace(blank(c), F.lit(" "), F.lit("")), items)), ",")


def required_codes(c: str | Column, codes: dict[str, str] | None = None) -> Column:
    hits = [F.when(blank(c).contains(k), F.lit(v)) for k, v in (codes or REQUIRED_CODES).items()]
    return F.array_join(F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull())), ",")


def to_int(c: str | Column) -> Column:
    s = strip(blank(c))
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))


def gender(c: str | Column) -> Column:
    s = strip(blank(c))
    return F.when(s.startswith("남"), "M").when(s.startswith("여"), "F").otherwise("")


def to_date(c: str | Column) -> Column:
    """A date, from a timestamp or a date; NULL if it is neither."""
    s = strip(blank(c))
    return F.coalesce(F.try_to_timestamp(s).cast("date"), F.to_date(F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))))


TRAINEE_COLUMNS = {
    "학생ID": "student_code", "이름(가명)": "name_alias", "학력": "education_level", "전공": "major", "경력": "career_summary", "과정명": "course_name", "상담내용 요약": "counseling_summary",
    "상담교사": "counselor_name", "비고(위험/특이사항)": "note", "업종분류": "preferred_industry", "구인구분(신입,경력)": "preferred_employment_type", "구인기술": "preferred_job_skill",
    "근무지": "preferred_location", "급여": "preferred_salary", "기술스택": "tech_stack",
}


def trainee_rows(log: DataFrame, line: str = "line") -> DataFrame:
    """Trainee columns of a counselling log as read from CSV; unknown columns are ignored."""
    cell = lambda c: blank(f"`{c}`") if c in log.columns else F.lit("")
    out = {new: strip(cell(old)) for old, new in TRAINEE_COLUMNS.items()}
    out |= {
        "counseling_date": to_date(cell("날짜")), "birth_date": to_date(cell("생년월일")), "gender": gender(cell("성별")), "academy_rank": to_int(cell("학원 성적(등수)")),
        "career_months": to_int(cell("경력기간(M)")), "preferred_company_size": to_int(cell("근무인원")), "welfare_preferences": welfare_list(cell("복리후생")), "required_conditions": required_codes(cell("필수조건")),
    }
    return log.select(*[c.alias(n) for n, c in out.items()], line).where("student_code <> ''")
