"""Facts of counselling notes as Column expressions; each rule takes its lists as parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import lexicons as L
from hirelake.functions.text import any_in, blank, clean_html, col, found_in, salary_floor500, strip


@dataclass(frozen=True)
class Rules:
    """Lists of the extractor. ``everywhere`` .. ``province`` are the four location outcomes."""

    people: str = r"(?U)(\d{1,5})\s*(?:명|인)"
    industries: list = field(default_factory=lambda: L.INDUSTRIES)
    experienced: str = "경력"
    career: tuple[str, str] = ("신입+경력", "신입")
    everywhere: list = field(default_factory=lambda: ["지역 무관", "전국", "리모트", "원격"])
    elsewhere: list = field(default_factory=lambda: ["지방 가능"])
    metro: list = field(default_factory=lambda: L.METRO_NAMES)
    province: list = field(default_factory=lambda: L.PROVINCE_NAMES)
    places: tuple[str, str, str] = ("지역 무관", "지방 가능", "수도권")
    tech: list = field(default_factory=lambda: L.TECH)
    tech_upper: list = field(default_factory=lambda: L.TECH_UPPER)
    benefits: list = field(default_factory=lambda: L.BENEFITS)
    synonyms: dict = field(default_factory=lambda: L.BENEFIT_SYNONYMS)
    triggers: list = field(default_factory=lambda: L.STRONG_TRIGGERS)
    required_place: list = field(default_factory=lambda: L.REQUIRED_PLACE)
    required_pay: list = field(default_factory=lambda: L.REQUIRED_PAY)
    required_limits: list = field(default_factory=lambda: L.REQUIRED_PAY_LIMITS)
    required_welfare: list = field(default_factory=lambda: L.REQUIRED_WELFARE)
    required_career: list = field(default_factory=lambda: L.REQUIRED_CAREER)
    names: tuple = ("근무지", "급여", "복리후생", "구인구분", "기술스택", "구인기술", "근무인원", "업종분류")


DEFAULT = Rules()


def headcount(text: Column, rules: Rules = DEFAULT) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(rules.people), F.lit(1)), lambda x: F.translate(x, "０１２３４５６７８９", "0123456789").try_cast("int")))


def industry(text: Column, rules: Rules = DEFAULT) -> Column:
    low, out = F.lower(text), None
    for label, keys in rules.industries:
        out = F.when(any_in(low, keys), label) if out is None else out.when(any_in(low, keys), label)
    return out


def career(text: Column, rules: Rules = DEFAULT) -> Column:
    return F.when(text.contains(rules.experienced), rules.career[0]).otherwise(rules.career[1])


def place(text: Column, rules: Rules = DEFAULT) -> Column:
    everywhere, elsewhere, metro = rules.places
    return F.when(any_in(text, rules.everywhere), everywhere).when(any_in(text, rules.elsewhere), elsewhere).when(any_in(text, rules.metro), metro).when(any_in(text, rules.province), elsewhere)


def stack(text: Column, rules: Rules = DEFAULT) -> Column:
    """Up to 15 technologies, in lexicon order."""
    low = F.lower(text)
    shown = lambda x: F.when(x.isin(rules.tech_upper), F.upper(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 100))))
    return F.slice(F.array_distinct(F.transform(found_in(low, rules.tech), shown)), 1, 15)


def benefits(text: Column, rules: Rules = DEFAULT) -> Column:
    """Benefits named or implied, in canonical order."""
    low = F.lower(text)
    has = lambda b: any_in(low, [k for k, v in rules.synonyms.items() if v == b]) | text.contains(b)
    return F.filter(F.array(*[F.when(has(b), F.lit(b)) for b in rules.benefits]), lambda x: x.isNotNull())


def required(text: Column, rules: Rules = DEFAULT) -> Column:
    """Conditions that sentences with a strong trigger give evidence for, in order of appearance."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.?!])|[。？！]|[\n\r]"), strip), lambda s: (s != "") & any_in(s, rules.triggers))

    def evidence(s: Column) -> Column:
        place_, pay, welfare, career_, stack_, skill, people, industry_ = rules.names
        many = F.size(stack(s, rules)) >= 2
        tests = [
            (any_in(s, rules.required_place), place_),
            (any_in(s, rules.required_pay) & (s.rlike(r"(?U)\d") | any_in(s, rules.required_limits)), pay),
            (any_in(s, rules.required_welfare) | (F.size(benefits(s, rules)) > 0), welfare),
            (any_in(s, rules.required_career), career_),
            (many, stack_),
            (many, skill),
            (headcount(s, rules).isNotNull(), people),
            (industry(s, rules).isNotNull(), industry_),
        ]
        return F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in tests]), lambda x: x.isNotNull())

    return F.array_distinct(F.flatten(F.transform(sentences, evidence)))


FIELDS = ("근무인원", "업종분류", "구인구분", "구인기술", "근무지", "급여", "기술스택", "복리후생", "필수조건")


def extract_facts(
    df: DataFrame, text: str = "text", only_fields: list[str] | None = None, rules: Rules = DEFAULT, names: tuple[str, ...] = FIELDS, corrector: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``df`` with the nine facts of its text; NULL text reads as empty.

    ``only_fields`` keeps the named ones (unknown names are ignored; none means all).
    ``corrector`` is an optional model hook: Column -> struct<place, career>, whose place fills a
    missing one and whose career overrides.
    """
    clean = "_clean"
    df = df.withColumn(clean, clean_html(blank(text)))
    t = col(clean)
    found_place, found_career = place(t, rules), career(t, rules)
    if corrector is not None:
        better = corrector(t)
        found_place, found_career = F.coalesce(found_place, better["place"]), F.coalesce(better["career"], found_career)
    known = stack(t, rules)
    values = [
        headcount(t, rules), industry(t, rules), found_career, F.when(F.size(known) > 0, F.array_join(F.slice(known, 1, 5), ", ")), found_place,
        salary_floor500(t).cast("int"), known, benefits(t, rules), required(t, rules),
    ]
    keep = [n for n in names if n in only_fields] if only_fields and set(only_fields) & set(names) else [] if only_fields else list(names)
    return df.withColumns({n: v for n, v in zip(names, values, strict=True) if n in keep}).drop(clean)
