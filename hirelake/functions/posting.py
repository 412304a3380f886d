"""Facts of posting texts as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import lexicons as L
from hirelake.functions.text import blank, count_in, first_in, found_in, once, strip

#: Characters that the acceptance test and a plugged-in classifier look at (their feature, not a cap).
ACCEPT_CHARS, CLASSIFIER_CHARS = 3000, 2000


def accept_as_job(text: str | Column, keywords: list[str] = L.ACCEPT_KEYWORDS, classifier=None) -> Column:
    """Whether a text reads as a posting: the classifier says so, or at least two keywords occur."""
    head = F.substring(blank(text), 1, ACCEPT_CHARS)
    by_words = count_in(F.lower(head), keywords) >= 2
    return by_words if classifier is None else F.coalesce(classifier(F.substring(head, 1, CLASSIFIER_CHARS)), F.lit(False)) | by_words


def labeled_block(text: str | Column, labels: list[str], terms: list[str] = L.SECTION_TERMS) -> Column:
    """Text after the first label that occurs, up to the next section term; '' if there is none.

    A label is searched by pattern only in texts that have its letters, in any case.
    """
    stop = "|".join(re.escape(t) for t in terms)
    fold = lambda c: F.lower(F.upper(c))

    def either(later: Column):
        return lambda found: F.when(found != "", strip(found)).otherwise(later)

    def first(x: Column) -> Column:
        out = F.lit("")
        for label in reversed(labels):
            pattern = rf"(?iU){re.escape(label)}\s*[:\-]?\s*(.+?)(?=(?:{stop}|$))"
            got = F.when(x["folded"].contains(fold(F.lit(label))), F.regexp_extract(x["text"], pattern, 1)).otherwise(F.lit(""))
            out = once(got, either(out))
        return out

    t = blank(text)
    return once(F.struct(t.alias("text"), fold(t).alias("folded")), first)


def benefit_list(text: str | Column, items: list[str] = L.BENEFITS) -> Column:
    return F.array_join(F.array_sort(found_in(blank(text), items)), ", ")


def region(text: str | Column, items: list[str] = L.REGIONS) -> Column:
    return first_in(blank(text), items, F.lit(""))


def employment_type(text: str | Column, items: list[str] = L.EMPLOYMENT_TYPES) -> Column:
    return first_in(blank(text), items, F.lit(""))


def salary_phrase(text: str | Column, heads: str = L.PAY_HEADS, units: str = L.PAY_UNITS) -> Column:
    """The first pay phrase as written; '' if there is none."""
    return strip(F.regexp_extract(blank(text), rf"(?U)(?:{heads})[^\d]*(?:{units})", 0))


def posting_facts(text: str | Column) -> dict[str, Column]:
    """The fields that the detail extractor reads from a posting's text."""
    t = blank(text)
    duties = labeled_block(t, L.SECTION_LABELS["job_description"])
    cut = lambda c, n: F.substring(c, 1, n)
    return {
        "job_description": cut(F.coalesce(F.nullif(duties, F.lit("")), t), 20000),
        "qualifications": cut(labeled_block(t, L.SECTION_LABELS["qualifications"]), 2000),
        "preferred_qualifications": cut(labeled_block(t, L.SECTION_LABELS["preferred_qualifications"]), 2000),
        "hiring_process": cut(labeled_block(t, L.SECTION_LABELS["hiring_process"]), 2000),
        "benefits": benefit_list(t),
        "location": region(t),
        "employment_type": employment_type(t),
        "salary": salary_phrase(t),
    }
