"""Supplied models as Column functions: off unless given, loaded once per Python worker.

A model is a callable over lists: (texts, labels) -> [(best label, its score)] in the order of the
texts, with (None, 0.0) where it has no answer. It is made by ``load`` in the worker that uses it, the first
time there, and kept under its name; texts reach it in Arrow batches. Nothing is downloaded here, and an
error of the model fails the query instead of leaving its work undone unseen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES, CAREERS = ["수도권", "지방 가능", "지역 무관"], ["신입", "신입+경력"]
POSTING, THRESHOLD, CHARS = ["채용공고", "채용공고 아님"], 0.65, 2000

Model = Callable[[list[str], list[str]], list[tuple[str | None, float]]]
_loaded: dict[str, Model] = {}


def best_label(name: str, load: Callable[[], Model], labels: list[str], threshold: float = 0.0, batch: int = 256) -> Callable[[Column], Column]:
    """Column of texts -> the label that the model puts first, if it is one of ``labels`` and its score
    reaches the threshold; else NULL. Null and empty texts are not shown to the model."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _loaded:
            _loaded[name] = load()
        for texts in batches:
            rows = texts.to_pylist()
            out: list[str | None] = [None] * len(rows)
            asked = [i for i, t in enumerate(rows) if t]
            for low in range(0, len(asked), batch):
                part = asked[low : low + batch]
                for i, (label, score) in zip(part, _loaded[name]([rows[i] for i in part], labels), strict=True):
                    out[i] = label if label in labels and score >= threshold else None
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def fact_corrector(name: str, load: Callable[[], Model], places: list[str] = PLACES, careers: list[str] = CAREERS) -> Callable[[Column], Column]:
    """For :func:`hirelake.functions.extract.extract_facts`: the model's place and career of a whole text."""
    place, career = best_label(name, load, places), best_label(name, load, careers)
    return lambda text: F.struct(place(text).alias("place"), career(text).alias("career"))


def posting_classifier(name: str, load: Callable[[], Model], labels: list[str] = POSTING, threshold: float = THRESHOLD, chars: int = CHARS) -> Callable[[Column], Column]:
    """For :func:`hirelake.functions.posting.accept_as_job`: whether the model puts the first label first,
    with enough confidence, on the text's first ``chars`` characters (the model's input)."""
    label = best_label(name, load, labels, threshold)
    return lambda text: F.coalesce(label(F.substring(text, 1, chars)) == labels[0], F.lit(False))
