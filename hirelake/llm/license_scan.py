"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and documents are read as lower-cased words. Runs of ``GRAM`` words are hashed, and the
least hash of every ``WINDOW`` neighbouring runs is a fingerprint, so any shared passage of
GRAM + WINDOW - 1 words has one. The templates' fingerprints are an inverted index (a few thousand
entries: templates are a parameter). A template of fewer than SHORT words need not share such a
passage with its match, so it is also indexed by single words: by its longest ones, so many that a
match that is long enough has one of them. A document's hits are put together by template and diagonal,
and around each group a banded alignment finds the most template words that the document has in
order. Groups that do not reach ``min_coverage`` alone are aligned together, so that a notice with a
clause left out or put in is found whole; matches from ``min_coverage`` on are reported with their
spans in code points.

A map-only scan: documents are read whole, once, and never shuffled.

A match of a template of SHORT words or more is found if it shares GRAM + WINDOW - 1 words in a row
with it; a match of a shorter one if its words stay within BAND words of their places.

Defined cases: null and empty texts match nothing; a very long text is read whole, in windows; a
notice that occurs several times gives a row each, and so do several templates that a passage fits;
repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import table
from hirelake.llm.license_texts import NOTICES
from hirelake.llm.wordhash import U, mix, not_word, word_hashes

GRAM, WINDOW = 3, 3
#: Templates of fewer words are also looked up by single words.
SHORT = 15
#: Words that an alignment may drift from its diagonal; share of a template's words to report.
BAND, MIN_COVERAGE = 8, 0.8
#: Words that gaps and insertions of one notice may add up to: as many as the template has, or these.
LEAST_REACH = 32
BATCH_BYTES = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(np.frombuffer(data.translate(_LOWER), np.uint8), not_word())


def _grams(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hash of the run that starts at each word; the largest value where the text ends before."""
    n = len(words)
    total = np.zeros(n, U)
    for k in range(GRAM):
        total[: n - k] += mix(words[k:] + U(k + 1))
    total = mix(total) >> U(1)
    ends = np.ones(n, bool)
    ends[: max(0, n - GRAM + 1)] = owner[GRAM - 1 :] != owner[: max(0, n - GRAM + 1)]
    total[ends] = U(0xFFFFFFFFFFFFFFFF)
    return total


def winnow(grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the last least run of each window inside a text."""
    n = len(grams)
    picked = np.zeros(n, bool)
    whole = grams != U(0xFFFFFFFFFFFFFFFF)
    for start in range(WINDOW):  # a place is picked if it is the last least run of some window
        low = np.full(n, True)
        for k in range(WINDOW):
            shift = k - start
            other = np.full(n, U(0xFFFFFFFFFFFFFFFF))
            same = np.zeros(n, bool)
            if shift >= 0:
                other[: n - shift] = grams[shift:]
                same[: n - shift] = owner[shift:] == owner[: n - shift]
            else:
                other[-shift:] = grams[:shift]
                same[-shift:] = owner[:shift] == owner[-shift:]
            other[~same] = U(0xFFFFFFFFFFFFFFFF)
            low &= (grams < other) | ((grams == other) & (shift <= 0))
        picked |= low
    return np.flatnonzero(picked & whole)


class Templates:
    """Word hashes of the templates, the inverted index of their fingerprints and of short ones' words."""

    def __init__(self, texts: dict[str, str], min_coverage: float = MIN_COVERAGE):
        self.names = sorted(texts)
        found = [_words(texts[n].encode()) for n in self.names]
        self.words = [words for _, words in found]
        index = defaultdict(list)
        self.anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            owner = np.zeros(len(words), np.int64)
            grams = _grams(words, owner)
            for place in range(max(0, len(words) - GRAM + 1)):  # all runs: a document's choice may differ at its edges
                index[int(grams[place])].append((t, place))
            if 0 < len(words) < SHORT:
                longest = sorted(range(len(words)), key=lambda i: (-len(self._word(texts, t, i)), i))
                for place in longest[: len(words) - least_words(len(words), min_coverage) + 1]:
                    self.anchors[int(words[place])].append((t, place))
        self.index = dict(index)
        self.keys = np.sort(np.fromiter(self.index, U, len(self.index)))
        self.short = np.sort(np.fromiter(self.anchors, U, len(self.anchors)))

    def _word(self, texts: dict[str, str], t: int, i: int) -> bytes:
        data = texts[self.names[t]].encode()
        start = int(_words(data)[0][i])
        end = start
        while end < len(data) and not not_word()[data[end]]:
            end += 1
        return data[start:end]


def least_words(words: int, min_coverage: float) -> int:
    """Matched words that a template of so many words needs to be reported."""
    return max(1, math.ceil(min_coverage * words - 1e-9))


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int] | None:
    """(matched words, first, last word of the match in the document) of the best chain near a diagonal.

    Longest common subsequence of the template and words[diagonal-band ...], limited to the band;
    of equally long ones the one that ends first, traced back from its end to the latest start.
    """
    width = 2 * band + 1
    score = np.zeros((len(template) + 1, width + 2), np.int32)
    begin = np.full((len(template) + 1, width + 2), -1, np.int64)
    best = (0, -1, -1)
    for i, word in enumerate(template):
        row, first = score[i + 1], begin[i + 1]
        for j in range(1, width + 1):
            at = i + diagonal + j - 1 - band
            up, left, cross = score[i, j + 1], row[j - 1], score[i, j]
            value, start = (up, begin[i, j + 1]) if up > left or (up == left and begin[i, j + 1] >= first[j - 1]) else (left, first[j - 1])
            if 0 <= at < len(words) and words[at] == word and cross + 1 >= value:
                begun = begin[i, j] if cross else at
                if cross + 1 > value or begun > start:
                    value, start = cross + 1, begun
                if value > best[0]:
                    best = (int(value), int(start), at)
            row[j], first[j] = value, start
    return best if best[0] else None


def scan(data: bytes, templates: Templates, starts: np.ndarray, words: np.ndarray, places: np.ndarray, min_coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(template, matched, template words, first word, last word) of one text whose hits are at ``places``."""
    grams = _grams(words, np.zeros(len(words), np.int64))
    diagonals = defaultdict(list)
    for place in places:
        for t, at in templates.index.get(int(grams[place]), ()):
            diagonals[t].append(place - at)
    for i in np.flatnonzero(np.isin(words, templates.short)):
        for t, at in templates.anchors[int(words[i])]:
            diagonals[t].append(int(i) - at)
    out = []
    for t, found in diagonals.items():
        found.sort()
        template = templates.words[t]
        least = least_words(len(template), min_coverage)

        def enough(low: int, high: int, template: np.ndarray = template, least: int = least) -> bool:
            """Whether the words around these diagonals can make a match at all."""
            return int(np.isin(template, words[max(0, low - BAND) : max(0, high + BAND + len(template))]).sum()) >= least

        group, apart = [found[0]], []
        for d in [*found[1:], None]:
            if d is not None and d - group[-1] <= BAND and d - group[0] <= 2 * BAND:
                group.append(d)
                continue
            middle = group[len(group) // 2]
            got = align(template, words, middle) if enough(middle, middle) else None
            if got and got[0] >= least:
                out.append((t, got[0], len(template), got[1], got[2]))
            else:
                apart.append((group[0], group[-1]))
            group = [d]
        i = 0
        while i < len(apart):  # parts of one notice around gaps and insertions: one band over all their diagonals
            j, reach = i + 1, max(LEAST_REACH, len(template))
            while j < len(apart) and apart[j][1] - apart[i][0] <= reach:
                j += 1
            low, high = apart[i][0], apart[j - 1][1]
            got = align(template, words, (low + high) // 2, (high - low + 1) // 2 + BAND) if j > i + 1 and enough(low, high) else None
            if got and got[0] >= least:
                out.append((t, got[0], len(template), got[1], got[2]))
                i = j
            else:
                i += 1
    return sorted(set(out), key=lambda x: (x[3], x[0]))


_SQL = "doc_id long, license string, matched_words int, template_words int, coverage double, span_start long, span_end long"


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row per match: doc_id, license, matched and template words, coverage, span [start, end) in code points."""
    notices = NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(notices, min_coverage)
        for batch in batches:
            found: list[tuple] = []
            ids = batch.column(0)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= BATCH_BYTES):
                    size += len(texts[high])
                    high += 1
                part = texts[low:high]
                starts, words = _words(b"\n".join(part))
                base = np.cumsum([0, *(len(t) + 1 for t in part)])
                edge = np.searchsorted(starts, base)
                owner = np.repeat(np.arange(len(part)), np.diff(edge))
                grams = _grams(words, owner)
                places = winnow(grams, owner)
                places = places[np.isin(grams[places], templates.keys)]
                several = {int(o) for o in owner[places]} | ({int(o) for o in owner[np.isin(words, templates.short)]} if len(templates.short) else set())
                for i in sorted(several):
                    mine = slice(edge[i], edge[i + 1])
                    for t, matched, whole, first, last in scan(part[i], templates, starts[mine], words[mine], places[(places >= edge[i]) & (places < edge[i + 1])] - edge[i], min_coverage):
                        begin = int(starts[mine][first] - base[i])
                        end = int(starts[mine][last] - base[i])
                        data = part[i]
                        while end < len(data) and not not_word()[data[end]]:
                            end += 1
                        chars = [len(data[:x].decode("utf-8", "surrogatepass")) for x in (begin, end)]
                        found.append((ids[low + i].as_py(), templates.names[t], matched, whole, matched / whole, *chars))
                low = high
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*found, strict=True)) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SQL.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SQL)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
