"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a given and of a learned lexicon (words and word stems,
plain, with look-alike characters undone, and with stretched letters undone), how many lexicon
hits stand near a second person, capitals, punctuation, and obfuscation rates. The label table is
the only teacher; language, source and ids are never read by the score.

Fitting uses at most ``sample_rows`` labelled documents (a documented bound, taken in md5 order of
doc_id, one text each); they are featurised on the executors, and the driver gets dense feature rows
and lexicon candidates only. The learned lexicon comes from distinct texts of the sample (near copies count
once, by a sketch), is cross-fitted in two folds so that the trees never see a hit that their own
row has taught, and the calibration uses out-of-fold margins. Scoring is a map-only pass.

Defined cases: null text is empty; an empty text is scored as a text without hits; a very long one
is read whole, in linear time; labels that are null are ignored and repeated ones count by their
maximum; of several texts under one labelled doc_id the one with the least md5 teaches; without
labels of both kinds the score is the share of label 1 (0 where there are no labels); repeated rows
and ties are scored each; an empty table gives an empty result; the score replaces a column of its
name, all other columns, whatever their names, are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.boosting import Boosted, fit_boosted, fit_isotonic
from hirelake.llm.common import free_names, materialise, order_key, release, table

SAMPLE_ROWS = 20_000
LEXICON_ROWS = 2_000
#: Log-likelihood ratio that a term needs to enter the lexicon, and its least odds against chance.
EVIDENCE, LIFT = 18.0, 4.0
HELD_OUT_MOD = 5

INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb fool imbecile "
    "filth vermin pig crap jerk creep shut hate kill ugly bastard arschloch dumm dummkopf trottel abschaum versager "
    "con connard salaud minable ordure imbécile nul idiota estúpido basura escoria imbécil inútil payaso".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
LOOK_ALIKES = str.maketrans("013457@$!€", "oieastasie")
WORD = re.compile(r"[^\W\d_]+")
CHUNK, SPACE = re.compile(r"\S+"), re.compile(r"\s")
MIXED = re.compile(r"[^\W\d_][\d@$!€*#.\-]+[^\W\d_]")
STRETCH = re.compile(r"(.)\1{2,}")
CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
RUNS = re.compile(r"[!?]{2,}")
STEMS = (4, 5, 6)

FEATURES = (
    "learned_density", "learned_hits", "learned_weight", "learned_best", "given_density", "given_hits", "plain_or_masked_density",
    "masked_hits", "near_second_person", "second_person_density", "capitals", "caps_words", "exclamations", "questions",
    "marks_in_rows", "mixed_chunks", "stretched", "log_words", "word_length", "symbol_rate", "share_of_best",
)


def terms(word: str) -> list[str]:
    """A word and its stems, stems being marked."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) >= n)]


def features(text: str, lexicon: dict[str, float], memo: dict[str, float]) -> list[float]:
    """Dense features; ``memo`` keeps each word's best lexicon weight."""
    low = text.lower()
    words = WORD.findall(low)
    n = max(len(words), 1)
    if len(memo) > 500_000:
        memo.clear()
    hits, people, given, best = [], [], 0, Counter()
    weight = 0.0
    for i, word in enumerate(words):
        value = memo.get(word)
        if value is None:
            value = memo[word] = max((lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        if value:
            hits.append(i)
            weight += value
            best[word] += 1
        if word in INSULTS:
            given += 1
        if word in SECOND_PERSON:
            people.append(i)
    masked, end, hit = 0, 0, False
    for chunk in MIXED.finditer(low):
        if chunk.start() >= end:  # another run without white space
            start, after = chunk.start(), SPACE.search(low, chunk.end())
            while start > end and not low[start - 1].isspace():
                start -= 1
            end = after.start() if after else len(low)
            bare = re.sub(r"[^\w]|[\d_]", "", low[start:end].translate(LOOK_ALIKES))
            hit = bare in INSULTS or any(t in lexicon for t in terms(bare))
        masked += hit
    stretched = len(STRETCH.findall(low))
    near = 0
    if people and hits:
        at = np.searchsorted(people, hits)
        near = sum(1 for h, a in zip(hits, at, strict=True) if (a < len(people) and people[a] - h <= 5) or (a and h - people[a - 1] <= 5))
    size = max(len(text), 1)
    letters = sum(map(len, words))
    return [
        len(hits) / n, min(len(hits), 20), weight / n, max((lexicon.get(t, 0.0) for w in best for t in terms(w)), default=0.0), given / n, min(given, 20),
        (len(hits) + masked) / n, masked, near / n, len(people) / n, sum(1 for c in text if c.isupper()) / size, len(CAPS.findall(text)) / n,
        text.count("!") / size, text.count("?") / size, len(RUNS.findall(text)) / n, len(MIXED.findall(low)) / n, stretched / n,
        math.log1p(len(words)), letters / n, 1 - letters / size, len(best) / max(len(hits), 1),
    ]


def sketch(words: list[str]) -> int:
    """Least hash of the text's runs of three words: equal for most near copies."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Boosted
    knots: np.ndarray
    levels: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.probability(x)
        if not len(self.knots):
            return np.clip(raw if self.trees.trees else np.full(len(raw), raw[0] if len(raw) and raw[0] > 1e-3 else 0.0), 0, 1)
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(level * (1 - 1e-6) + raw * 1e-6, 0, 1)  # the raw score orders rows within a level


def _remainder(mod: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``sample_rows`` labelled training documents: text, y, fold."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_remainder(HELD_OUT_MOD) != 0))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .withColumn("okey", order_key("doc_id"))
        .orderBy("okey")
        .limit(sample_rows)
        .select("doc_id", "y", (F.ascii(F.substring("okey", 32, 1)) % 2).alias("fold"))
    )  # a bounded table
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "y", "fold").agg(F.min(F.struct(F.md5("text").alias("key"), "text")).alias("least"))
    return one.select("least.text", "y", "fold")


def learn_lexicon(sample: DataFrame) -> list[dict[str, float]]:
    """Lexicons {term: log odds}: of fold 1 (for fold 0), of fold 0 (for fold 1), of both."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: Counter = Counter()
            for text, y, fold in zip(frame["text"], frame["y"], frame["fold"], strict=True):
                found = {t for w in set(WORD.findall(text.lower())) for t in terms(w)}
                seen.update((t, int(y), int(fold)) for t in found)
                seen[("", int(y), int(fold))] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["term", "y", "fold", "n"])

    def sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(sketch=[sketch(WORD.findall(t.lower())) for t in frame["text"]])

    distinct = sample.mapInPandas(sketched, "text string, y int, fold int, sketch long").groupBy("sketch", "y")
    distinct = distinct.agg(F.min(F.struct(F.md5("text").alias("key"), "fold", "text")).alias("least")).select("least.text", "y", "least.fold")
    counts = distinct.select("text", "y", "fold").mapInPandas(count, "term string, y int, fold int, n long").groupBy("term")
    pick = lambda y, fold: F.sum(F.when((F.col("y") == y) & (F.col("fold") == fold), F.col("n")).otherwise(0))
    counts = counts.agg(pick(1, 0).alias("a0"), pick(0, 0).alias("b0"), pick(1, 1).alias("a1"), pick(0, 1).alias("b1"))
    counts = materialise(counts.where((F.col("a0") + F.col("a1") >= 3) | (F.col("term") == "")), "terms")
    all_rows = counts.where(F.col("term") == "").first()
    out = []
    for folds in ((1,), (0,), (0, 1)):
        big_a, big_b = (float(sum(all_rows[f"{s}{f}"] for f in folds)) if all_rows else 0.0 for s in "ab")
        if not big_a or not big_b:
            out.append({})
            continue
        a, b = (sum((F.col(f"{s}{f}") for f in folds), F.lit(0)).cast("double") for s in "ab")
        share = big_a / (big_a + big_b)
        odds = F.log((a + 0.25) / (b + 0.25)) - math.log(big_a / big_b)
        evidence = 2 * (a * F.log(F.greatest(a, F.lit(1e-9)) / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
        rows = counts.where((F.col("term") != "") & (a >= 3)).select("term", odds.alias("odds"), evidence.alias("evidence"))
        rows = rows.where((F.col("evidence") >= EVIDENCE) & (F.col("odds") >= math.log(LIFT))).orderBy(F.desc("evidence"), "term").limit(LEXICON_ROWS).collect()
        out.append({r.term: float(r.odds) for r in rows})
    release(counts)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    sample = materialise(labelled_sample(docs, labels, sample_rows).repartition(12), "labelled")
    lexicons = learn_lexicon(sample)

    def featurise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memos: list[dict[str, float]] = [{}, {}]
        for frame in frames:
            rows = [features(t, lexicons[f], memos[f]) for t, f in zip(frame["text"], frame["fold"], strict=True)]
            yield pd.DataFrame({"y": frame["y"], "fold": frame["fold"], "x": rows})

    got = sample.mapInPandas(featurise, "y int, fold int, x array<double>").toPandas()  # ``sample_rows`` rows of a few features
    release(sample)
    if not len(got):
        return ToxicityModel(lexicons[2], Boosted(-35.0), np.array([]), np.array([]))
    order = got.assign(k=got["x"].map(tuple)).sort_values(["k", "y", "fold"]).index  # row order must not depend on tasks
    got = got.loc[order]
    x, y, fold = np.array(got["x"].tolist(), float), got["y"].to_numpy(float), got["fold"].to_numpy()
    trees = fit_boosted(x, y)
    if not trees.trees:
        return ToxicityModel(lexicons[2], trees, np.array([]), np.array([]))
    out_of_fold = np.zeros(len(y))
    for f in (0, 1):
        if (fold == f).any():
            out_of_fold[fold == f] = fit_boosted(x[fold != f], y[fold != f]).probability(x[fold == f]) if (fold != f).any() else trees.probability(x[fold == f])
    return ToxicityModel(lexicons[2], trees, *fit_isotonic(out_of_fold, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1], which replaces a column of that name; map-only."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, float] = {}
        for part in texts:
            x = np.array([features(t or "", model.lexicon, memo) for t in part], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.scores(x))

    return docs.withColumn(into, score(F.coalesce(F.col(text), F.lit(""))))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, columns unchanged."""
    model = fit_toxicity(docs, labels)
    (score,) = free_names(docs, "_toxicity")
    return score_toxicity(docs, model, into=score).where(F.col(score) < threshold).drop(score)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id",
        (_remainder(HELD_OUT_MOD) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
