import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelake.llm import boosting, toxicity
from hirelake.llm.common import table


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / max(ones * (len(y) - ones), 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf).toPandas()
    assert len(got) == table(spark, sf, "documents").count() and got.score.between(0, 1).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    m = got.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert auc(m.score.to_numpy(), m.toxic.to_numpy()) > 0.97
    assert (m.predicted == m.toxic).mean() > 0.97


def test_labels_of_held_out_rows_and_metadata_do_not_matter(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    one = toxicity.fit_toxicity(docs, labels)
    from pyspark.sql import functions as F

    held = toxicity._remainder(5) == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    two = toxicity.fit_toxicity(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}), other)
    x = np.random.default_rng(0).random((50, len(toxicity.FEATURES)))
    assert one.lexicon == two.lexicon and (one.scores(x) == two.scores(x)).all()


def test_odd_rows(spark, odd_docs, no_docs, labels):
    model = toxicity.fit_toxicity(odd_docs, labels)
    got = toxicity.score_toxicity(odd_docs.drop("score"), model).toPandas()
    assert len(got) == 12 and got.score.between(0, 1).all()
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.score_toxicity(odd_docs.drop("score"), toxicity.fit_toxicity(odd_docs, none)).toPandas().score.max() == 0.0
    assert toxicity.drop_toxic(no_docs, labels).count() == 0


def test_isotonic_is_monotone_and_equals_brute_force_pools():
    rng = np.random.default_rng(1)
    x = rng.random(300)
    y = (rng.random(300) < x**2).astype(float)
    knots, levels = boosting.fit_isotonic(x, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all()
    assert abs(np.interp(x, knots, levels).mean() - y.mean()) < 0.05


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit_boosted(x, y)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.95


LEXICON = {"idiot": 2.0, "idio~": 1.5, "vile": 3.0, "trotte~": 1.0, "scum": 2.5}


def slow_features(text):
    """The features by plain loops over words and runs without white space."""
    low = text.lower()
    words = re.findall(r"[^\W\d_]+", low)
    weight_of = lambda w: max(LEXICON.get(t, 0.0) for t in [w] + [w[:k] + "~" for k in (4, 5, 6) if len(w) >= k])
    hits = [i for i, w in enumerate(words) if weight_of(w)]
    people = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    given_hits = sum(w in toxicity.INSULTS for w in words)
    masked = 0
    for m in toxicity.MIXED.finditer(low):
        at = 0
        for run in re.split(r"\s", low):
            if at <= m.start() < at + len(run):
                bare = "".join(c for c in run.translate(toxicity.LOOK_ALIKES) if re.match(r"\w", c) and not re.match(r"[\d_]", c))
                masked += bare in toxicity.INSULTS or bool(bare and weight_of(bare))
            at += len(run) + 1
    near = sum(any(abs(h - p) <= 5 for p in people) for h in hits)
    kinds = {words[i] for i in hits}
    n, size = max(len(words), 1), max(len(text), 1)
    letters = sum(len(w) for w in words)
    return [
        len(hits) / n, min(len(hits), 20), sum(weight_of(words[i]) for i in hits) / n, max((weight_of(w) for w in kinds), default=0.0), given_hits / n, min(given_hits, 20),
        (len(hits) + masked) / n, masked, near / n, len(people) / n, sum(c.isupper() for c in text) / size, len(toxicity.CAPS.findall(text)) / n,
        text.count("!") / size, text.count("?") / size, len(re.findall(r"[!?][!?]+", text)) / n, len(toxicity.MIXED.findall(low)) / n,
        len(re.findall(r"(.)\1\1+", low)) / n, math.log1p(len(words)), letters / n, 1 - letters / size, len(kinds) / max(len(hits), 1),
    ]


_words = st.sampled_from(["idiot", "1d1ot", "idi0ts", "vile", "v1le", "trottel", "scum", "you", "YOU", "dich", "ok", "WOW", "sooo", "!!", "a1b2", "x", "?!", "größe", "s.c.u.m", "\n"])


@settings(max_examples=200, deadline=None)
@given(st.lists(_words, max_size=40).map(" ".join) | st.text(max_size=60) | st.lists(_words, max_size=20).map("".join))
def test_features_against_plain_loops(text):
    got = toxicity.features(text, LEXICON, {})
    assert len(got) == len(toxicity.FEATURES)
    for name, a, b in zip(toxicity.FEATURES, got, slow_features(text), strict=True):
        assert abs(a - b) < 1e-12, name


def test_masked_words_end_at_any_white_space():
    masked = toxicity.FEATURES.index("masked_hits")
    for text in ("you idi0t there", "you idi0t\nthere", "you\nidi0t there", "you\tidi0t\u3000there", "x\n\nidi0t"):
        assert toxicity.features(text, LEXICON, {})[masked] == 1


def test_features_of_a_long_run_without_spaces_take_linear_time():
    import time

    began = time.process_time()
    toxicity.features("a1b2c" * 400_000, LEXICON, {})
    assert time.process_time() - began < 20


def test_isotonic_against_the_minimax_formula():
    """Levels before smoothing are max over starts of min over ends of the means, at every score."""
    rng = np.random.default_rng(3)
    x = np.round(rng.random(80), 2)
    y = (rng.random(80) < x).astype(float)
    scores = np.unique(x)
    total, weight = np.array([y[x == s].sum() for s in scores]), np.array([(x == s).sum() for s in scores])
    mean = lambda i, j: total[i : j + 1].sum() / weight[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, len(scores))) for i in range(k + 1)) for k in range(len(scores))]
    knots, levels = boosting.fit_isotonic(x, y)
    for k, s in enumerate(scores):
        same = [i for i in range(len(scores)) if abs(want[i] - want[k]) < 1e-12]
        hits, rows = total[same].sum(), weight[same].sum()
        smooth = (hits + 0.5 * (0 < hits < rows) + 0.25 * (hits == 0)) / (rows + 0.5)
        assert abs(np.interp(s, knots, levels) - smooth) < 1e-9


def test_the_fit_does_not_depend_on_the_order_of_rows(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    twins = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" and more"))))
    one = toxicity.fit_toxicity(twins, labels)
    two = toxicity.fit_toxicity(twins.repartition(7, F.rand(3)).orderBy(F.rand(5)), labels.orderBy(F.rand(1)))
    x = np.random.default_rng(0).random((50, len(toxicity.FEATURES)))
    assert one.lexicon == two.lexicon and (one.scores(x) == two.scores(x)).all()


def test_score_replaces_a_column_of_its_name(spark, odd_docs, labels):
    model = toxicity.fit_toxicity(odd_docs, labels)
    got = toxicity.score_toxicity(odd_docs, model)
    assert got.columns == odd_docs.columns and got.where("score NOT BETWEEN 0 AND 1").count() == 0
    assert toxicity.drop_toxic(odd_docs, labels).where("score <> 0.5").count() == 0
