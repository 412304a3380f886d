import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import hyperlang
from hirelake.llm.common import table


def slow_vector(text):
    """The bundle of a text's trigrams, letter by letter."""
    first, second, third = hyperlang._letter_vectors()
    symbols = [0]
    for c in text:
        low = ord(c.lower()[0])
        own = 1 << (hyperlang.SYMBOL_BITS - 1)
        s = (low if low < own else own + low * 0x9E3779B1 % 0xFFFFFFFB % own) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    out = np.zeros(hyperlang.DIMENSIONS)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        out += first[a].astype(int) * second[b] * third[c]
    return out


TEXTS = ["", "a", "  a1b\n", "The cat, the hat.", "größe über straße 日本語 テスト 😀", "...", "x" * 40, "Ωmega И и İ ı ß", "one two  three-four" * 30]


def test_bundles_against_plain_loops(monkeypatch):
    want = [slow_vector(t) for t in TEXTS]
    for block in (hyperlang.BLOCK_CHARS, 7, 3):
        monkeypatch.setattr(hyperlang, "BLOCK_CHARS", block)
        got = hyperlang.bundles(TEXTS, np.arange(len(TEXTS) + 1), len(TEXTS) + 1)
        assert np.array_equal(got[:-1], want) and not got[-1].any()
    monkeypatch.setattr(hyperlang, "GRAMS", 5)
    assert np.array_equal(hyperlang.bundles(TEXTS, np.zeros(len(TEXTS) + 1, int), 1)[0], sum(want))


def test_trigrams_are_told_apart_with_few_and_many_letters():
    rng = np.random.default_rng(1)
    for high in (30, 4000):
        grams = rng.integers(0, high, 500) << 24 | rng.integers(0, high, 500) << 12 | rng.integers(0, high, 500)
        distinct, place = hyperlang._told_apart(grams)
        assert len(set(distinct.tolist())) == len(distinct) and np.array_equal(distinct[place], grams)


def test_prediction_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in hyperlang.op11_language(spark, sf).collect()}
    assert set(got) == set(rows)
    held = {r.doc_id for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("h")).collect() if r.h}
    sums = {}
    for i, r in rows.items():
        if i not in held and r.lang and r.text:
            sums[r.lang] = sums.get(r.lang, 0) + slow_vector(r.text)
    names = sorted(sums)
    profiles = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    for i, r in list(rows.items())[:60]:
        v = slow_vector(r.text or "")
        cosines = profiles @ v / max(np.linalg.norm(v), 1)
        assert got[i].held_out == (i in held) and abs(got[i].score - max(cosines.max(), 0)) < 1e-9
        assert got[i].lang_pred == (names[int(cosines.argmax())] if v.any() else "und")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    both = hyperlang.op11_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.98 * len(both) > 100 and all(0 <= r.score <= 1 for r in both)


def test_labels_of_held_out_rows_are_not_read(spark, sf):
    docs = table(spark, sf, "documents")
    learn = lambda d: {(r.lang, r.i): r.value for r in hyperlang.prototypes(d.where(~hyperlang.held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())).collect()}
    assert learn(docs) == learn(docs.withColumn("lang", F.when(hyperlang.held_out(), F.lit("xx")).otherwise(F.col("lang"))))


def test_more_languages_than_travel_together(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{c * 3} {c}{d}{c} {d * 2}", f"l{i % 5}") for i, (c, d) in enumerate(zip("abcdefghij", "klmnopqrst", strict=True))], "doc_id long, text string, lang string")
    learned = hyperlang.prototypes(docs)
    want = sorted(hyperlang.identify(docs, learned).collect())
    monkeypatch.setattr(hyperlang, "LANGUAGES", 2)
    assert sorted(hyperlang.identify(docs, hyperlang.prototypes(docs)).collect()) == want and len({r.best_lang for r in want}) == 5


def test_odd_documents(spark, odd_docs, no_docs):
    learned = hyperlang.prototypes(odd_docs.where("text IS NOT NULL AND lang IS NOT NULL"))
    got = hyperlang.identify(odd_docs, learned).toPandas()
    assert len(got) == 12 and set(got[got.key.isin([3, 4, 5])].best_lang) == {"und"} and set(got[got.best_lang == "und"].best) == {0.0}
    assert got[got.key == 1].best.nunique() == 1 and got[got.key == 7].best_lang.tolist() == ["en"]
    assert hyperlang.identify(no_docs, learned).count() == 0
    none = hyperlang.identify(odd_docs, hyperlang.prototypes(no_docs)).toPandas()
    assert len(none) == 12 and set(none.best_lang) == {"und"}


@pytest.mark.parametrize("size", [1, 3, 100])
def test_blocks_cover_all_documents(monkeypatch, size):
    monkeypatch.setattr(hyperlang, "BLOCK_CHARS", size)
    cuts = list(hyperlang._blocks(TEXTS))
    assert [t for c in cuts for t in TEXTS[c]] == TEXTS
