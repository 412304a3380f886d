import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelake.llm import collocations as C


def brute(rows, least=C.LEAST, top=C.TOP):
    """The contract by dictionaries. rows: (text, lang)."""
    counts, n = {}, Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            own = counts.setdefault(lang if lang is not None else "und", Counter())
            n[lang if lang is not None else "und"] += len(words)
            for size in (1, 2, 3):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(100 * b >= C.DROP_PERCENT * a for q, b in candidates.items() if len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "日本", "a-b", "x'y", "rare1", "rare2"]
    weights = [9, 3, 6, 5, 5, 4, 2, 2, 1, 1, 0.2, 0.1]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", " \r\n", "! "]
    text = lambda: "".join(rng.choices(words, weights)[0] + rng.choice(glue) for _ in range(rng.randint(0, 40)))
    return [(rng.choice([text(), text(), text(), None]), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w1", 1, 2) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, slot string, rank int, block int")


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(1, 300)
    want = brute(rows)
    assert len(want) > 50 and result(C.collocations(frame(spark, rows))) == want
    monkeypatch.setattr(C, "TOP", 7)
    assert result(C.collocations(frame(spark, rows), top=7)) == brute(rows, top=7)


def test_against_brute_force_in_many_blocks_ranges_and_shards(spark, monkeypatch):
    rows = [*corpus(2, 200), ("new york city " * 60, "en"), ("aa " * 400, "en"), ("bb cc. " * 300, None)]
    for name, value in {"BLOCK_BYTES": 500, "HELD_BYTES": 900, "RANGE_GRAMS": 300, "SENT_GRAMS": 100, "WORDS_PER_SHARD": 3, "BUCKETS": 8, "RANK_BUCKETS": 3}.items():
        monkeypatch.setattr(C, name, value)
    assert result(C.collocations(frame(spark, rows))) == brute(rows)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BITS", 3)
    rows = corpus(3, 150)
    assert result(C.collocations(frame(spark, rows))) == brute(rows)


def test_odd_documents(spark, odd_docs, no_docs):
    assert C.collocations(no_docs).count() == 0
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    assert result(C.collocations(odd_docs)) == brute(rows)
    assert result(C.collocations(odd_docs, least=2)) == brute(rows, least=2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_minimal_perfect_hash(keys, others):
    keys = np.array(keys, np.uint64)
    mph = C.MinimalPerfectHash(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    assert all(0 <= s <= len(keys) for s in mph.slots(np.array(others, np.uint64)).tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3), st.integers(1, 6)), max_size=20), max_size=6))
def test_counts_of_a_range(chunks):
    want = Counter()
    arrays = []
    for chunk in chunks:
        own = Counter()
        for a, b, c in chunk:
            own[a, b] += c
        want.update(own)
        arrays.append((np.array([a for a, _ in own], np.uint64), np.array([b for _, b in own], np.int64), np.array(list(own.values()), np.int32)))
    a, b, f = C.count_range(arrays) if arrays else ([], [], [])
    assert dict(zip(zip(map(int, a), map(int, b), strict=True), map(int, f), strict=True)) == {k: c for k, c in want.items() if c >= C.LEAST}


def test_tree_sum():
    assert C.tree_sum(iter([])) is None
    for n in range(1, 20):
        assert C.tree_sum(np.full(3, i) for i in range(n)).tolist() == [n * (n - 1) // 2] * 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30))
def test_mixed_keys_can_be_undone(keys):
    keys = np.array(keys, np.uint64)
    assert C._unmix(C.mix(keys)).tolist() == keys.tolist()


def test_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BYTES", 10)
    for text in (b"", b"ab cd\nef gh\nij", b"a" * 25 + b"\nb\n" + b"c d " * 9, b"\n" * 30, b"x" * 40):
        parts = list(C._cut(text))
        assert b"\n".join(parts) == text and all(len(p) <= 10 or b"\n" not in p[:-1] for p in parts)


@pytest.mark.parametrize("text", ["", " ", "a", "A b.c,D\te\nf", "é日本 x;;y", "a" * 50, ". ."])
def test_words_of_a_block(text):
    words, places = C.read_words(text.encode().translate(C._READ))
    low = "".join(c.lower() if c.isascii() else c for c in text)
    want = [(w, i == 0) for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low) for i, w in enumerate(re.findall("[^ \t]+", piece))]
    got = words.to_pylist()
    assert [(got[~p if p < 0 else p], bool(p < 0)) for p in places.tolist()] == want and len(set(got)) == len(got)


def test_scores_of_large_counts_are_exact(spark):
    a, l, r = 10**12 + 7, 3 * 10**12 + 1, 10**12 + 9
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(C._score("a", "l", "r")).first()[0] == 10**6 * a * a // (l * r)
