import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import katz
from hirelake.llm.common import table

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


class Model:
    """The model token by token, with dictionaries."""

    def __init__(self, texts):
        self.c, self.b, self.v = Counter(), Counter(), Counter()
        for words in texts:
            self.c.update(words)
            for pair in zip(["<s>", *words], words):
                self.b[pair] += 1
                self.v[pair[0]] += 1
        self.n = sum(self.c.values())
        du, db = (katz.Discounts.fit(Counter(x.values())) for x in (self.c, self.b))
        one = lambda d, r: float(d.of(np.array([r]))[0])
        self.unknown = min(max(sum(x == 1 for x in self.c.values()), 1) / (self.n + 1), 0.5) if self.n else 1.0
        mass = sum(one(du, x) * x for x in self.c.values())
        self.p = {w: (1 - self.unknown) * one(du, x) * x / mass for w, x in self.c.items()}
        self.q = {k: one(db, x) * x / self.v[k[0]] for k, x in self.b.items()}
        self.used, self.lower = defaultdict(float), defaultdict(float)
        for (v, w), p in self.q.items():
            self.used[v] += p
            self.lower[v] += self.p[w]

    def prob(self, v, w):
        if (v, w) in self.q:
            return self.q[v, w]
        p = self.p.get(w, self.unknown)
        return p * (1 - self.used[v]) / (1 - self.lower[v]) if v in self.v else p


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "</s>"]


def check(rows, got):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    m = Model([words_of(t) for d, t in rows if not held(d)])
    want = []
    for d, t in rows:
        words = words_of(t)
        base = sum(math.log10((m.c[w] + 0.1) / (m.n + 0.1 * (len(m.c) + 1))) for w in words)
        score = sum(math.log10(m.prob(*p)) for p in zip(["<s>", *words], words))
        want.append((-1 if d is None else d, held(d), len(words), sum(m.c[w] > 0 for w in words), m.n, base, score))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(sorted(want), have, strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9)
    return m


@pytest.mark.parametrize("block_chars", [1, 20_000, 8 << 20])
def test_op8_against_dictionaries(spark, sf, block_chars):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = katz.katz_scores(docs, katz.held_out_rows(), block_chars=block_chars).collect()
    m = check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)
    assert abs(sum(m.p.values()) + m.unknown - 1) < 1e-9
    for v in ["<s>", *list(m.v)[::500]]:  # every distribution adds up to 1 over words and the unknown type
        assert abs(sum(m.prob(v, w) for w in m.p) + m.prob(v, None) - 1) < 1e-9


@pytest.mark.parametrize("block_chars", [3_000, 60_000])
def test_two_hops_give_the_same_scores(spark, sf, monkeypatch, block_chars):
    monkeypatch.setattr(katz, "RANGE_TOKENS", 2_000)
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    direct = {r.doc_id: r for r in katz.katz_scores(docs, katz.held_out_rows(), block_chars=block_chars).collect()}
    monkeypatch.setattr(katz, "DIRECT_RANGES", 3)
    got = katz.katz_scores(docs, katz.held_out_rows(), block_chars=block_chars).collect()
    check(rows, got)
    assert len(got) == len(direct)
    for r in got:
        assert r[:6] == direct[r.doc_id][:6] and np.isclose(r.score, direct[r.doc_id].score, rtol=1e-12)


def test_rows_of_the_exchange(spark, sf, monkeypatch):
    """A block's rows: one per coarse range instead of one per range."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("long"), F.lit(False).alias("held"), "text")
    blocks = katz.materialise(katz._blocks(docs, 20_000), "blocks")
    monkeypatch.setattr(katz, "RANGE_TOKENS", 50)
    monkeypatch.setattr(katz, "DIRECT_RANGES", 100)
    layout = katz.Layout.of(blocks)
    n = blocks.count()
    assert n > 3 and layout.ranges > 400 and (layout.coarse - 1) ** 2 < layout.ranges <= layout.coarse**2
    sent = katz._requests(blocks, layout.coarse).withColumn("hub", layout.hub())
    assert sent.count() <= 2 * n * layout.coarse
    per_hub = sent.groupBy("hub").agg(F.countDistinct("block").alias("blocks"), F.countDistinct("r").alias("r"))
    assert per_hub.where((F.col("blocks") > layout.coarse) | (F.col("r") != 1)).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    check(rows, katz.katz_scores(odd_docs, katz.held_out_rows()).collect())
    assert katz.katz_scores(no_docs, katz.held_out_rows()).count() == 0
    none = katz.katz_scores(odd_docs, F.lit(True)).collect()
    assert len(none) == 12 and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in none)


def test_discounts_stay_below_one():
    for n in ({1: 5}, {1: 10, 2: 10}, {1: 3, 2: 40, 3: 1}, {}, {1: 1000, 2: 300, 3: 150, 4: 80, 5: 60, 6: 40}):
        d = katz.Discounts.fit(n).of(np.array([1, 2, 3, 5, 6, 100, 10**6]))
        assert (d > 0).all() and (d < 1).all()


def test_compact_arrays_round_trip():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**56, 1000, dtype=np.uint64))
    assert (katz._expand_sorted(katz._squeeze_sorted(keys)) == keys).all() and len(katz._expand(katz._squeeze(keys[:0]))) == 0
