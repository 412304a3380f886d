from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from hirelake.llm import edit_embedding, near_classes, near_dedup
from hirelake.llm.bagminhash import bags, signatures, weighted_jaccard
from hirelake.llm.common import table
from hirelake.llm.components import components
from hirelake.llm.wordhash import shingles


def bag(text):
    words = "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else " " for c in text.lower()).split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 0.0


def brute_classes(rows, similarity=0.8):
    """{(doc_id, text): least doc_id of its class} by comparing every pair that shares a shingle."""
    texts = sorted({t or "" for _, t in rows})
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    found = [bag(t) for t in texts]
    holders = defaultdict(list)
    for i, b in enumerate(found):
        for s in b:
            holders[s].append(i)
    for i, j in {p for h in holders.values() for p in combinations(h, 2)}:
        if jaccard(found[i], found[j]) >= similarity:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for doc_id, t in rows:
        groups[root(texts.index(t or ""))].append(doc_id)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return {(d, t or ""): least[root(texts.index(t or ""))] for d, t in rows}


def test_op9_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = brute_classes(rows)
    got = near_dedup.op9_near_dedup(spark, sf).toPandas()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got.itertuples()} == {d: c for (d, _), c in want.items()}
    assert (got.groupby("class_id").kept.sum() == 1).all() and (got[got.kept].doc_id == got[got.kept].class_id).all()


def test_chain_of_near_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(120)]
    rows, current = [], list(words)
    for i in range(60):  # each differs from the one before in two words: neighbours are alike, ends are not
        rows.append((i, " ".join(current)))
        current[(2 * i) % 120] = f"x{i}"
        current[(2 * i + 1) % 120] = f"y{i}"
    rows += [(1000 + i, " ".join(f"z{i}q{k}" for k in range(40))) for i in range(20)]
    want = brute_classes(rows)
    got = near_dedup.classify_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {r.doc_id: r.class_id for r in got.itertuples()} == {d: c for (d, _), c in want.items()}
    assert len({want[r] for r in rows[:60]}) == 1


def test_large_groups_use_few_pairs(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 700):
        copy = list(base)
        for k in rng.choice(150, 2, replace=False):
            copy[k] = f"c{i}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.classify_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got.class_id) == {0} and set(got.class_size) == {700}


@pytest.mark.parametrize("alike", [False, True])
def test_an_odd_text_meets_a_large_class_once(spark, alike):
    """One text in a bucket of 20,000 united copies: a pair of blocks for each of the class's blocks."""
    from pyspark.sql import functions as F

    class FirstLetter:
        dtype, size, least_agreement = np.uint8, 4, 0.7

        def prepare(self, texts):
            return texts

        def alike(self, a, b):
            return a[0] == b[0]

    n = 20_000
    key = F.unhex(F.md5(F.col("id").cast("string")))
    rows = spark.range(n + 1).select("id", key.alias("tkey"), F.unhex(F.md5(F.when(F.col("id") == n, F.lit("x")).otherwise(F.lit("y")))).alias("cls"))
    like = F.col("id") == (n if not alike else 12_345)
    text = F.when((F.col("id") == n) | like, F.lit("odd")).otherwise(F.lit("copy"))
    members = rows.select(F.lit(7).cast("long").alias("bk"), "tkey", "cls")
    sigs = rows.select("tkey", F.unhex(F.when(F.col("id") == n, F.lit("01020304")).otherwise(F.lit("01020309"))).alias("sig"), F.array(F.lit(7).cast("long")).alias("bands"))
    texts = rows.select("tkey", text.alias("text"), F.lit(4).alias("size"))
    links = near_classes._rest(members, sigs, texts, FirstLetter()).collect()
    assert len(links) == int(alike)
    dealt = near_classes._deal(members, texts)
    blocks = dealt.groupBy("bk", "grp", "block").count()
    assert dealt.count() == n + 1 and blocks.agg(F.max("count")).first()[0] <= 1.3 * near_classes.BLOCK
    pairs = near_classes._block_pairs(blocks)
    assert pairs.count() == blocks.count() <= n / near_classes.BLOCK + 2  # the odd text's block with each, and with itself


def test_many_small_classes_in_one_bucket(spark):
    """Texts that share passages but are not alike, with a few near copies: equal to brute force."""
    rng = np.random.default_rng(11)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(900):
        own = [f"o{i}x{k}" for k in range(18)]
        rows.append((i, " ".join(shared + own)))
        if i % 9 == 0:
            copy = list(shared + own)
            copy[int(rng.integers(60, 78))] = "changed"
            rows.append((5000 + i, " ".join(copy)))
    want = brute_classes(rows)
    got = near_dedup.classify_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {r.doc_id: r.class_id for r in got.itertuples()} == {d: c for (d, _), c in want.items()}
    assert len(set(want.values())) > 700


def test_odd_rows(odd_docs, no_docs):
    got = near_dedup.classify_documents(odd_docs).toPandas()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute_classes(rows)
    assert got.copies.sum() == len(rows)
    ids = {None if np.isnan(r.doc_id) else int(r.doc_id): None if np.isnan(r.class_id) else int(r.class_id) for r in got.itertuples() if r.doc_id == r.doc_id}
    assert ids == {d: c for (d, _), c in want.items() if d is not None}
    kept = near_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 3: 1, 5: 1, None: 1, 7: 1, 8: 1, 9: 1, 10: 1})
    assert near_dedup.classify_documents(no_docs).count() == 0 and near_dedup.drop_near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("heavy", [1, 7, 300])
def test_signature_agreement_is_weighted_jaccard(heavy):
    rng = np.random.default_rng(heavy)
    a = Counter({int(x): int(rng.integers(1, heavy + 1)) for x in rng.integers(0, 2**62, 80)})
    b = Counter({k: int(rng.integers(1, heavy + 1)) for k in list(a)[:60]}) + Counter({int(x): 1 for x in rng.integers(0, 2**62, 15)})
    estimates = []
    for seed in range(20):
        parts = [np.array([[k ^ (seed << 55), v] for k, v in c.items()], np.uint64) for c in (a, b)]
        elements = np.concatenate([p[:, 0] for p in parts])
        owner = np.repeat([0, 1], [len(p) for p in parts])
        sig = signatures(elements, owner, np.concatenate([p[:, 1] for p in parts]).astype(np.int64), 2)
        estimates.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(estimates) - jaccard(a, b)) < 4 * np.sqrt(0.25 / 256 / 20)


def test_bags_and_exact_similarity():
    texts = ["a b c d e f a b c d e f a b c d e f", "a b c d e f a b c d e", "x", "", "A, b; c!  d e"]
    elements, owner, weight = bags(*shingles(texts))
    got = [(elements[owner == i], weight[owner == i]) for i in range(len(texts))]
    assert [len(g[0]) for g in got] == [len(bag(t)) for t in texts]
    assert weighted_jaccard(got[0], got[1]) == jaccard(bag(texts[0]), bag(texts[1]))
    assert weighted_jaccard(got[4], bags(*shingles(["a b c d e"]))[::2]) == 1.0


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_chains_and_stars(spark, one_task):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 30)) and got[201] == 200


def test_chance_buckets_are_dropped_before_texts_are_fetched(spark, monkeypatch):
    """Texts that share bands by chance only reach no later step; small and large buckets give the same classes."""
    rng = np.random.default_rng(3)
    letters = list("abcdefghij klmnop")
    rows = [(i, "".join(rng.choice(letters, 300 + 10 * i))) for i in range(120)]
    rows += [(1000 + i, t[:150] + "x" + t[151:]) for i, t in rows[:20]] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(edit_embedding, "BAND_BITS", 7)  # about one other text a band by chance
    how, found = edit_embedding.EditWalks(), []
    for most in (near_classes.SMALL_BUCKET, 0):
        monkeypatch.setattr(near_classes, "SMALL_BUCKET", most)
        signed = near_classes.sign(docs, how)
        assert signed.where("bands IS NOT NULL").count() == 0
        kept = near_classes._meetings(signed, how)[0].select("tkey").distinct().count()
        assert 38 <= kept <= (90 if most else 140)
        got = near_classes.classify_documents(docs, how).collect()
        found.append({(r.doc_id, r.class_id, r.class_size) for r in got})
    assert found[0] == found[1] and {(1000, 0, 3), (0, 0, 3)} <= found[0]
