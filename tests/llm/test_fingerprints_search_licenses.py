import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirelake.llm import edit_embedding, hamming_search, license_scan
from hirelake.llm.common import table


def walk_one(text: str, walk: int) -> list[int]:
    """Steps at which each character is entered, by the tables, one character at a time."""
    lasts = edit_embedding._walk_tables()[walk]
    now, out = 0, []
    for c in np.frombuffer(text.encode("utf-32-le"), np.uint32):
        out.append(now)
        kind = int((int(c) * 0x9E3779B1 % (1 << 32)) >> 26)
        now += int(lasts[kind * edit_embedding.PERIOD + now % edit_embedding.PERIOD])
    return out


def bits_one(text: str) -> list[int]:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    entered = [walk_one(text, w) for w in range(edit_embedding.WALKS)]
    out = []
    for slot, places in enumerate(edit_embedding._sample_places()):
        place = max(p for p in places if p < 2 * len(text))
        at = max(i for i, e in enumerate(entered[slot // edit_embedding.SLOTS]) if e <= place)
        out.append(int(edit_embedding._bits(points[at : at + 1], np.array([slot]))[0]))
    return out


def test_fingerprints_against_one_at_a_time():
    texts = ["a", "hello world, this is a text", "größe 日本語 😀 " * 9, "xy" * 200]
    got = edit_embedding.fingerprints([*texts, ""])
    assert [g.tolist() for g in got[:-1]] == [bits_one(t) for t in texts]
    assert (edit_embedding.fingerprints(texts[::-1])[::-1] == got[:-1]).all()


def test_likeness_follows_edits():
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefghij klmnop"), 2000))
    near, far = [], []
    for _ in range(10):
        t = list(base)
        for p in rng.integers(0, len(t), 3):
            t[p : p + 1] = rng.choice(["", "x", "yz"])
        near.append("".join(t))
        far.append("".join(rng.choice(list("abcdefghij klmnop"), 2000)))
    prints = edit_embedding.fingerprints([base, *near, *far])
    like = edit_embedding.likeness(np.repeat(prints[:1], 20, 0), prints[1:])
    assert np.median(like[:10]) > 0.8 and like[:10].min() > 0.4 > 0.3 > like[10:].max()


def check_neighbours(rows, got):
    """rows: (doc_id, text) in the expected order."""
    texts = [t or "" for _, t in rows]
    edited = [edit_embedding.edited_text(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    prints, changed = edit_embedding.fingerprints(texts), edit_embedding.fingerprints(edited)
    pack = lambda x: np.packbits(x, axis=1)
    want = sorted(
        (-1 if d is None else d, len(t), hashlib.sha256(e.encode()).hexdigest(), p.tobytes().hex(), c.tobytes().hex(), float(x), float(y))
        for (d, _), t, e, p, c, x, y in zip(rows, texts, edited, pack(prints), pack(changed), edit_embedding.likeness(prints, changed), edit_embedding.likeness(prints, np.roll(prints, -1, 0)), strict=True)
    )
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got)
    assert want == have


def test_op4_against_brute_force(spark, sf):
    rows = sorted(((r.doc_id, r.text) for r in table(spark, sf, "documents").collect()), reverse=True)
    got = edit_embedding.op4_fingerprints(spark, sf).collect()
    check_neighbours(rows, got)
    assert sum(r.near_edited > r.near_next for r in got) > 0.97 * len(got)


def test_op4_odd_rows(spark, odd_docs, no_docs):
    got = edit_embedding.fingerprint_documents(odd_docs).collect()
    assert len(got) == 12 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    distinct = odd_docs.where("doc_id > 1").select("doc_id", "text")
    check_neighbours(sorted(((r.doc_id, r.text) for r in distinct.collect()), reverse=True), edit_embedding.fingerprint_documents(distinct).collect())
    one = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    check_neighbours([(1, "only one")], edit_embedding.fingerprint_documents(one).collect())
    assert edit_embedding.fingerprint_documents(no_docs).count() == 0


def brute_top(codes, queries, k):
    out = set()
    for q, x in queries:
        order = sorted({(bin((x ^ c) & (2**64 - 1)).count("1"), i) for i, c in codes if i != q})[:k]
        out |= {(q, i, d, r + 1) for r, (d, i) in enumerate(order)}
    return out


@pytest.mark.parametrize("most", [1 << 18, 20, 0])
def test_top_k_against_brute_force(spark, monkeypatch, most):
    """By look-ups alone, and with the comparison of all codes from some radius on."""
    monkeypatch.setattr(hamming_search, "MOST_MASKS", most)
    monkeypatch.setattr(hamming_search, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(9)
    codes = [(i, int(c)) for i, c in enumerate(rng.integers(-(2**63), 2**63 - 1, 300))]
    centre = codes[0][1]
    codes += [(1000 + i, centre) for i in range(100)]  # a hot code
    codes += [(2000 + i, centre ^ (1 << int(rng.integers(0, 63)))) for i in range(100)]
    codes += codes[:20]  # repeated rows
    df = spark.createDataFrame(codes, "id long, code long")
    asked = df.where(F.col("id") % 50 == 0)
    got = hamming_search.top_k(df, asked, 7).collect()
    want = brute_top(set(codes), {c for c in codes if c[0] % 50 == 0}, 7)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_over_several_numbers_of_segments(spark, monkeypatch):
    """Far neighbours: queries go on with more segments, and begin anew there."""
    monkeypatch.setattr(hamming_search, "MOST_MASKS", 700)
    steps = hamming_search.search_steps(4000)
    assert len({s.count for s in steps}) > 1 and [s.reach for s in steps] == sorted({s.reach for s in steps})
    rng = np.random.default_rng(4)
    codes = [(i, int(c)) for i, c in enumerate(rng.integers(-(2**63), 2**63 - 1, 4000))]
    codes += [(5000 + i, codes[i][1] ^ (1 << int(rng.integers(0, 63)))) for i in range(0, 4000, 40)]
    df = spark.createDataFrame(codes, "id long, code long")
    got = hamming_search.top_k(df, df.where(F.col("id") % 200 == 0), 3).collect()
    assert {tuple(r) for r in got} == brute_top(set(codes), {c for c in codes if c[0] % 200 == 0}, 3)


def test_search_steps_prefer_look_ups_at_size():
    """At 10^9 codes the tenth neighbour of a random code lies about 10 bits away: 0.3 % of a comparison of all."""
    steps = hamming_search.search_steps(10**9)
    near = [s for s in steps if s.reach <= 11]
    assert near[-1].reach == 11 and sum(s.work(10**9) for s in near) < 3e-3 * 10**9
    assert steps[-1].reach >= 23 and sum(s.work(10**9) for s in steps) <= 2 * 10**9
    assert all(s.values() == len(s.masks()) <= hamming_search.MOST_MASKS for s in steps)
    assert hamming_search.search_steps(0) == []


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, -1.0, float("nan")]), (50, None), (None, [1.0]), (1, []), (2, [1.0] * 70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(F.col("vec_id").alias("id"), hamming_search.sign_code("embedding").alias("code"))
    assert {r.id: r.code for r in df.collect() if r.id is not None} == {0: 1, 50: None, 1: 0, 2: -1}
    got = hamming_search.top_k(df, df.where("id % 50 = 0")).collect()
    assert [(r.query_id, r.neighbor_id, r.distance, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1, 1), (0, 2, 63, 2)]
    assert hamming_search.top_k(df.limit(0), df.limit(0)).count() == 0


def words(text):
    return "".join(c if c.isascii() and c.isalnum() or c == "_" or ord(c) > 127 else " " for c in text.lower()).split()


def test_license_lines_of_the_corpus(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = license_scan.op6_license_scan(spark, "/root/testdata/sf0.01").collect()
    lines = {n: t for n, t in license_scan.NOTICES.items() if "(line)" in n}
    want = {(d, n) for d, t in docs.items() for n, line in lines.items() if " ".join(words(line)) in " ".join(words(t))}
    assert want <= {(r.doc_id, r.license) for r in got} and want
    for r in got:
        found, notice = words(docs[r.doc_id][r.span_start : r.span_end]), words(license_scan.NOTICES[r.license])
        assert r.coverage >= license_scan.MIN_COVERAGE and len(set(found) & set(notice)) >= 0.6 * len(set(notice))


def test_license_with_gaps_repeats_and_odd_rows(spark, odd_docs, no_docs):
    mit = license_scan.NOTICES["MIT"]
    changed = mit.replace("free of charge, ", "").replace("sublicense", "relicense")
    rows = [(1, f"é 日本 head\n{mit}\ntail {mit} end"), (2, changed.upper()), (3, mit[: len(mit) // 3]), (4, "nothing here")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    one = got[(got.doc_id == 1) & (got.license == "MIT")].sort_values("span_start")
    assert one.coverage.tolist() == [1.0, 1.0]
    assert [rows[0][1][r.span_start : r.span_end] for r in one.itertuples()] == [mit.rstrip(".")] * 2
    two = got[(got.doc_id == 2) & (got.license == "MIT")]
    assert len(two) == 1 and 0.9 < two.coverage.iloc[0] < 1 and not len(got[got.doc_id.isin([3, 4])])
    assert license_scan.scan_licenses(odd_docs).count() == 0 and license_scan.scan_licenses(no_docs).count() == 0
    short = license_scan.scan_licenses(spark.createDataFrame([(1, "under GPL terms")], "doc_id long, text string"), {"G": "gpl"}).collect()
    assert [(r.span_start, r.span_end) for r in short] == [(6, 9)]


def test_license_with_a_clause_left_out_or_put_in(spark):
    mit = license_scan.NOTICES["MIT"].split()
    put_in = [f"clause{i}" for i in range(30)]
    rows = [(n, " ".join(["before", *mit[:70], *mit[70 + n :], "after"])) for n in (9, 16, 25)]
    rows += [(100 + n, " ".join(["before", *mit[:70], *put_in[:n], *mit[70:], "after"])) for n in (9, 16, 30)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("license = 'MIT'").collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    for r in got:
        whole = r.template_words
        assert r.matched_words == whole if r.doc_id > 100 else whole - 2 * r.doc_id < r.matched_words < whole
    texts = dict(rows)
    assert all(texts[r.doc_id][r.span_start : r.span_end] == texts[r.doc_id][7:-7] for r in got)


def common_words(a, b):
    """Length of the longest common subsequence."""
    where = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def best_window(template, text):
    """Most template words that any window of the text, two bands longer than the template, has in order."""
    n = len(template) + 2 * license_scan.BAND
    return max((common_words(template, text[i : i + n]) for i in range(max(1, len(text) - len(template) // 2))), default=0)


def share_a_run(a, b, n):
    return bool({tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)})


def test_scan_against_full_alignments(spark):
    """Notices with random edits: what is reported, and with which coverage and span, by brute force."""
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(0, 400)}"
    notices = {f"t{n}": " ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 8, 11, 14, 20, 33)}
    rows = []
    for i in range(330):
        template = notices[f"t{[1, 2, 3, 4, 5, 6, 8, 11, 14, 20, 33][i % 11]}"].split()
        for _ in range(int(rng.integers(0, 4))):
            at, kind = int(rng.integers(0, len(template) + 1)), rng.integers(0, 3)
            template[at : at + (kind > 0)] = [word()] if kind < 2 else []
        rows.append((i, " ".join([*(f"x{k}" for k in range(rng.integers(0, 20))), *template, *(f"y{k}" for k in range(rng.integers(0, 20)))])))
    got = {}
    for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), notices).collect():
        got.setdefault((r.doc_id, r.license), []).append(r)
    reported = 0
    for i, text in rows:
        for name, notice in notices.items():
            template, found = words(notice), words(text)
            best = best_window(template, found)
            due = best >= license_scan.least_words(len(template), license_scan.MIN_COVERAGE)
            if due and (len(template) < license_scan.SHORT or share_a_run(template, found, license_scan.GRAM + license_scan.WINDOW - 1)):
                assert (i, name) in got, (i, name)
            for r in got.get((i, name), []):
                span = words(text[r.span_start : r.span_end])
                assert due and r.template_words == len(template) and r.coverage == r.matched_words / len(template)
                assert common_words(template, span) == r.matched_words <= best
                assert common_words(template, span[1:]) < r.matched_words and common_words(template, span[:-1]) < r.matched_words
            if (i, name) in got:
                reported += 1
                assert max(r.matched_words for r in got[i, name]) == best
    assert reported > 150


def test_short_lines_with_a_word_changed(spark):
    rows = [(1, "It is Released under an MIT License, as said"), (2, "Released under the terms MIT License"), (3, "a License of another kind"), (4, "licensed under CC BY NC 4 0")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT (line)"), (2, "MIT (line)"), (4, "CC-BY-NC-4.0 (line)")}


def test_every_line_of_the_corpus_by_brute_force(spark, sf):
    """Each row's coverage and span from full alignments, and no missing line, over whole texts."""
    docs = {r.doc_id: words(r.text or "") for r in table(spark, sf, "documents").collect()}
    raw = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = license_scan.op6_license_scan(spark, sf).collect()
    for r in got:
        template = words(license_scan.NOTICES[r.license])
        assert common_words(template, words(raw[r.doc_id][r.span_start : r.span_end])) == r.matched_words >= license_scan.MIN_COVERAGE * len(template)
    found = {(r.doc_id, r.license) for r in got}
    for name, notice in license_scan.NOTICES.items():
        template = words(notice)
        if len(template) >= license_scan.SHORT:
            continue
        least = license_scan.least_words(len(template), license_scan.MIN_COVERAGE)
        for d, text in docs.items():
            due = len(set(template) & set(text)) >= len(set(template)) * 0.6 and best_window(template, text) >= least
            assert ((d, name) in found) == due, (d, name)


def test_winnowing_guarantee():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 2**60, license_scan.GRAM + license_scan.WINDOW - 1, dtype=np.uint64)
    for _ in range(200):
        sides = []
        for _ in range(2):
            w = np.concatenate([rng.integers(0, 2**60, rng.integers(0, 9), dtype=np.uint64), shared, rng.integers(0, 2**60, rng.integers(0, 9), dtype=np.uint64)])
            owner = np.zeros(len(w), np.int64)
            grams = license_scan._grams(w, owner)
            sides.append({int(grams[p]) for p in license_scan.winnow(grams, owner)})
        assert sides[0] & sides[1]


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12))
def test_edit_distance(a, b):
    assert edit_embedding.edit_distance(a, b) == slow_distance(a, b)


def test_similar_documents_are_found_by_bands_and_verified(spark):
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmno pqrstu")
    rows, group = [], {}
    for g in range(30):
        base = rng.choice(letters, 1200)
        rows.append((100 * g, "".join(base)))
        for i in range(1, 4):
            t = list(base)
            for p in rng.integers(0, len(t), 2):
                t[p : p + 1] = rng.choice(["", "x", "yz"])
            rows.append((100 * g + i, "".join(t)))
        group |= {100 * g + i: 100 * g for i in range(4)}
    got = edit_embedding.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    found = {r.doc_id: r.class_id for r in got.itertuples()}
    assert all(found[d] // 100 == d // 100 for d in found)  # verified: no false links
    assert sum(found[d] == group[d] for d in found) >= 0.95 * len(found)


def test_similar_documents_odd_rows(odd_docs, no_docs):
    got = edit_embedding.similar_documents(odd_docs).toPandas()
    assert got.copies.sum() == 12 and set(got[got.doc_id.isin([1, 2])].class_id) == {1}
    assert edit_embedding.similar_documents(no_docs).count() == 0


def random_edits(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind, letter = int(rng.integers(0, len(out))), rng.integers(0, 3), chr(97 + int(rng.integers(0, 26)))
        out[at : at + (kind > 0)] = [letter] if kind < 2 else []
    return "".join(out)


def test_bands_reach_their_recall_at_the_threshold(spark):
    """Pairs at the default similarity, by random edits of texts of the corpus."""
    rng = np.random.default_rng(21)
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect() if r.text and 1500 <= len(r.text) <= 4000][:150]
    edited = [random_edits(rng, t, int(0.98 * len(t) * (1 - edit_embedding.SIMILARITY))) for t in texts]
    how = edit_embedding.EditWalks()
    one, two = how.sign(texts), how.sign(edited)
    alike = [how.alike(a, b) for a, b in zip(texts, edited, strict=True)]
    found = (one[2] == two[2]).any(1) & ((one[1] == two[1]).mean(1) >= how.least_agreement)
    assert all(alike) and found.mean() >= 0.9


def test_similar_documents_of_the_corpus_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect()]
    rng = np.random.default_rng(8)
    long = [(d, t) for d, t in rows if len(t) > 400][:30]
    rows += [(10_000 + d, random_edits(rng, t, len(t) // 400)) for d, t in long]
    texts = sorted({t for _, t in rows})
    how = edit_embedding.EditWalks()
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_size = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for x, i in enumerate(by_size):
        for j in by_size[x + 1 :]:
            if len(texts[j]) * how.similarity > len(texts[i]) + 1e-6 or not texts[i]:
                break
            if find(i) != find(j) and how.alike(texts[i], texts[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for d, t in rows:
        groups.setdefault(find(texts.index(t)), []).append(d)
    want = {d: min(ids) for ids in groups.values() for d in ids}
    got = edit_embedding.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same = sum(want[r.doc_id] == r.class_id for r in got)
    assert same >= len(want) - 3 and all(want[r.class_id] == want[r.doc_id] for r in got)  # recall; precision is exact


def test_edits_up_to_a_bound_are_told_without_the_whole_table(monkeypatch):
    """As by the whole distance, on texts of few characters, near and far, by all three ways."""
    rng = random.Random(8)
    some = lambda n, of: "".join(rng.choice(of) for _ in range(n))

    def changed(a: str, n: int) -> str:
        out = list(a)
        for _ in range(n):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randrange(2)] = some(rng.randrange(2), "abé")
        return "".join(out)

    texts = [some(rng.randrange(120), "ab" if i % 2 else "abcdé한") for i in range(600)]
    pairs = [(a, changed(a, rng.randrange(40)) if i % 3 else some(rng.randrange(120), "ab")) for i, a in enumerate(texts)]
    whole = [edit_embedding.edit_distance(a, b) for a, b in pairs]
    for (a, b), d in zip(pairs, whole, strict=True):
        assert [edit_embedding.within(a, b, k) for k in (max(d - 1, 0), d, d + 1, 2 * d + 5)] == [d == 0, True, True, True]
    long = some(60_000, "abcdefgh ")
    monkeypatch.setattr(edit_embedding, "edit_distance", None)
    how = edit_embedding.EditWalks()
    assert how.alike(long, changed(long, 500)) and not how.alike(long, long[:30_000] + some(30_000, "abcdefgh "))
