import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hirelake.llm import packing
from hirelake.llm.common import table


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


_special = st.lists(st.text(alphabet="ab 'st\n\t.,1é日<|>", max_size=20) | st.just("<|endoftext|>") | st.sampled_from(["<|endoftext", "endoftext|>", " ", "\n\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab 'st\n\t.,1é日 <|endoftext|>", max_size=300) | _special)
def test_encoder_gives_the_tokenizers_ids(reference, text):
    assert packing.encoder()(text) == reference(text)


def test_added_token_in_a_text(reference):
    text = "hello <|endoftext|> world"
    assert packing.encoder()(text) == reference(text) == [31373, 220, 50256, 995]


def check_pieces(got, texts, ids_of, length=1024):
    """Every document's ids lie in exactly one piece each, pieces tile their sequences."""
    for doc_id, text in texts.items():
        ids = np.array([*ids_of(text or ""), 0], "<u4")
        mine = got[got.doc_id == doc_id].sort_values("start")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    check_sequences(got, length)


def check_sequences(got, length=1024):
    got = got.sort_values(["sequence_id", "offset"])
    before = (got.offset + got.length).groupby(got.sequence_id).shift(fill_value=0)
    assert (before == got.offset).all() and (got.offset + got.length).max() <= length
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))


def test_op7_against_the_tokenizer(spark, sf, reference):
    got = packing.op7_packing(spark, sf).toPandas()
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    check_pieces(got, texts, reference)
    assert got.length.sum() / (got.sequence_id.nunique() * 1024) > 0.97


def test_odd_rows(odd_docs, no_docs, reference):
    got = packing.pack_documents(odd_docs, length=64).toPandas()
    check_sequences(got, 64)
    want = Counter()
    for r in odd_docs.collect():
        n = len(reference(r.text or "")) + 1
        want.update((r.doc_id, s, min(64, n - s)) for s in range(0, n, 64))
    assert Counter((None if np.isnan(r.doc_id) else r.doc_id, r.start, r.length) for r in got.itertuples()) == want
    assert packing.pack_documents(no_docs).count() == 0


def test_round_trip_of_ids(spark, reference):
    docs = spark.createDataFrame([(1, "hello world " * 50), (2, "x")], "doc_id long, text string")
    got = packing.token_pieces(docs, 16, with_ids=True).toPandas().sort_values(["doc_id", "start"])
    for doc_id, text in ((1, "hello world " * 50), (2, "x")):
        assert np.frombuffer(b"".join(got[got.doc_id == doc_id].ids), "<u4").tolist() == [*reference(text), 0]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 40), max_size=20))
def test_patterns_place_each_length_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 32)
    assert all(sum(p) <= 32 for p, _ in patterns)
    placed = Counter()
    for p, n in patterns:
        for size in p:
            placed[size] += n
    assert placed == Counter(histogram)
    where = packing.placements(patterns)
    for size, count in histogram.items():
        rows = where[size]
        assert rows[0, 0] == 0 and (np.diff(rows[:, 0]) > 0).all() and rows[-1, 0] < count
