from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_near_dedup import brute_classes
from test_packing import check_sequences

from hirelake.llm import mixing, packing, toxicity
from hirelake.llm.common import table


def test_stages_one_by_one(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.toPandas(), docs.columns
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs.toPandas())
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    scores = toxicity.op10_toxicity(spark, sf).toPandas().set_index("doc_id").predicted
    assert set(after.doc_id) == {d for d in before.doc_id if not scores[d]}
    before, after = kept["near_duplicates"]
    classes = brute_classes(list(zip(before.doc_id, before.text, strict=True)))
    assert sorted(after.doc_id) == sorted(set(classes.values()))
    before, after = kept["mixing"]
    placed = mixing.mix_schedule(spark.createDataFrame(before))[0].toPandas()
    assert set(after.doc_id) == set(placed[placed.slot.notna()].doc_id) and len(after)
    before, after = kept["packing"]
    check_sequences(after)
    assert set(after.doc_id) == set(before.doc_id) and (after.groupby("doc_id").length.sum() == after.groupby("doc_id").doc_tokens.max()).all()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    """Every stage keeps all columns of the rows it keeps, whatever their names."""
    docs = odd_docs
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == odd_docs.columns and not rows(after) - rows(docs)
        if name == "near_duplicates":
            assert Counter(r.doc_id for r in after.collect()) == Counter({1: 1, 3: 1, 5: 1, None: 1, 7: 1, 8: 1, 9: 1, 10: 1})
        if name == "mixing":
            assert rows(after) == rows(docs)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    check_sequences(packed)
    assert len(set(packed.doc_id.dropna())) == 7 and packed.doc_id.isna().any()
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, no_docs, sf)
        assert empty.count() == 0


def test_twins_with_other_columns(spark, sf):
    """Rows equal in doc_id and text: one stays whole, none is made up."""
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "x", 11), (1, "a b c d e f", "de", "y", 11), (2, "a b c d e f", "fr", "x", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert len(left) == 1 and (left[0].lang, left[0].source) in {("en", "x"), ("de", "y")}


def test_packing_follows_the_mix(spark, sf, tmp_path):
    """Sequences hold the documents in the order of the mix, window by window; another order gives others."""
    mixed = corpus_pipeline.mixing(spark, table(spark, sf, "documents"), sf)
    mixed.write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    order = [i for f in files for i in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    assert len(files) > 1
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    slots = {r.doc_id: r.slot for r in mixing.mix_schedule(docs)[0].collect()}
    assert [slots[i] for i in order] == sorted(slots.values())
    window = 1 << 15
    for ids, rows in ((order, docs), (order[::-1], docs.repartition(3).join(spark.createDataFrame(list(zip(order, range(len(order)))), "doc_id long, nth long"), "doc_id").orderBy(F.desc("nth")).select("doc_id", "text"))):
        if ids is not order:
            rows.coalesce(1).write.parquet(str(tmp_path / "back"))
            rows = spark.read.parquet(str(tmp_path / "back"))
        got = packing.pack_in_order(rows, window=window).toPandas()
        check_sequences(got)
        assert set(got.doc_id) == set(order) and (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.max()).all()
        nth = {d: i for i, d in enumerate(ids)}
        got = got.assign(nth=got.doc_id.map(nth)).sort_values(["nth", "start"])
        at = (got.length + packing.PIECE).cumsum() - got.length - packing.PIECE
        got["window"] = (at // window).clip(upper=max((got.length + packing.PIECE).sum() // window, 1) - 1)
        of = got.groupby("sequence_id").window.agg(["min", "max"])
        assert got.window.nunique() > 3 and (of["min"] == of["max"]).all() and of["min"].is_monotonic_increasing
        assert got.groupby("sequence_id").apply(lambda g: (g.nth.min(), g.start[g.nth == g.nth.min()].min())).groupby(of["min"]).apply(lambda g: g.is_monotonic_increasing).all()
    stage = corpus_pipeline.packing
    one, other = (stage(spark, spark.read.parquet(str(tmp_path / p)), sf).toPandas().set_index(["doc_id", "start"]).sequence_id for p in ("mixed", "back"))
    assert (one.sort_index() != other.sort_index()).any()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_window_places(sizes):
    sequence, offset = packing.place_window(np.array(sizes), 64)
    rows = pd.DataFrame({"sequence_id": sequence, "offset": offset, "length": sizes})
    check_sequences(rows, 64)
    first = rows.reset_index().groupby("sequence_id")["index"].min()
    assert first.is_monotonic_increasing
    histogram = Counter(sizes)
    whole = histogram.pop(64, 0)
    assert len(first) == whole + sum(n for _, n in packing.shortest_pack_first(histogram, 64))
