import zlib
from fractions import Fraction
from hashlib import md5

import numpy as np
import pytest

from hirelake.llm import mixing, sharding
from hirelake.llm.common import table


def jump_one(key: int, shards: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_matches_scalar_form_and_moves_only_into_the_new_shard():
    keys = np.concatenate([np.arange(-50, 2000), [2**62, -(2**63), 2**63 - 1]]).astype(np.int64)
    for n in (1, 2, 16, 17, 100):
        assert sharding.jump_hash(keys, n).tolist() == [jump_one(int(k), n) for k in keys]
    old, new = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert set(new[old != new]) == {16}


def test_op2_digest_against_brute_force(spark, sf):
    got = sharding.op2_sharding(spark, sf).toPandas()
    docs = table(spark, sf, "documents").toPandas()
    assert len(got) == len(docs) and set(got.law) == {"key"}
    by = docs.set_index("doc_id").text
    for r in got.itertuples():
        data = by[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(data) + 1, zlib.crc32(data), jump_one(r.doc_id, 16), jump_one(r.doc_id, 17))
    for _, part in got.groupby("shard"):
        order = part.sort_values("doc_id", key=lambda s: s.map(lambda i: md5(str(i).encode()).hexdigest()))
        assert order.slot.tolist() == list(range(len(part)))


def test_op2_odd_rows(odd_docs, no_docs):
    got = sharding.shard_digest(odd_docs).toPandas()
    assert len(got) == 12
    assert got[got.doc_id.isna()].shard.tolist() == [jump_one(0, 16)] * 2
    assert sorted(got[got.doc_id == 1].slot) == sorted(set(got[got.doc_id == 1].slot)) and len(got[got.doc_id == 1]) == 2
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard_digest(no_docs).count() == 0


def test_write_shards_round_trip(spark, tmp_path):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert sorted(back.doc_id) == list(range(200)) and all(jump_one(r.doc_id, 4) == r.shard for r in back.itertuples())


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 1000, "b": 1, "c": 1}, {f"s{i}": i + 1 for i in range(37)}])
def test_pfair_lag_below_one_block(weights):
    slots = mixing.quantise(weights, 1000)
    assert sum(slots.values()) == 1000 and all(a >= 1 for a in slots.values())
    plan = list(mixing.pfair_period(slots))
    assert [s for _, _, s in plan] == list(range(1000))
    done = dict.fromkeys(slots, 0)
    for source, block, slot in plan:
        assert block == done[source] and block * 1000 // slots[source] <= slot < -(-(block + 1) * 1000 // slots[source])
        done[source] += 1
        for s, a in slots.items():
            assert abs(done[s] - Fraction(a * (slot + 1), 1000)) < 1


def test_too_many_sources():
    with pytest.raises(ValueError):
        mixing.quantise({str(i): 1.0 for i in range(11)}, 10)


def brute_mix(rows, weights, period, block_bytes):
    slots = mixing.quantise(weights, period)
    plan = {(s, j): t for s, j, t in mixing.pfair_period(slots)}
    order = {}
    for doc_id, source, size in rows:
        order.setdefault(source, []).append((md5(str(doc_id).encode()).hexdigest(), doc_id, size))
    blocks, due = {}, {}
    for source, docs in order.items():
        before = 0
        for _, doc_id, size in sorted(docs):
            blocks[doc_id] = before // block_bytes
            before += size
    slot_of = lambda s, b: b // slots[s] * period + plan[s, b % slots[s]]
    horizon = min(slot_of(s, max(blocks[d] for _, d, _ in docs) + 1) for s, docs in order.items() if s in slots)
    for source, docs in order.items():
        for _, doc_id, _ in docs:
            t = slot_of(source, blocks[doc_id]) if source in slots else horizon
            due[doc_id] = t if t < horizon else None
    return due


def test_mix_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.source, len(r.text.encode()) + 1) for r in docs.collect()]
    weights = {s: 1.0 + (i % 3) for i, s in enumerate(sorted({r[1] for r in rows}))}
    weights.popitem()
    want = brute_mix(rows, weights, 100, 2000)
    placed, _ = mixing.mix_schedule(docs, weights=weights, period=100, block_bytes=2000)
    got = {r.doc_id: r.slot for r in placed.collect()}
    assert got == want and None in got.values()
    kept = mixing.mix_documents(docs, weights=weights, period=100, block_bytes=2000)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, t in want.items() if t is not None}


def test_mix_odd_rows(odd_docs, no_docs):
    placed, sources = mixing.mix_schedule(odd_docs)
    got = placed.toPandas()
    assert got.copies.sum() == 12 and set(got.skey) == {"n", "s", "sa", "sb", "sc"}
    assert mixing.mix_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mix_documents(no_docs).count() == 0


def test_op1_covers_all(spark, sf):
    assert mixing.op1_mixing(spark, sf).count() == table(spark, sf, "documents").count()


def test_op1_against_sql(spark):
    from oracle import compare, connect

    sf = "/root/testdata/sf0.1"
    compare(mixing.op1_mixing(spark, sf), connect(sf), mixing.OP1_SQL)


def slow_slots(weights, blocks, period):
    """{(source, block): (epoch, slot)}, slot by slot; a new period whenever a slot's source has run dry."""
    done, out, epoch, turn = dict.fromkeys(blocks, 0), {}, 0, 0
    while left := {s: weights[s] for s in blocks if done[s] < blocks[s]}:
        order = [s for s, _, _ in mixing.pfair_period(mixing.quantise(left, period))]
        slot = 0
        while done[s := order[slot % period]] < blocks[s]:
            out[s, done[s]] = (epoch, turn)
            done[s] += 1
            slot, turn = slot + 1, turn + 1
        epoch += 1
    return out


def test_mix_goes_on_when_a_source_of_one_document_runs_dry(spark):
    rows = [(i, "x" * 999, f"s{i % 3}" if i % 7 else "s0") for i in range(900)] + [(5000, "one", "tiny"), (5001, "no source", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, _ = mixing.mix_schedule(docs, period=100, block_bytes=4000)
    got = placed.toPandas()
    stock = {k: float(b) ** mixing.TEMPERATURE for k, b in got.groupby("skey").bytes.sum().items()}
    want = slow_slots(stock, (got.groupby("skey").block.max() + 1).to_dict(), 100)
    assert [(r.epoch, r.slot) for r in got.itertuples()] == [want[r.skey, r.block] for r in got.itertuples()]
    assert sorted(set(got.slot)) == list(range(got.slot.max() + 1)) and (got.epoch > 0).any()
    kept = mixing.mix_documents(docs, period=100, block_bytes=4000)
    slot_of = got.set_index("doc_id").slot
    slots = [slot_of[r.doc_id] for r in kept.collect()]
    assert kept.columns == docs.columns and len(slots) == len(rows) and slots == sorted(slots)


def test_pipeline_mixing_keeps_every_document(spark):
    import corpus_pipeline

    rows = [(i, f"{i} " * 20_000, f"s{i % 2}") for i in range(120)] + [(500, "one", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.mixing(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows)


def test_more_sources_than_slots_in_a_period(spark):
    rows = [(i % 40, f"{i} " * 30, f"s{i % 37}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_schedule(docs, period=10, block_bytes=300)[0].toPandas()
    assert got.copies.sum() == 400 and got.skey.nunique() == 37 and got.slot.notna().all() and (got.share >= 1).all()
    assert sorted(set(got.slot)) == list(range(got.slot.max() + 1))
    assert sorted((r.doc_id, r.text, r.source) for r in mixing.mix_documents(docs, period=10, block_bytes=300).collect()) == sorted(rows)


def test_lag_of_five_thousand_sources():
    """Each source has a share of its own, and is less than one block away from it at every slot; the
    schedule reaches the end in seconds."""
    import time

    stock = {f"s{i}": float(1 + i % 97) ** 0.7 for i in range(5000)}
    slots = mixing.quantise(stock, 10_000)
    assert sum(slots.values()) == 10_000 and min(slots.values()) >= 1
    done = dict.fromkeys(slots, 0)
    for source, block, slot in mixing.pfair_period(slots):
        assert block == done[source] and block * 10_000 // slots[source] <= slot < -(-(block + 1) * 10_000 // slots[source])
        done[source] += 1
    began = time.process_time()
    spans, places = mixing.epochs(stock, {s: 1 + i % 5 for i, s in enumerate(stock)}, 10_000)
    assert sum(after - first for _, _, first, after, _, _ in spans) == len(places) == sum(1 + i % 5 for i in range(5000))
    assert time.process_time() - began < 120


def test_quantise_gives_back_what_small_sources_take():
    stock = {"big": 1000.0, "bigger": 1500.0, **{f"t{i}": 0.001 for i in range(30)}}
    slots = mixing.quantise(stock, 100)
    assert sum(slots.values()) == 100 and all(slots[f"t{i}"] == 1 for i in range(30)) and (slots["big"], slots["bigger"]) == (25, 45)


def test_op1_gives_every_document_a_slot(spark, tmp_path):
    rows = [(i, f"{i} " * 20_000, f"s{i % 2}") for i in range(120)] + [(500, "one", "tiny")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op1_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.slot is not None for r in got) and max(r.epoch for r in got) > 0
    assert sorted(got) == sorted(mixing.op1_mixing_to_end(spark, str(tmp_path)).collect())


def test_copies_are_cut_and_spread(spark, monkeypatch):
    """Many copies of one row: gapless slots and numbers, in parts of bounded size."""
    from hirelake.llm import common

    monkeypatch.setattr(common, "COPIES", 50)
    docs = spark.range(1234).selectExpr("CASE WHEN id < 1111 THEN 5 ELSE id END AS doc_id", "CASE WHEN id < 1111 THEN 'same' ELSE 'other' END AS text", "'s' AS source")
    got = sharding.shard_digest(docs).toPandas()
    assert len(got) == 1234 and (got.doc_id == 5).sum() == 1111 and got[got.doc_id == 5].shard.nunique() == 1
    for _, mine in got.groupby("shard"):
        assert sorted(mine.slot) == list(range(len(mine)))
    counted = spark.createDataFrame([(1, "x", 120), (2, "y", 50), (3, "z", 1)], "first int, part string, copies long")
    assert common.cut_copies(counted.withColumnRenamed("part", "okey")).toPandas().copies.max() <= 50
    spread = common.spread_copies(counted).toPandas()
    assert sorted(spread[spread["first"] == 1]["copy"]) == list(range(1, 121)) and len(spread) == 171
