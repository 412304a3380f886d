import numpy as np
import pytest

from hirelake.llm import whitening
from hirelake.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, component int, x string"


def brute(ids, vectors):
    """{(id, component): ...} by whole numbers and a symmetric eigendecomposition."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    far = [[n * row[j] - sums[j] for j in range(d)] for row in x]
    deviation = [sum(f * f for f in row) for row in far]
    centred = np.array([[f / n for f in row] for row in far])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], vectors_[:, ::-1], sum(deviation)


def check(got, ids, vectors, k):
    n, deviation, centred, values, axes, total = brute(ids, vectors)
    assert len(got) == n * k and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] <= 1e-4
    for i in range(k):
        one = got[got.component == i + 1].sort_values(["vec_id", "whitened"])
        assert np.allclose(one.explained, values[i] / (total / n**3), rtol=1e-9)
        want = centred @ axes[:, i] / np.sqrt(values[i])
        whitened = one.set_index("vec_id").loc[ids].whitened.to_numpy()
        assert min(np.abs(whitened - want).max(), np.abs(whitened + want).max()) < 1e-8
        assert one.set_index("vec_id").loc[ids].deviation.tolist() == deviation


def test_op12_against_brute_force(spark, sf):
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    check(whitening.op12_whitening(spark, sf).toPandas(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_few_dimensions_and_a_small_variance(spark):
    """Components whose variances differ by ten powers, far from zero: centred before multiplying."""
    rng = np.random.default_rng(2)
    v = np.column_stack([rng.normal(5e4, 2e4, 300), rng.normal(-3e4, 0.5, 300), rng.normal(0, 3, 300)]).astype(np.float32)
    got = whitening.whiten(spark.createDataFrame([(i, row.tolist(), 1, "") for i, row in enumerate(v)], SCHEMA)).toPandas()
    check(got, list(range(300)), v, 3)


def test_deviations_beyond_64_bits_are_exact():
    centre = whitening.Centre(3, (10, 20), (1, 2), 1 << 60)
    x = np.array([[10 + (1 << 60), 20]], np.int64)
    far = centre.deviations(x)
    assert far.tolist() == [[3 * (1 << 60) - 1, -2]] and int((far * far).sum()) == (3 * (1 << 60) - 1) ** 2 + 4
    assert whitening.Centre(3, (10, 20), (1, 2), 5).deviations(np.array([[11, 25]])).dtype == np.int64


def test_huge_entries_have_no_deviation_but_a_result(spark):
    rows = [(i, [float(i) * 1e9, float(i * i % 7)], 0, "") for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) in (20, 40) and got.whitened.notna().all() and got.identity_error.iloc[0] <= 1e-4
    huge = whitening.whiten(spark.createDataFrame([(i, [3e38 * (-1) ** i, 1.0], 0, "") for i in range(4)], SCHEMA)).toPandas()
    assert huge.deviation.isna().all() and np.allclose(huge[huge.component == 1].whitened.abs(), 1)


def test_odd_vectors(spark):
    good = [[1.0, 2.0], [2.0, 0.5], [0.0, 0.0], [1.0, 2.0], [3.5, -1.0]]
    bad = [None, [], [1.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(i if i else None, v, 7, "z") for i, v in enumerate(good)] + [(100 + i, v, 7, "z") for i, v in enumerate(bad)] + [(1, good[1], 7, "z")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert set(got.n) == {6} and len(got) == 12 and got.vec_id.isna().sum() == 2 and (got.vec_id == 1).sum() == 4
    assert got[got.vec_id == 1].groupby("component").whitened.nunique().tolist() == [1, 1]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_tables_without_variance(spark, rows):
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance_do_not_exist(spark):
    got = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0, "") for i in range(9)], SCHEMA)).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1)
