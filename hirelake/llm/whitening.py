"""Whitening of embeddings by a distributed singular value decomposition.

Entries become whole numbers x = floor(64 c) + 1000000, so that sums and deviations are exact. The
fit list is every usable vector. Rows are centred exactly before anything is multiplied: with
q = floor(S/n) and r = S - n q per dimension, n x - S = n (x - q) - r holds in whole numbers, and its
double divided by n is the centred entry; the large common offset never meets a product of doubles.

1. One aggregate gives n and, per dimension, the sum and the range (d rows reach the driver).
2. MLlib's ``RowMatrix.computeSVD`` on the centred rows, asked for all d components: below 15,000
   dimensions it then forms the d x d Gramian on the executors and decomposes it by LAPACK, to double
   precision. (Asked for few of many components it iterates to a tolerance of 1e-10.) A singular value
   s gives the eigenvalue s*s/n.
3. Whitened rows: centred rows times the components over the roots of their eigenvalues, in Arrow
   batches, one matrix product a batch.
4. The total variance is the exact sum of all deviations over n**3, apart from the decomposition;
   the identity error comes from MLlib's covariance of the whitened rows, rescaled to divisor n.

Only tables of d or d x d numbers reach the driver or travel with tasks; rows never do.

Defined cases: vectors that are null or hold a null, NaN or infinite entry are left out, and so are
vectors whose length isn't the commonest one (ties: the longer); entries beyond 2**56 in size count as 2**56;
a deviation beyond 64 bits is null, the total stays exact up to 38 digits; components without
variance (eigenvalue at most 1e-13 of the largest) don't exist, so a table of equal vectors, or an
empty one, has no rows; repeated rows and null ids count and are returned each; ties among
eigenvalues come in LAPACK's order; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, table

SCALE, OFFSET, LIMIT = 64, 1_000_000, float(1 << 62)
COMPONENTS = 32
#: Eigenvalues up to this share of the largest one are rounding.
LEAST_SHARE = 1e-13


def whole_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, x) of the usable vectors of the commonest length."""
    c = F.col(vector)
    usable = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(c, lambda e: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), e.cast("double") * SCALE))) + OFFSET)
    rows = materialise(df.where(usable).select(F.col(key).cast("long").alias("id"), x.alias("x")), "vectors")
    commonest = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (commonest.d if commonest else 0))


@dataclass(frozen=True)
class Centre:
    """n and, per dimension, q = floor(S/n), r = S - n q and the largest distance of an x from q."""

    n: int
    q: tuple[int, ...]
    r: tuple[int, ...]
    reach: int

    @staticmethod
    def of(rows: DataFrame) -> Centre:
        per = rows.select(F.posexplode("x").alias("i", "e")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e").cast("decimal(20,0)")).alias("s"), F.min("e").alias("low"), F.max("e").alias("high"))
        found = per.orderBy("i").collect()
        n = found[0].n if found else 0
        q = tuple(int(f.s) // n for f in found)
        r = tuple(int(f.s) - n * low for f, low in zip(found, q, strict=True))
        reach = max((max(f.high - low, low - f.low) for f, low in zip(found, q, strict=True)), default=0)
        return Centre(n, q, r, int(reach))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 where squares of it add up within 63 bits, else Python ints."""
        if len(self.q) * (self.n * (self.reach + 1)) ** 2 < 1 << 63:
            return self.n * (x - np.array(self.q, np.int64)) - np.array(self.r, np.int64)
        return self.n * (x.astype(object) - np.array(self.q, object)) - np.array(self.r, object)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(rows: DataFrame, centre: Centre) -> DataFrame:
    """(id, deviation, x): exact squared deviation and the centred row as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = centre.deviations(_matrix(batch.column(1)))
                total = (far * far).sum(axis=1)
                if total.dtype == object:
                    total = pa.array([t if t < 10**38 else None for t in total], pa.decimal128(38, 0))
                else:
                    total = pa.array(total).cast(pa.decimal128(38, 0))
                flat = (far / centre.n).astype(np.float64).ravel()
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, far.shape[1], np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), total, x], names=["id", "deviation", "x"])

    return rows.mapInArrow(run, "id long, deviation decimal(38,0), x array<double>")


def row_matrix(rows: DataFrame, column: str, n: int, d: int) -> RowMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, d)


@dataclass(frozen=True)
class Whitening:
    """Components (columns), their eigenvalues and the exact total variance of the fit list."""

    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float

    @staticmethod
    def fit(rows: DataFrame, centre: Centre, k: int = COMPONENTS) -> Whitening:
        """From ``rows`` of :func:`centred`."""
        d = len(centre.q)
        total = rows.agg(F.sum("deviation").alias("t")).first().t if d else None
        if not total:
            return Whitening(np.zeros((d, 0)), np.zeros(0), 0.0)
        svd = row_matrix(rows, "x", centre.n, d).computeSVD(d, False)
        values = svd.s.toArray() ** 2 / centre.n
        keep = min(k, int((values > LEAST_SHARE * values[0]).sum()))
        return Whitening(svd.V.toArray()[:, :keep], values[:keep], int(total) / centre.n**3)

    def apply(self, rows: DataFrame) -> DataFrame:
        """(id, deviation, w): the rows in units of the components' standard deviations."""
        weights = self.components / np.sqrt(self.eigenvalues)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    flat = np.einsum("ij,jk->ik", _matrix(batch.column(2)), weights).ravel()  # the same for equal rows, unlike a blocked product
                    w = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, weights.shape[1], np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), w], names=["id", "deviation", "w"])

        return rows.mapInArrow(run, "id long, deviation decimal(38,0), w array<double>")


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance (divisor n) minus the identity."""
    if n < 2:
        return 0.0
    covariance = row_matrix(rows, "w", n, k).computeCovariance().toArray() * ((n - 1) / n)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector
    and component."""
    rows = whole_vectors(df, vector, key)
    centre = Centre.of(rows)
    rows = centred(rows, centre)
    fit = Whitening.fit(rows, centre, k)
    found = len(fit.eigenvalues)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not found:
        return df.sparkSession.createDataFrame([], out)
    white = materialise(fit.apply(rows), "whitened")
    error = identity_error(white, centre.n, found)
    share = F.array(*[F.lit(float(e / fit.variance)) for e in fit.eigenvalues])
    return white.select("id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
