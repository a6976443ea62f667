"""Kernelized locality-sensitive hashing of vector columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.functions.names import number_of_str
from pairmatch.operators.hashing import HashModel

# the sample and its p x p kernel are the only things the driver ever holds
MAX_SAMPLE = 2000
# eigenvalues up to this size stay as they are instead of being inverted (fixed value)
SMALL_EIGENVALUE = 1e-8


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their id: the same rows on every run.

    A top-n, so every task keeps n rows at most and nothing is sorted as a whole.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))
    return df.orderBy(draw, F.col(id_col)).limit(n)


def rbf_kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - y|^2) for all rows of x against all rows of y."""
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.exp(-gamma * np.maximum(squared, 0.0))


def center_kernel(k: np.ndarray, column_means: np.ndarray, grand_mean: float) -> np.ndarray:
    """Center kernel rows in feature space with the means of the sample's kernel."""
    return k - column_means[None, :] - k.mean(axis=1, keepdims=True) + grand_mean


def inverse_sqrt(k: np.ndarray) -> np.ndarray:
    """Symmetric matrix to the power -1/2; tiny eigenvalues are kept unchanged."""
    values, vectors = np.linalg.eigh(k)
    powered = np.where(values > SMALL_EIGENVALUE, np.abs(values) ** -0.5, values)
    return (vectors * powered) @ vectors.T


@dataclass(frozen=True)
class KLSHModel(HashModel):
    """Everything needed to hash a vector: sample, kernel means and weights."""

    sample: np.ndarray
    weights: np.ndarray
    column_means: np.ndarray
    grand_mean: float
    gamma: float

    @property
    def bits(self) -> int:
        return self.weights.shape[1]

    @property
    def dim(self) -> int:
        return self.sample.shape[1]

    def raw_kernel(self, x: np.ndarray) -> np.ndarray:
        return rbf_kernel(x, self.sample, self.gamma)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Centered kernel of vectors against the sample."""
        return center_kernel(self.raw_kernel(x), self.column_means, self.grand_mean)

    def kernel_rows(self, df: DataFrame, vec: str = "vec", centered: bool = True) -> DataFrame:
        """Adds ``kernel``: each vector's kernel with every sample row."""
        method = "kernel" if centered else "raw_kernel"
        return df.withColumn("kernel", self._rows_of(df, vec, method, T.DoubleType(), pa.float64()))

    def hash_bits(self, x: np.ndarray) -> np.ndarray:
        return (self.kernel(x) @ self.weights > 0).astype(np.int8)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as a one-row parquet table."""
        row = (
            self.sample.shape[0],
            self.dim,
            self.bits,
            float(self.gamma),
            float(self.grand_mean),
            self.column_means.tolist(),
            self.sample.ravel().tolist(),
            self.weights.ravel().tolist(),
        )
        spark.createDataFrame([row], _MODEL_SCHEMA).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> KLSHModel:
        row = spark.read.schema(_MODEL_SCHEMA).parquet(path).first()
        return KLSHModel(
            np.array(row.sample).reshape(row.p, row.d),
            np.array(row.weights).reshape(row.p, row.b),
            np.array(row.column_means),
            row.grand_mean,
            row.gamma,
        )


_MODEL_SCHEMA = (
    "p int, d int, b int, gamma double, grand_mean double, "
    "column_means array<double>, sample array<double>, weights array<double>"
)


@dataclass(frozen=True)
class KLSH:
    """``p`` sampled rows, ``t`` of them per hyperplane, ``b`` hyperplanes."""

    p: int = 300
    t: int = 30
    b: int = 300
    seed: int = 0
    gamma: float | None = None

    def picks(self) -> np.ndarray:
        """[b, t] sample rows summed in each hyperplane, drawn with replacement."""
        return np.array(
            [
                [number_of_str(f"{self.seed}-pick-{bit}-{k}") % self.p for k in range(self.t)]
                for bit in range(self.b)
            ]
        )

    def fit(self, df: DataFrame, id_col: str = "id", vec: str = "vec") -> KLSHModel:
        if self.p > MAX_SAMPLE:
            raise ValueError(f"p must be at most {MAX_SAMPLE}")
        rows = sample_rows(
            df.select(id_col, vec).where(F.col(vec).isNotNull()), id_col, self.p, self.seed
        ).collect()
        if len(rows) < self.p:
            raise ValueError(f"only {len(rows)} vectors for a sample of {self.p}")
        return self.fit_sample(np.array([row[vec] for row in rows], dtype=np.float64))

    def fit_sample(self, sample: np.ndarray) -> KLSHModel:
        """The weights for a given sample: p x p algebra on the driver."""
        gamma = 1.0 / sample.shape[1] if self.gamma is None else self.gamma
        kernel = rbf_kernel(sample, sample, gamma)
        column_means, grand_mean = kernel.mean(axis=0), float(kernel.mean())
        root = inverse_sqrt(center_kernel(kernel, column_means, grand_mean))
        # a row drawn twice for the same hyperplane counts once
        chosen = np.zeros((self.p, self.b))
        chosen[self.picks(), np.arange(self.b)[:, None]] = 1.0
        return KLSHModel(sample, root @ chosen, column_means, grand_mean, gamma)
