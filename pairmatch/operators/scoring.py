"""Pair scorers: training, scoring in batches and evaluation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairmatch.functions.arrow import to_matrix
from pairmatch.lineage import scratch_path
from pairmatch.operators.bucketwise import BlockScorer, RowScorer

PREDICT_BATCH = 400
# Fixed value: how far predictions are kept from 0 and 1 in the logarithm
EPSILON = 1e-7
CELLS_IN_CACHE = 1 << 14


def pair_features(a: Column, b: Column) -> Column:
    """|a - b| followed by a * b, element by element."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    shared = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.concat(apart, shared)


@dataclass(frozen=True)
class SegmentDistances:
    """See ``segment_distances``."""

    parts: int

    def __call__(self, a: Column, b: Column) -> Column:
        # one element that holds the differences, so that they are computed once and not for every stretch
        apart = F.array(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
        sums = F.flatten(
            F.transform(
                apart,
                lambda held: F.transform(
                    F.sequence(F.lit(0), F.lit(self.parts - 1)),
                    lambda i: F.aggregate(
                        F.slice(
                            held, (i * F.size(held) / self.parts).cast("int") + 1, (F.size(held) / self.parts).cast("int")
                        ),
                        F.lit(0.0),
                        lambda total, v: total + v,
                    ),
                ),
            )
        )
        return F.when(a.isNotNull() & b.isNotNull(), sums)

    def sums(self, a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
        """The same, stretch by stretch and added up in the same order, from the elements of many vectors."""
        for i in range(self.parts):
            begin, length = i * len(a) // self.parts, len(a) // self.parts
            total = np.zeros(np.broadcast_shapes(a[0].shape, b[0].shape))
            for x, y in zip(a[begin : begin + length], b[begin : begin + length], strict=True):
                apart = x - y
                total += np.abs(apart, out=apart)
            yield total


def segment_distances(parts: int) -> SegmentDistances:
    """Features for long vectors: the sum of |a - b| over each of ``parts`` stretches of equal length."""
    return SegmentDistances(parts)


@dataclass(frozen=True)
class PairScorer(BlockScorer):
    """A logistic model of pair features: the intercept and one weight per feature.

    With features that have ``sums``, it also scores block against block.
    """

    weights: tuple[float, ...]
    features: Callable[[Column, Column], Column]

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Adds ``score``, the probability of a positive pair; null if a vector is."""
        terms = F.zip_with(
            F.concat(F.array(F.lit(1.0)), self.features(F.col("query_vec"), F.col("cand_vec"))),
            F.array(*[F.lit(w) for w in self.weights]),
            lambda x, w: x * w,
        )
        return pairs.withColumn("score", 1 / (1 + F.exp(-F.aggregate(terms, F.lit(0.0), lambda total, v: total + v))))

    @property
    def works_on_tiles(self) -> bool:
        return hasattr(self.features, "sums")

    def _probability(self, a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
        shape = np.broadcast_shapes(a[0].shape, b[0].shape)
        if len(self.weights) != self.features.parts + 1:
            # as in the expression, features without a weight give no score
            return np.full(shape, np.nan)
        total = np.full(shape, self.weights[0])
        for weight, feature in zip(self.weights[1:], self.features.sums(a, b), strict=True):
            total += feature * weight
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-total))

    def rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._probability(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T))

    def tile(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        # element by element as in ``rows``; a last digit may differ.  A few rows at a time stay in the cache
        columns, step = np.ascontiguousarray(b.T)[:, None, :], max(1, CELLS_IN_CACHE // len(b))
        places = np.empty((len(a), len(b)))
        for at in range(0, len(a), step):
            few = np.ascontiguousarray(a[at : at + step].T)[:, :, None]
            np.negative(self._probability(few, columns), out=places[at : at + step])
        return places, 1e-15

    def places(self, scores: np.ndarray) -> np.ndarray:
        return -scores


_FAN = 16
MOST_FEATURES = 1_024


def _sums(at: np.ndarray):
    """Task function: loss, gradient and Hessian of all rows of the task, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(at)
        total = np.zeros(2 + d + d * d)
        for batch in batches:
            rows, _ = to_matrix(batch.column("features"), d - 1)
            x = np.column_stack([np.ones(len(rows)), rows])
            y = batch.column("label").to_numpy()
            z = x @ at
            p = 1 / (1 + np.exp(-z))
            total[0] += len(y)
            total[1] += (np.logaddexp(0, z) - y * z).sum()
            total[2 : 2 + d] += x.T @ (y - p)
            total[2 + d :] += ((x.T * (p * (1 - p))) @ x).ravel()
        slot = TaskContext.get().partitionId() % _FAN
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, sums in zip(batch.column("slot").to_pylist(), batch.column("sums"), strict=True):
            own = np.frombuffer(sums.as_buffer())
            held[slot] = held[slot] + own if slot in held else own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["slot", "sums"]
    )


def newton_steps(rows: DataFrame, n_features: int, reg: float, max_iter: int = 50, tol: float = 1e-9) -> np.ndarray:
    """Weights, the intercept first, that minimise the mean log loss plus reg / 2 times their squared length.

    rows: (features, label), labels between 0 and 1.  The penalty makes the optimum unique.  Each step is one job: every task
    sums up its rows, the sums of all tasks are added up in ``_FAN`` groups, and as many rows reach the driver.  A step
    that doesn't lower the loss is halved.
    """
    d = n_features + 1
    at, best, gained = np.zeros(d), np.inf, np.zeros(d)
    for _ in range(max_iter):
        parts = (
            rows.mapInArrow(_sums(at), "slot int, sums binary")
            .repartition(_FAN, "slot")
            .mapInArrow(_added, "slot int, sums binary")
            .collect()
        )
        if not parts:
            return at
        total = np.sum([np.frombuffer(r["sums"]) for r in sorted(parts, key=lambda r: r["slot"])], axis=0)
        n = total[0]
        if not n:
            return at
        loss = total[1] / n + reg / 2 * at @ at
        if loss > best + 1e-12:
            gained = gained / 2
            at = at - gained
            continue
        best = loss
        gradient = total[2 : 2 + d] / n - reg * at
        hessian = total[2 + d :].reshape(d, d) / n + reg * np.eye(d)
        gained = np.linalg.solve(hessian, gradient)
        if np.abs(gained).max() < tol:
            return at + gained
        at = at + gained
    return at


def train_pair_scorer(
    pairs: DataFrame,
    binary_only: bool = True,
    features: Callable[[Column, Column], Column] = pair_features,
    reg: float = 0.01,
    max_iter: int = 50,
) -> PairScorer:
    """Logistic regression on pair features; pairs carry label, query_vec and cand_vec.

    Labels between 0 and 1 are dropped, or pull the score towards themselves.  Pairs without a label, or without all
    elements of both vectors, don't count, and without any pair all weights are 0.  Features are computed once, into a table in the shared folder.
    """
    label = F.col("label").cast("double")
    rows = pairs.select(features(F.col("query_vec"), F.col("cand_vec")).alias("features"), label.alias("label"))
    whole = ~F.exists("features", lambda v: v.isNull() | F.isnan(v))
    rows = rows.where(F.col("features").isNotNull() & whole & F.col("label").between(0, 1))
    if binary_only:
        rows = rows.where(F.col("label").isin(0.0, 1.0))
    path = scratch_path(pairs.sparkSession, "features")
    rows.write.parquet(path)
    rows = pairs.sparkSession.read.schema(rows.schema).parquet(path)
    sizes = rows.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if sizes[0] is None:
        return PairScorer((0.0,), features)
    if sizes[0] != sizes[1] or sizes[1] > MOST_FEATURES:
        raise ValueError(f"pairs need the same number of features, {MOST_FEATURES} at most")
    return PairScorer(tuple(float(w) for w in newton_steps(rows, sizes[1], reg, max_iter)), features)


def apply_pair_scorer(pairs: DataFrame, model: PairScorer) -> DataFrame:
    """Adds ``score``, the probability of a positive pair."""
    return model(pairs)


def score_pairs(
    pairs: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    dim: int,
    batch_size: int = PREDICT_BATCH,
) -> DataFrame:
    """Adds ``score`` from any model over the two vectors of each pair, batch by batch.

    ``make_predict`` loads the model once per Python worker and returns a function from two
    [n, dim] matrices to n scores.
    """
    predict = predict_batch_udf(
        make_predict,
        return_type=DoubleType(),
        batch_size=batch_size,
        input_tensor_shapes=[[dim], [dim]],
    )
    return pairs.withColumn("score", predict("query_vec", "cand_vec"))


@dataclass(frozen=True)
class PairModel(RowScorer):
    """``score_pairs`` as the scorer of a retrieval: the same model, also over pairs inside a bucket, without a table of them.

    Every pair goes through the model, in batches of at most ``batch_size``, and the model is loaded once per Python worker.
    """

    make_predict: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]
    dim: int
    batch_size: int = PREDICT_BATCH
    _name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def rows_at_once(self) -> int:
        return self.batch_size

    def rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if a.shape[1:] != (self.dim,) or b.shape[1:] != (self.dim,):
            raise ValueError(f"every vector must have {self.dim} elements")
        predict = ModelCache.get(self._name)
        if predict is None:
            predict = self.make_predict()
            ModelCache.add(self._name, predict)
        found = np.empty(len(a))
        for at in range(0, len(a), self.batch_size):
            few = slice(at, at + self.batch_size)
            scores = np.asarray(predict(a[few], b[few]), dtype=np.float64)
            if scores.size != len(a[few]):
                raise ValueError("a model gives one score for each pair")
            found[few] = scores.reshape(-1)
        return found

    def __call__(self, pairs: DataFrame) -> DataFrame:
        doubles = pairs.withColumns({c: F.col(c).cast("array<double>") for c in ("query_vec", "cand_vec")})
        return score_pairs(doubles, self.make_predict, self.dim, self.batch_size)


def evaluate_pairs(scored: DataFrame, by: str | None = "batch", loss_scale: float = 1.0) -> DataFrame:
    """Loss, accuracy, mean absolute and scaled squared error, per batch or over all."""
    label = F.col("label")
    kept = F.least(F.greatest(F.col("score"), F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    loss = -(label * F.log(kept) + (1.0 - label) * F.log(1.0 - kept))
    error = F.col("score") - label
    groups = [by] if by else []
    return scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(loss).alias("loss"),
        F.avg(F.when(F.rint("score") == label, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(float(loss_scale)) * F.avg(error * error)).alias("scaled_mse"),
    )
