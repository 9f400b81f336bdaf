"""Scaled dense networks: a saved stage that scores raw features, and training by mini-batch Adam.

A network without hidden layer is a logistic regression, so one stage holds either
model together with the population scaling of its training rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlines.operators import models as ML
from planlines.session import fanout_partitions, scratch_path

#: Rows of a mini-batch at least, and mini-batches of an epoch at most: a step is one pass over a batch.
BATCH_ROWS, MAX_BATCHES = 200, 8
#: One row in so many is held out and decides the stop.
HELD_OUT = 10
PENALTY, RATE, DECAY = 1e-4, 1e-3, (0.9, 0.999)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


@dataclass
class Layers:
    """Weights of a network as one flat vector; ReLU between the layers, one logit at the end."""

    sizes: list[int]
    flat: np.ndarray

    @classmethod
    def start(cls, sizes: list[int], seed: int) -> Layers:
        """Weights and biases uniform within sqrt(6 / (inputs + outputs)); sqrt(2 / ...) for the last layer."""
        rng = np.random.default_rng(seed)
        parts = []
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            bound = math.sqrt((2.0 if i == len(sizes) - 2 else 6.0) / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return cls(sizes, np.concatenate(parts))

    def split(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        layers = self.split(self.flat)
        for i, (w, b) in enumerate(layers):
            x = x @ w + b
            if i < len(layers) - 1:
                x = np.maximum(x, 0.0)
        return _sigmoid(x[:, 0])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient and value of the summed log loss over some rows, without the penalty."""
        layers, seen = self.split(self.flat), [x]
        for i, (w, b) in enumerate(layers):
            z = seen[-1] @ w + b
            seen.append(np.maximum(z, 0.0) if i < len(layers) - 1 else z)
        z = seen.pop()[:, 0]
        loss = float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum())
        back, parts = (_sigmoid(z) - y)[:, None], []
        for (w, _), inputs in zip(reversed(layers), reversed(seen)):
            parts += [back.sum(axis=0), (inputs.T @ back).ravel()]
            back = (back @ w.T) * (inputs > 0)
        return np.concatenate(parts[::-1]), loss

    def penalty(self) -> np.ndarray:
        """Gradient of half the squared weights; biases go free."""
        out, at = np.zeros_like(self.flat), 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out[at : at + a * b] = self.flat[at : at + a * b]
            at += a * b + b
        return out


class Adam:
    def __init__(self, size: int, rate: float = RATE):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = DECAY[0] * self.m + (1 - DECAY[0]) * gradient
        self.v = DECAY[1] * self.v + (1 - DECAY[1]) * gradient * gradient
        rate = self.rate * math.sqrt(1 - DECAY[1] ** self.t) / (1 - DECAY[0] ** self.t)
        return -rate * self.m / (np.sqrt(self.v) + 1e-8)


class Stopper:
    """Keeps the weights of the best held-out accuracy; done after ``patience`` epochs in a row that gain no more than ``tol``."""

    def __init__(self, patience: int = 10, tol: float = 1e-4):
        self.patience, self.tol, self.best, self.flat, self.idle = patience, tol, -math.inf, None, 0

    def done(self, accuracy: float, flat: np.ndarray) -> bool:
        self.idle = 0 if accuracy > self.best + self.tol else self.idle + 1
        if accuracy > self.best:
            self.best, self.flat = accuracy, flat.copy()
        return self.idle >= self.patience


class ScaledNetwork(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """P(class 1) of raw features: (v - mean) / scale, then the layers. Saved and loaded as any ML stage."""

    sizes = Param(Params._dummy(), "sizes", "width of each layer, the features first", typeConverter=TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "weights and biases layer by layer", typeConverter=TypeConverters.toListFloat)
    mean = Param(Params._dummy(), "mean", "mean of each feature in training", typeConverter=TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "population deviation of each feature, 1 where it is constant", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="p", sizes=None, weights=None, mean=None, scale=None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="p")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers = Layers(self.getOrDefault(self.sizes), np.array(self.getOrDefault(self.weights)))
        mean, scale = np.array(self.getOrDefault(self.mean)), np.array(self.getOrDefault(self.scale))

        @F.pandas_udf("double")
        def p(features: pd.Series) -> pd.Series:
            known = features.notna()
            out = pd.Series(np.nan, index=features.index)
            if known.any():
                out[known] = layers.probability((np.stack(features[known].to_numpy()) - mean) / scale)
            return out.where(known, None)

        return dataset.withColumn(self.getPredictionCol(), p(F.col(self.getFeaturesCol()).cast("array<double>")))


def _scaling(train: DataFrame, features: str) -> tuple[list[float], list[float]]:
    stats = ML.collect_stats(train, features)
    return [float(m) for m, _ in stats], [float(s) if s else 1.0 for _, s in stats]


def logistic(train: DataFrame, features: str, label: str) -> ScaledNetwork | None:
    """Balanced logistic regression on scaled features as a stage for raw ones; None without both classes."""
    n = [train.filter(F.col(label) == v).count() for v in (True, False)]
    if not all(n):
        return None
    mean, scale = _scaling(train, features)
    model = ML.fit_logreg(ML.vectorize(train, features, list(zip(mean, scale))), label, sum(n))
    weights = [*model.coefficients.toArray().tolist(), float(model.intercept)]
    return ScaledNetwork(featuresCol=features, sizes=[len(mean), 1], weights=weights, mean=mean, scale=scale)


def batches_of(n: int) -> int:
    return int(min(MAX_BATCHES, max(1, n // BATCH_ROWS)))


def roles(ident: str, n_batches: int):
    """-1 for a held-out row, else its mini-batch: by hashes of its id, alike in every run."""
    key = F.xxhash64(F.col(ident).cast("string"))
    return F.when(F.pmod(key, F.lit(HELD_OUT)) == 0, -1).otherwise(F.pmod(F.shiftright(key, 8), F.lit(n_batches)).cast("int"))


def network(
    train: DataFrame, features: str, label: str, ident: str, hidden: int = 64, max_epochs: int = 200, seed: int = 0
) -> ScaledNetwork | None:
    """One hidden ReLU layer by mini-batch Adam with early stopping, as a stage for raw features; None without both classes.

    Rows are written once, scaled and laid out by mini-batch, so a step reads its
    batch alone. Tasks return one gradient each and the driver adds them in task
    order; it holds weights and moments only. An epoch takes each batch once, in an
    order of the seed's, and is judged by the accuracy on the held-out tenth: training
    ends after ten epochs without a gain and keeps the best weights. Batches grow with
    the rows, so an epoch is at most MAX_BATCHES + 1 small jobs at any size.
    """
    both = train.agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")).first()
    if not both["pos"] or not both["neg"]:
        return None
    spark, n = train.sparkSession, both["pos"] + both["neg"]
    mean, scale = _scaling(train, features)
    n_batches = batches_of(n)
    scaled = ML.standardize(train, features, list(zip(mean, scale)), "x")
    path = scratch_path(spark, "batches")
    laid = scaled.select("x", F.col(label).cast("double").alias("y"), roles(ident, n_batches).alias("role"), F.xxhash64(F.col(ident).cast("string")).alias("key"))
    files = max(1, n // (n_batches * 100_000))
    spread = laid.repartition(fanout_partitions(spark), "role", F.pmod("key", F.lit(files))).sortWithinPartitions("role", "key")
    spread.write.partitionBy("role").parquet(path)
    table = spark.read.schema("x array<double>, y double, key long, role int").parquet(path)
    layers = Layers.start([len(mean), hidden, 1], seed)
    adam, stopper, rng = Adam(len(layers.flat)), Stopper(), np.random.default_rng(seed)
    for _ in range(max_epochs):
        for b in rng.permutation(n_batches):
            gradient, rows = _added(table.filter(F.col("role") == int(b)), layers, _gradients)
            if rows:
                layers.flat = layers.flat + adam.step((gradient[:-1] + PENALTY * layers.penalty()) / rows)
        right, rows = _added(table.filter("role = -1"), layers, _hits)
        if stopper.done(right[0] / rows if rows else 0.0, layers.flat):
            break
    else:
        warnings.warn(f"the network stopped after {max_epochs} epochs without settling", stacklevel=2)
    return ScaledNetwork(featuresCol=features, sizes=layers.sizes, weights=stopper.flat.tolist(), mean=mean, scale=scale)


def _gradients(layers: Layers, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    g, loss = layers.gradient(x, y)
    return np.append(g, loss)


def _hits(layers: Layers, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.array([float(((layers.probability(x) >= 0.5) == (y > 0.5)).sum())])


def _added(rows: DataFrame, layers: Layers, work) -> tuple[np.ndarray, int]:
    """What ``work`` gives over all rows, and their number: one small row for each task, added in task order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total, n = total + work(layers, x, batch.column("y").to_numpy(zero_copy_only=False)), n + batch.num_rows
        if n:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = sorted(rows.select("x", "y").mapInArrow(run, "part int, n long, sums binary").collect())
    return sum((np.frombuffer(p["sums"]) for p in parts), np.zeros(1)), sum(p["n"] for p in parts)


# --- model choice and artifact ------------------------------------------------

META = "model string, auc_train double, auc_valid double, n_features long, train_splits array<string>, n_train long, n_valid long"


def candidates(
    train: DataFrame, valid: DataFrame, features: str, label: str, ident: str, names: tuple[str, ...] = ("logreg", "mlp")
) -> tuple[list[tuple[str, float | None, float | None]], tuple[str, ScaledNetwork] | None]:
    """Fit the named models on raw features: ``(name, auc_train, auc_valid)`` of each, and the one of highest validation AUC.

    The first wins ties. An AUC is None where a class is missing; without any
    validation AUC nothing is chosen.
    """
    fit = {"logreg": lambda: logistic(train, features, label), "mlp": lambda: network(train, features, label, ident)}
    models = {name: fit[name]() for name in names}
    results = [
        (name, *(ML.auc_of(m.transform(rows), label) if m else None for rows in (train, valid))) for name, m in models.items()
    ]
    ranked = [(-auc, at, name) for at, (name, _, auc) in enumerate(results) if auc is not None]
    return results, (min(ranked)[2], models[min(ranked)[2]]) if ranked else None


def save(path: str, model: ScaledNetwork, meta: DataFrame) -> None:
    """The artifact: an ML pipeline that takes raw features, and one row about it."""
    PipelineModel([model]).write().save(f"{path}/pipeline")
    meta.write.json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/pipeline"), spark.read.schema(META).json(f"{path}/meta")
