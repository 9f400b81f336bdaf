"""Cluster rates and artifacts, sampling, scaling and logistic regression of symbols."""

from __future__ import annotations

import warnings

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.operators.ranking import roc_auc
from planlines.operators.symbols import cluster_category


def _settled(name: str, rounds: int, most: int) -> None:
    if rounds >= most:
        warnings.warn(f"{name} stopped after {most} rounds without settling", stacklevel=3)


def cluster_near_rate(labelled: DataFrame, cluster: str, all_clusters: DataFrame) -> DataFrame:
    """Members and P(near) of every cluster; empty clusters give 0, unknown labels do not count."""
    rates = labelled.filter("near_gt is not null").groupBy(cluster).agg(
        F.count("*").alias("n_members"), F.avg(F.col("near_gt").cast("int")).alias("p_near")
    )
    full = all_clusters.join(rates, cluster, "left")
    return full.select(cluster, F.coalesce("n_members", F.lit(0).cast("long")).alias("n_members"),
                       F.coalesce("p_near", F.lit(0.0)).alias("p_near"))


def categorize(rates: DataFrame, high: float = 0.7, low: float = 0.2) -> DataFrame:
    return rates.withColumn("category", cluster_category(F.col("p_near"), high, low))


def write_cluster_artifact(centroids, clusters: DataFrame, path: str, high: float = 0.7, low: float = 0.2) -> None:
    """JSON records of k-means clusters: centroid, rate, category and thresholds of each."""
    centres = [(i, [float(v) for v in c]) for i, c in enumerate(centroids)]  # k rows
    table = clusters.sparkSession.createDataFrame(centres, "cluster int, centroid array<double>")
    kept = clusters.select("cluster", "n_members", "p_near", "category")
    table.join(kept, "cluster").select("*", F.lit(len(centres)).alias("k"), F.lit(high).alias("high"), F.lit(low).alias("low")).write.json(path)


def read_cluster_artifact(spark, path: str) -> DataFrame:
    return spark.read.schema(
        "cluster int, centroid array<double>, n_members long, p_near double, category string, k int, high double, low double"
    ).json(path)


def category_order(category):
    return F.when(category == "irrigation", 0).when(category == "ambiguous", 1).otherwise(2)


def hash_sample(df: DataFrame, ident: str, n: int, seed: str = "0") -> DataFrame:
    """Reproducible sample of ``n`` rows: the smallest salted hashes of the id."""
    salted = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))
    return df.orderBy(salted, F.col(ident)).limit(n)


def silhouette(labelled: DataFrame, vector: str, label: str) -> DataFrame:
    """Silhouette of all rows under squared Euclidean distance: ``n, silhouette``.

    The mean squared distance to a cluster follows exactly from its size, vector sum
    and sum of squares, so every row is scored against one small row per cluster and
    no pairs are formed. Plain distances would need all pairs. NULL below two clusters.
    """
    rows = labelled.select(array_to_vector(vector).alias("vec"), F.col(label).cast("double").alias("cluster"))
    n = rows.count()
    if rows.select("cluster").distinct().count() < 2:
        return labelled.sparkSession.createDataFrame([(n, None)], "n long, silhouette double")
    judge = ClusteringEvaluator(featuresCol="vec", predictionCol="cluster", distanceMeasure="squaredEuclidean")
    return labelled.sparkSession.createDataFrame([(n, float(judge.evaluate(rows)))], "n long, silhouette double")


# --- classifier -------------------------------------------------------------


def feature_stats(df: DataFrame, features: str) -> DataFrame:
    """Mean and population deviation of every feature position, in one aggregation."""
    long = df.select(F.posexplode(features).alias("i", "v"))
    return long.groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def standardize(df: DataFrame, features: str, stats: list[tuple[float, float]], out: str = "scaled") -> DataFrame:
    """(v − mean) / population std; constant features are only centred."""
    means = F.array(*[F.lit(float(m)) for m, _ in stats])
    stds = F.array(*[F.lit(float(s) if s else 1.0) for _, s in stats])
    pairs = F.zip_with(F.col(features), means, lambda v, m: v - m)
    return df.withColumn(out, F.zip_with(pairs, stds, lambda v, s: v / s))


def collect_stats(df: DataFrame, features: str) -> list[tuple[float, float]]:
    """The statistics as a list: one pair per feature position, a fixed small number."""
    return [(r["mean"], r["std"]) for r in feature_stats(df, features).orderBy("i").collect()]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2·n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.select(label, "n", (total / (F.lit(2.0) * F.col("n"))).alias("weight"))


def fit_logreg(train: DataFrame, label: str, n: int, max_iter: int = 2000):
    """L2 logistic regression with balanced classes on ``n`` rows of scaled features (C = 1)."""
    if not n:
        raise ValueError("no rows to fit a logistic regression on")
    weights = {r[label]: r["weight"] for r in class_weights(train, label).collect()}  # two rows
    weight = F.when(F.col(label), F.lit(weights.get(True, 1.0))).otherwise(F.lit(weights.get(False, 1.0)))
    lr = LogisticRegression(featuresCol="vec", labelCol="y", weightCol="weight", regParam=1.0 / n,
                            standardization=False, maxIter=max_iter)
    model = lr.fit(train.withColumn("weight", weight).withColumn("y", F.col(label).cast("double")))
    _settled("logistic regression", model.summary.totalIterations, max_iter)
    return model


def auc_of(scored: DataFrame, label: str) -> float | None:
    keyed = scored.select(F.lit(0).alias("g"), "p", label)
    row = roc_auc(keyed, ["g"], "p", label).first()
    return None if row is None else row["auc"]


def vectorize(df: DataFrame, features: str, stats) -> DataFrame:
    return standardize(df, features, stats).withColumn("vec", array_to_vector("scaled"))
