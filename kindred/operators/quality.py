"""Alternative document vectors and quality measures for features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.vectors import scale
from kindred.operators.terms import document_frequency
from kindred.operators.titles import sum_word_vectors
from kindred.session import materialise


def weighted_document_vectors(
    docs: DataFrame,
    words: DataFrame,
    counts: DataFrame | None = None,
    key: str = "id",
    a: float = 0.001,
    remove_component: bool = True,
) -> DataFrame:
    """``key, vec``: average of weighted word vectors.

    With corpus ``counts`` (``word, count``) a word weighs ``a / (a + p(word))``,
    otherwise ``ln(N / df)``. ``remove_component`` damps every coordinate by the
    square of the first principal component's coordinate. Its covariance is
    dim x dim, whatever the number of documents.
    """
    if counts is not None:
        total = counts.select(F.sum("count").alias("n")).scalar()
        factor = counts.select("word", (a / (a + F.col("count") / total)).alias("f"))
    else:
        n = docs.select(F.count(F.lit(1)).alias("n")).scalar()
        factor = document_frequency(docs).select("word", F.log(n / F.col("df")).alias("f"))
    weighted = materialise(words.join(factor, "word"), "weighted-words").select(
        "word", scale(F.col("vec"), F.col("f")).alias("vec")
    )
    sums = sum_word_vectors(docs, weighted, key)
    vectors = sums.select(key, scale(F.col("total"), 1 / F.col("n")).alias("vec"))
    if not remove_component:
        return vectors
    vectors = materialise(vectors, "document-vectors")
    component = RowMatrix(vectors.select("vec").rdd.map(lambda r: Vectors.dense(r[0]))).computePrincipalComponents(1)
    kept = F.array(*[F.lit(1 - float(u) ** 2) for u in component.toArray()[:, 0]])
    return vectors.select(key, F.zip_with("vec", kept, lambda x, u: x * u).alias("vec"))


def contingency(df: DataFrame, left: str, right: str) -> DataFrame:
    """``left, right, n``."""
    return df.groupBy(F.col(left).alias("left"), F.col(right).alias("right")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row ``adjusted_rand`` from a contingency table."""
    inside = table.agg(F.sum(_pairs(F.col("n"))).alias("v"), F.sum("n").alias("n"))
    margin = lambda c: table.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("v")).scalar()
    a, b = margin("left"), margin("right")
    expected = a * b / _pairs(F.col("n"))
    largest = (a + b) / 2
    value = F.when(largest == expected, 1.0).otherwise((F.col("v") - expected) / (largest - expected))
    return inside.select(value.alias("adjusted_rand"))


def _expected_information(a: int, b: int, n: int) -> float:
    """Expected mutual information of two clusters of ``a`` and ``b`` of ``n``."""
    first, last = max(1, a + b - n), min(a, b)
    log_factorial = lambda x: math.lgamma(x + 1)
    log_p = sum(map(log_factorial, (a, b, n - a, n - b))) - sum(
        map(log_factorial, (n, first, a - first, b - first, n - a - b + first))
    )
    total = 0.0
    for start in range(first, last + 1, 1 << 20):
        shared = np.arange(start, min(last, start + (1 << 20) - 1) + 1, dtype=float)
        ratio = (a - shared) * (b - shared) / ((shared + 1) * (n - a - b + shared + 1))
        with np.errstate(divide="ignore"):
            steps = np.log(ratio)
        logs = log_p + np.concatenate([[0.0], np.cumsum(steps[:-1])])
        total += float(np.sum(shared / n * np.log(n * shared / (a * b)) * np.exp(logs)))
        log_p = logs[-1] + steps[-1]
    return total


@F.pandas_udf(T.DoubleType())
def _expected(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_expected_information(int(x), int(y), int(z)) for x, y, z in zip(a, b, n)])


def adjusted_mutual_information(table: DataFrame) -> DataFrame:
    """One row ``adjusted_mutual_information``, normalised by the larger entropy.

    ``left`` is the clustering: its number of clusters is a parameter of the
    clustering, so its sizes are a short list that goes to each distinct size on
    the right side.
    """
    table = materialise(table, "contingency")
    margin = lambda c: table.groupBy(c).agg(F.sum("n").alias("n"))
    n = table.agg(F.sum("n")).first()[0]
    entropy = lambda c: margin(c).agg(F.sum(-F.col("n") / n * F.log(F.col("n") / n))).first()[0]
    share = F.col("n") / n
    information = (
        table.join(margin("left").withColumnRenamed("n", "a"), "left")
        .join(margin("right").withColumnRenamed("n", "b"), "right")
        .agg(F.sum(share * F.log(n * F.col("n") / (F.col("a") * F.col("b")))))
        .first()[0]
    )
    sizes = F.array(*[F.lit(row["n"]) for row in margin("left").collect()])
    expected = (
        margin("right").groupBy("n").agg(F.count(F.lit(1)).alias("times"))
        .select("times", F.col("n").alias("b"), F.explode(sizes).alias("a"))
        .agg(F.sum(F.col("times") * _expected("a", "b", F.lit(n))))
        .first()[0]
    )
    largest = max(entropy("left"), entropy("right"))
    value = 1.0 if largest == expected else (information - expected) / (largest - expected)
    return table.sparkSession.createDataFrame([(float(value),)], "adjusted_mutual_information double")


def cluster_quality(df: DataFrame, features: str, label: str, clusters: int, seed: int = 11) -> DataFrame:
    """Agreement of a k-means clustering of ``features`` with ``label``: one row
    ``adjusted_rand, adjusted_mutual_information``."""
    rows = df.select(array_to_vector(features).alias("features"), label)
    model = KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    table = materialise(contingency(model.transform(rows), "cluster", label), "contingency")
    return adjusted_rand(table).withColumn(
        "adjusted_mutual_information", adjusted_mutual_information(table).scalar()
    )


def _labelled(df: DataFrame, features: str, label: str) -> DataFrame:
    rows = df.select(array_to_vector(features).alias("features"), F.col(label).cast("string").alias("name"))
    return StringIndexer(inputCol="name", outputCol="label").fit(rows).transform(rows)


def tune_classifier(
    df: DataFrame, features: str, label: str, grid: list[dict], folds: int = 10, seed: int = 11
) -> DataFrame:
    """``setting, log_loss`` of a logistic regression for each parameter setting,
    averaged over ``folds``, best first."""
    rows = materialise(_labelled(df, features, label), "labelled")
    model = LogisticRegression()
    maps = [{model.getParam(k): v for k, v in setting.items()} for setting in grid]
    found = CrossValidator(
        estimator=Pipeline(stages=[model]), estimatorParamMaps=maps, numFolds=folds, seed=seed,
        evaluator=MulticlassClassificationEvaluator(metricName="logLoss"),
    ).fit(rows)
    results = [(str(s), float(m)) for s, m in zip(grid, found.avgMetrics)]
    return df.sparkSession.createDataFrame(results, "setting string, log_loss double").orderBy("log_loss")


def classifier_quality(
    df: DataFrame, features: str, label: str, test_share: float = 0.3, seed: int = 11, **params
) -> DataFrame:
    """One row ``accuracy, log_loss`` of a ridge logistic regression on held-out rows."""
    rows = materialise(_labelled(df, features, label), "labelled")
    train, test = rows.randomSplit([1 - test_share, test_share], seed)
    scored = LogisticRegression(**params).fit(train).transform(test)
    values = [
        float(MulticlassClassificationEvaluator(metricName=m).evaluate(scored)) for m in ("accuracy", "logLoss")
    ]
    return df.sparkSession.createDataFrame([tuple(values)], "accuracy double, log_loss double")
